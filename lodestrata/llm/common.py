"""Helpers the operators of this folder share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import to_workers
from ..sources.tables import spread as spread  # noqa: PLC0414

# White space that str.split() takes as a separator beyond [\x20\x09-\x0D].
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    """Maximal runs of characters other than [\\x20\\x09-\\x0D]."""
    if not text:
        return []
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def lower_az(text: str) -> str:
    """A-Z to a-z, every other character as it is."""
    # bytes.lower() touches A-Z alone, and no byte of a longer UTF-8 sequence lies there
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def hash_words(tokens: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not tokens:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(tokens, dtype=object), categorize=True)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n] + np.uint64(i + 1))
    return out


_own_folders: dict[str, str] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only where it is unset and no other machine takes part, else an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        import tempfile

        _own_folders[app] = tempfile.mkdtemp(prefix="lodestrata-")
    return _own_folders[app]


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint(eager=True)


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup(left: DataFrame, key: str, table: DataFrame, by: str, salts: int = 16) -> DataFrame:
    """left JOIN table ON key (one short row a key in table), a frequent key's rows dealt to `salts` tasks by the column `by`.

    The table is sent `salts` times, which is cheap for pairs of ids and needs no pass to find out which keys are frequent.
    """
    a = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    b = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [key, "_salt"]).drop("_salt")


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, unique: Column) -> DataFrame:
    """left LEFT JOIN right ON key without a task that holds all rows of one key.

    right has one row a key. hot has the rows of right whose key is frequent in left; the caller bounds their number
    (a share of the rows of left, so at most 1 / share keys) and they are broadcast. All other keys are shuffled. Rows of
    left answered by hot get a key of their own (unique, a string) in the shuffle, so they stay spread.
    """
    cols = [c for c in right.columns if c != key]
    h = hot.select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in cols], F.lit(True).alias("_hot"))
    a = left.join(F.broadcast(h), F.col(key).eqNullSafe(F.col("_hk")), "left")
    a = a.withColumn("_jk", F.when(F.col("_hot"), F.concat(F.lit("~"), unique)).otherwise(F.concat(F.lit("="), F.col(key).cast("string"))))
    r = right.select(F.concat(F.lit("="), F.col(key).cast("string")).alias("_jk"), *[F.col(c).alias(f"_r_{c}") for c in cols])
    out = a.join(r, "_jk", "left")
    return out.select(*left.columns, *[F.when(F.col("_hot"), F.col(f"_h_{c}")).otherwise(F.col(f"_r_{c}")).alias(c) for c in cols])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what a Python worker holds: Arrow batches of at most so many rows (Spark's default is 10,000). Sees to the workers' code."""
    to_workers(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def tidy(run):
    """run, a generator over a task's batches, after which the worker gives memory that it no longer uses back to the system: workers
    live on from task to task and stage to stage."""

    def tidied(batches):
        yield from run(batches)
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return tidied


def carry(docs: DataFrame, make) -> DataFrame:
    """docs with all columns as they are, but rows left out or texts replaced. make() gives, once a task, a function from a batch's
    texts to (keep or None, texts or None)."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        step = make()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            keep, texts = step(batch.column(at).to_pylist())
            if texts is not None:
                field = batch.schema.field(at)
                batch = batch.set_column(at, field, pa.array(texts, type=field.type))
            yield batch if keep is None else batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def chunks(texts: list, most_chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about so many characters (one longer text makes a run of its own): what is worked on at once."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and size + n > most_chars:
            yield first, i
            first, size = i, 0
        size += n
    if len(texts) > first:
        yield first, len(texts)
