"""Tables of a dataset folder, and the corpus view of its documents."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ignore import tree_files

#: Directory names left out of a walk by default (fixed values), besides the folder of an index.
DEFAULT_EXCLUDES = [
    "node_modules", "target", "dist", "build", ".next", ".nuxt", "__pycache__", ".venv", "venv", "vendor", ".git", ".hg", ".svn",
    "coverage", ".cache", ".turbo", ".output", ".vercel", "tmp", ".temp", ".gradle", ".idea", ".vscode", ".terraform", ".pants.d",
    "bazel-out", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".tox", ".eggs", "__pypackages__", ".hypothesis",
    ".ipynb_checkpoints", "htmlcov", "bower_components", ".dart_tool", ".pub-cache", ".cargo", "Pods", ".lodestrata",
]
#: Extensions that a type name stands for; any other name stands for itself (fixed values).
TYPE_ALIASES = {
    "rs": ["rs"], "rust": ["rs"], "ts": ["ts", "tsx"], "typescript": ["ts", "tsx"], "js": ["js", "jsx", "mjs", "cjs"],
    "javascript": ["js", "jsx", "mjs", "cjs"], "py": ["py", "pyi"], "python": ["py", "pyi"], "ruby": ["rb"], "c": ["c", "h"],
    "cpp": ["cpp", "cxx", "cc", "hpp", "hxx"], "cxx": ["cpp", "cxx", "cc", "hpp", "hxx"], "html": ["html", "htm"],
    "yaml": ["yaml", "yml"], "yml": ["yaml", "yml"], "md": ["md", "markdown"], "markdown": ["md", "markdown"], "sh": ["sh", "bash"],
    "bash": ["sh", "bash"], "kt": ["kt", "kts"], "kotlin": ["kt", "kts"],
}
#: Folders too wide to be walked without an index.
DANGEROUS_ROOTS = ["/", "/home", "/root", "/usr", "/etc", "/var", "/opt", "/tmp", "/Users"]
MAX_FILE_SIZE = 1_048_576
SNIFF_BYTES = 8192


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, text, lang, source: documents as files named source/doc_id.lang."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text", "lang", "source")


def check_root(folder: str, indexed: bool = False) -> str:
    """The folder, or ValueError for a system or home folder that has no index."""
    plain = folder.rstrip("/") or "/"
    if not indexed and (plain in DANGEROUS_ROOTS or plain.count("/") == 2 and plain.startswith(("/home/", "/Users/"))):
        raise ValueError(f"{plain} is too wide to walk without an index")
    return plain


#: What marks the root of a project.
MARKERS = ["Cargo.toml", "package.json", "go.mod", "pyproject.toml", "setup.py", "pom.xml", "build.gradle", "Gemfile", "composer.json", "Makefile"]


def find_root(start: str, markers: list[str] | None = None, home: str | None = None) -> str:
    """The highest folder at or above start, below home, with a repository and a marker; else with a repository, else with a marker;
    else start."""
    at = os.path.abspath(start if os.path.isdir(start) else os.path.dirname(start) or ".")
    first, top, best = at, home or os.path.expanduser("~"), {}
    while at != top:
        git = os.path.exists(os.path.join(at, ".git"))
        marked = any(os.path.exists(os.path.join(at, m)) for m in (MARKERS if markers is None else markers))
        for kind, holds in (("both", git and marked), ("git", git), ("marker", marked)):
            if holds:
                best[kind] = at
        if at == os.path.dirname(at):
            break
        at = os.path.dirname(at)
    return next((best[k] for k in ("both", "git", "marker") if k in best), first)


def walk(spark: SparkSession, folder: str, excludes: list[str] | None = None, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """path (below the folder), text, size, mtime of its files: hidden and ignored files, default excludes, large and binary ones left out;
    sorted by path. A folder that is one file gives that file.

    A folder of this machine's file system (which executors must see too) is listed by the driver, names only, and read by tasks. Any
    other store is listed by Spark, which passes over names that start with . or _ and knows no ignore files.
    """
    names = DEFAULT_EXCLUDES if excludes is None else excludes
    local = folder.removeprefix("file://")
    if os.path.isfile(local):
        raw = _read_files(spark, os.path.dirname(local) or ".", [os.path.basename(local)], max_size)
    elif os.path.isdir(local):
        raw = _read_files(spark, local, tree_files(local, set(names)), max_size)
    else:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        raw = raw.withColumn("path", F.element_at(F.split("path", re.escape(folder.rstrip("/")) + "/", 2), -1))
        parts = F.split("path", "/")
        raw = raw.where(~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(x) for x in names])) & size_within(F.col("length"), max_size))
    plain = raw.where(F.expr(f"NOT hex(substring(content, 1, {SNIFF_BYTES})) RLIKE '^(?:..)*?00'"))
    # bytes that are no UTF-8 become replacement characters
    return plain.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).orderBy("path")


def _read_files(spark: SparkSession, root: str, paths, max_size: int) -> DataFrame:
    """path, content, length, modificationTime of the files that can be read."""
    import pandas as pd

    root = os.path.abspath(root)
    listed = spark.createDataFrame([(p,) for p in paths], "path string")

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    info = os.stat(os.path.join(root, path))
                    if max_size == 0 or info.st_size <= max_size:
                        with open(os.path.join(root, path), "rb") as f:
                            rows.append((path, f.read(), info.st_size, info.st_mtime_ns // 1000))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "content", "length", "changed"])

    read = spread(listed).mapInPandas(run, "path string, content binary, length long, changed long")
    return read.select("path", "content", "length", F.timestamp_micros("changed").alias("modificationTime"))


def size_within(size: Column, most: int) -> Column:
    """most = 0: no limit; a file of exactly that size passes."""
    return F.lit(True) if most == 0 else size <= most


def is_binary(text: Column, first: int = SNIFF_BYTES) -> Column:
    """A NUL among the first characters."""
    return F.contains(F.substring(text, 1, first), F.lit("\0"))


def embeddable(text: Column) -> Column:
    """Texts that chunks and vectors are made of: no NUL among the first 512 characters."""
    return ~is_binary(text, 512)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def of_type(path: Column, kind: str) -> Column:
    return extension(path).isin(TYPE_ALIASES.get(kind, [kind]))


def matches_glob(path: Column, glob: str) -> Column:
    """`*.ext` is a suffix test, anything else a substring test."""
    return path.endswith(glob[1:]) if glob.startswith("*.") else path.contains(glob)


def under_paths(path: Column, filters: list[str]) -> Column:
    """An entry that ends with / is a prefix, any other a whole path; one of them must hold."""
    if not filters:
        return F.lit(True)
    test = F.lit(False)
    for f in filters:
        test = test | (path.startswith(f) if f.endswith("/") else path == F.lit(f))
    return test


def excluded(path: Column, names: list[str] | None = None) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(x) for x in (names or DEFAULT_EXCLUDES)]))


SPLIT_BYTES = 4 * 1024 * 1024  # Spark makes no smaller splits of files by itself


def spread(df: DataFrame) -> DataFrame:
    """Deals rows to every core when the input is too small to have a split for each; larger inputs stay as read.

    Goes by the plan's own estimate, so nothing runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def session_files(spark: SparkSession, folder: str, since: str) -> DataFrame:
    """session, seq, value: the lines of the *.jsonl files under a folder that changed at or after a time (ISO)."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("modifiedAfter", since).text(folder)
    x = lines.select(F.col("_metadata.file_path").alias("session"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")
    return x.select("session", F.row_number().over(Window.partitionBy("session").orderBy("at", "n")).alias("seq"), "value")


def tail_lines(lines: DataFrame, most_bytes: int = 64 * 1024) -> DataFrame:
    """session, seq, value: the lines that lie wholly in the last bytes of each session."""
    w = Window.partitionBy("session").orderBy(F.desc("seq"))
    return lines.withColumn("b", F.sum(F.octet_length("value") + 1).over(w)).where(F.col("b") <= most_bytes).drop("b")
