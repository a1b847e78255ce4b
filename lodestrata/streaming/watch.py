"""Streams of changes: quiet-gap debouncing, content deduplication, holds, activity and calendar windows.

Each has a batch form with the same rows, so that a bounded table and a stream of it agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEBOUNCE = "750 milliseconds"
HASH_LIMIT = 5 * 1024 * 1024
HOT_FILES = 20


def event_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet") -> DataFrame:
    """New files of a folder as a stream. Local timestamps are read as UTC ones: watermarks need an instant."""
    x = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return instants(x)


def instants(df: DataFrame) -> DataFrame:
    for f in df.schema:
        if f.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def debounce(events: DataFrame, key: str, gap: str = DEBOUNCE, late: str | None = None) -> DataFrame:
    """key, first, last, n: bursts of events of a key, ended by a quiet gap. late: the watermark of a stream."""
    x = events.withWatermark("ts", late) if late else events
    w = F.session_window("ts", gap)
    out = x.groupBy(w.alias("w"), key).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return out.select(key, "first", "last", "n")


def tumbling(events: DataFrame, key: str, width: str = "1 day", late: str | None = None) -> DataFrame:
    x = events.withWatermark("ts", late) if late else events
    out = x.groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total")


def activity(events: DataFrame, key: str, window: str = "300 seconds", slide: str = "10 seconds", late: str | None = None) -> DataFrame:
    """start, key, n: activity in sliding windows."""
    x = events.withWatermark("ts", late) if late else events
    return x.groupBy(F.window("ts", window, slide).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def changed_content(events: DataFrame, key: str, content: Column, order: list[str]) -> DataFrame:
    """Batch form: events whose content differs from the key's last one (A, B, A are three changes); deletions (null) pass and forget.
    Contents of more than HASH_LIMIT bytes always pass."""
    h = F.xxhash64(content)
    x = events.withColumn("_h", F.when(content.isNotNull(), h))
    w = Window.partitionBy(key).orderBy(*order)
    prev = F.lag("_h").over(w)
    first = F.row_number().over(w) == 1
    big = F.coalesce(F.octet_length(content) > HASH_LIMIT, F.lit(False))
    x = x.withColumn("_keep", first | F.col("_h").isNull() | prev.isNull() | (prev != F.col("_h")) | big)
    return x.where("_keep").drop("_h", "_keep")


def changed_content_stream(events: DataFrame, key: str, content: str) -> DataFrame:
    """Stream form of changed_content, with the same hash: the last one of each key is state. events must have key, content and seq (its
    order)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    out = f"`{key}` {kinds[key]}, seq {kinds['seq']}, `{content}` string"
    # 0 stands for no content, so that hashes stay whole numbers on their way; _there tells the two apart
    x = events.select(key, "seq", content, F.coalesce(F.when(F.col(content).isNotNull(), F.xxhash64(content)), F.lit(0)).alias("_h"), F.col(content).isNotNull().alias("_there"), F.coalesce(F.octet_length(content) > HASH_LIMIT, F.lit(False)).alias("_big"))

    def step(k: tuple, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        for pdf in frames:
            pdf = pdf.sort_values("seq")
            rows = []
            for seq, text, h, there, big in zip(pdf["seq"], pdf[content], pdf["_h"], pdf["_there"], pdf["_big"], strict=True):
                if not there or big or h != last:
                    rows.append((k[0], seq, text if there else None))
                last = int(h) if there else None
            yield pd.DataFrame(rows, columns=[key, "seq", content])
        if last is None:
            if state.exists:
                state.remove()
        else:
            state.update((last,))

    return x.groupBy(key).applyInPandasWithState(step, out, "h long", "append", GroupStateTimeout.NoTimeout)


def held(events: DataFrame, order: str = "ts") -> DataFrame:
    """Batch form of session holds: events(key, ts, kind begin / end / change) of a key; a change while holders are open is released
    at the end of the hold, once a path. key, path, released."""
    w = Window.partitionBy("key").orderBy(order, "seq")
    step = F.when(F.col("kind") == "begin", 1).when(F.col("kind") == "end", -1).otherwise(0)
    x = events.withColumn("open", F.sum(step).over(w))
    closing = F.when((F.col("kind") == "end") & (F.col("open") == 0), F.col(order))
    x = x.withColumn("next_end", F.first(closing, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    x = x.where("kind = 'change'").withColumn("released", F.when(F.col("open") > 0, F.col("next_end")).otherwise(F.col(order)))
    return x.select("key", "path", "released").distinct()


def held_stream(events: DataFrame, order: str = "ts") -> DataFrame:
    """Stream form of held: how many holders of a key are open, and the paths that wait, are state. A path comes out when its hold ends,
    so what is still held at the end has not come out yet (the batch form gives it without a time)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def step(k: tuple, frames, state: GroupState):
        open_, waiting = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        out = {}
        for pdf in frames:
            pdf = pdf.sort_values([order, "seq"])
            for at, kind, path in zip(pdf[order], pdf["kind"], pdf["path"], strict=True):
                if kind == "begin":
                    open_ += 1
                elif kind == "end":
                    open_ -= 1
                    if open_ == 0:
                        out |= {(p, at): None for p in waiting}
                        waiting = []
                elif kind == "change" and open_ > 0:
                    if path not in waiting:
                        waiting.append(path)
                elif kind == "change":
                    out[path, at] = None
        state.update((open_, waiting))
        yield pd.DataFrame([(k[0], p, at) for p, at in out], columns=["key", "path", "released"])

    schema = f"key {kinds['key']}, path string, released {kinds[order]}"
    return events.groupBy("key").applyInPandasWithState(step, schema, "open long, waiting array<string>", "append", GroupStateTimeout.NoTimeout)


def activity_changes(events: DataFrame, key: str, item: str, window: str = "300 seconds", slide: str = "10 seconds") -> DataFrame:
    """start, key, items, fingerprint of the sliding windows in which a key's active items are others than in its window before."""
    seen = events.groupBy(F.window("ts", window, slide)["start"].alias("start"), key).agg(F.sort_array(F.collect_set(F.col(item).cast("string"))).alias("items"))
    seen = seen.withColumn("fingerprint", F.xxhash64("items"))
    before = F.lag("fingerprint").over(Window.partitionBy(key).orderBy("start"))
    return seen.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("fingerprint"))).drop("before")


def hot_files(events: DataFrame, key: str, item: str, most: int = HOT_FILES) -> DataFrame:
    """key, items: the items of a key seen last, each once, at most so many, in order of their last sight."""
    last = events.groupBy(key, item).agg(F.max("ts").alias("ts"))
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), item))
    x = last.withColumn("r", r).where(F.col("r") <= most)
    return x.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("r"), F.col(item).alias("i"))), asc=False), lambda v: v["i"].cast("string")), ",").alias("items"))


def merge_batches(stream: DataFrame, folder: str, checkpoint: str, key: str):
    """Each micro-batch becomes a delta file and a list of tombstones; the newest version of a key wins. Started with availableNow."""

    def write(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
        latest = batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        latest.withColumn("generation", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/delta/generation={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idle(events: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """key, last: keys to drop: without an event for so long, and not inside a session (more begins than ends)."""
    open_ = F.sum(F.when(F.col("kind") == "begin", 1).when(F.col("kind") == "end", -1).otherwise(0))
    x = events.groupBy("key").agg(F.max("ts").alias("last"), open_.alias("open"))
    return x.where((F.col("open") <= 0) & (F.col("last") < now - F.expr(f"INTERVAL {seconds} SECONDS"))).select("key", "last")
