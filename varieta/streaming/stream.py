"""Structured Streaming re-aims.

The reference collects by polling; landing those polls as files makes the
ingestion naturally incremental.  Every query here is a ``readStream`` →
transformations → ``writeStream`` with a checkpoint in the shared
checkpoint folder, so a query that is given the same folder again resumes
exactly where it stopped, and a replayed batch overwrites its own output.  ``run_available`` drains what has landed (``availableNow``) and
returns a batch read of the sink.
"""

from __future__ import annotations

import os
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.codemix import detect_code_mixing
from ..functions.rules import quality_gate
from ..functions.text import clean_text
from ..sources.files import current_version, read_current, scratch_path
from ..sources.listings import gate_posts, landed_posts, tag_locale

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def ingest(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """L1: parse, gate and de-duplicate repeated polls within the watermark."""
    parsed = events.withColumn("k", F.coalesce(F.get_json_object("props", "$.k"), F.lit("unknown")))
    gated = quality_gate(parsed, [("value_range", F.col("value").between(0.0, 1000.0)),
                                  ("type_present", F.col("event_type").isNotNull())])
    return gated.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


LANDED_LINE = T.StructType([T.StructField("value", T.StringType())])


def listing_posts(lines: DataFrame, watermark: str = "2 days") -> DataFrame:
    """L1 for landed polls (a stream of lines, one JSON listing each): posts
    and rejects (``listings.landed_posts``), each post once.

    The state holds an id for ``watermark`` after its first sight, by the time
    of the batch, so a page that is polled or replayed within that time adds
    nothing, however old its posts are.  A reject is told by its text: a
    replayed broken page is rejected once."""
    posts = landed_posts(lines)
    key = F.when(F.col("reject").isNull(), F.col("post_id")).otherwise(F.concat(F.lit("reject:"), F.md5("raw")))
    seen = posts.withColumn("_key", key).withColumn("_at", F.current_timestamp())
    return seen.withWatermark("_at", watermark).dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_at")


def ingest_listings(spark: SparkSession, path: str, config: DataFrame, root: str | None = None, watermark: str = "2 days",
                    max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """L1: drain the landed listing lines under ``path`` into posts (gated,
    tagged with their locales by ``config``) and rejects (reason, raw), and
    return batch reads of both.  Given the same ``root`` a later call takes up
    where the last one stopped; replayed batches overwrite their folders."""
    root = root or scratch_path(spark, "stream-listings")
    stream = listing_posts(read_stream(spark, path, LANDED_LINE, "text", max_files), watermark)

    def posts(b):
        return tag_locale(gate_posts(b.where("reject IS NULL").drop("reject", "raw")), config)

    def rejects(b):
        return b.where("reject IS NOT NULL").select("reject", "raw")
    sinks = {"posts": posts, "rejects": rejects}

    def both(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()   # the state is stepped once for both outputs
        try:
            for name, part in sinks.items():
                epoch_sink(os.path.join(root, name), transform_batch=part)(batch, epoch)
        finally:
            batch.unpersist()
    drain(stream, os.path.join(root, "_checkpoint"), both)
    return tuple(read_sink(stream, os.path.join(root, name), part) for name, part in sinks.items())


def tag_stream(docs: DataFrame, words_root: str, id_col: str = "doc_id", text_col: str = "text", root: str | None = None,
               clean: bool = True) -> DataFrame:
    """L2: the whole code-mixing detector (C9, M1-M4) on a stream of documents.

    The common words are the last version published under ``words_root``
    (``publish_replacing``), looked up again for every batch: a version that
    is published while the query runs takes effect with the next batch, and
    each batch sees one version from start to end.  Returns (id, cm_ratio,
    cm_switches, cm_score, is_cm, words_version)."""
    spark = docs.sparkSession

    def tagged(batch):
        version = current_version(spark, words_root)
        common = read_current(spark, words_root, version)
        texts = batch.select(id_col, text_col)
        flags = detect_code_mixing(clean_text(texts, text_col) if clean else texts, common, id_col, text_col)
        return flags.withColumn("words_version", F.lit(version).cast("long"))
    return run_available(docs, "tagged", transform_batch=tagged, root=root)


UNTIMED = -(2 ** 62)   # window of events without time: before every watermark
LATE_SCHEMA = T.StructType([
    T.StructField("late", T.BooleanType()), T.StructField("key", T.StringType()), T.StructField("start_ms", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()),
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType())])


class LateAccount(StatefulProcessor):
    """State of one window of one key: count and sum while the window is open,
    and a timer at its end."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        name, start = key
        end = start + self.window_ms
        late = timerValues.getCurrentWatermarkInMs() >= end
        n, total = (self.open.get() if self.open.exists() else None) or (0, 0.0)
        for part in rows:
            if late:
                yield pd.DataFrame({"late": True, "key": name, "start_ms": start, "n": 1, "total": part["value"].to_numpy(),
                                    "event_id": part["event_id"].to_numpy(), "ts": part["ts"].to_numpy()})
            else:
                n += len(part)
                total += float(part["value"].fillna(0.0).sum())
        if not late:
            self.open.update((n, total))
            self.handle.registerTimer(end)   # fires once the watermark has reached it

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd
        n, total = self.open.get()
        self.open.clear()
        yield pd.DataFrame({"late": [False], "key": [key[0]], "start_ms": [key[1]], "n": [n], "total": [total],
                            "event_id": pd.array([None], dtype="Int64"), "ts": [pd.NaT]})

    def close(self) -> None:
        pass


def rates_with_late_rows(events: DataFrame, key: str = "event_type", window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """L3 with an account of what comes too late: a row (late = false) for each
    closed window and key with its count and sum, and one row (late = true)
    for each event whose window the watermark had passed when it arrived.

    The engine's own windows drop such events without a trace.  Here the state
    holds one (count, sum) for each open window and key; a timer at the
    window's end writes the window and clears the state once the watermark has
    passed it.  Events without time are late at once, with a null window; null
    keys count as one key.  Every event is in a window that was written, in
    one still open, or in a late row.  The query needs a state store that
    holds timers: start it with ``STATE_STORE`` (``run_available`` takes it as
    ``state_store``)."""
    ms = int(float(events.sparkSession.sql(f"SELECT unix_millis(TIMESTAMP'1970-01-01 00:00:00' + INTERVAL {window})").first()[0]))
    at = F.coalesce(F.floor(F.unix_millis("ts") / ms) * ms, F.lit(UNTIMED))
    # the time is passed on as a plain column: rows behind the watermark are not filtered out before the processor
    keyed = events.withWatermark("ts", watermark).select("event_id", F.timestamp_micros(F.unix_micros("ts")).alias("ts"),
                                                         F.col("value").cast("double").alias("value"),
                                                         F.col(key).cast("string").alias("_key"), at.alias("_start"))
    out = keyed.groupBy("_key", "_start").transformWithStateInPandas(LateAccount(ms), LATE_SCHEMA, "Append", "EventTime")
    start = F.when(F.col("start_ms") != UNTIMED, F.timestamp_millis("start_ms"))
    return out.select("late", "key", start.alias("window_start"), "n", "total", "event_id", "ts")


def windowed_rates(events: DataFrame, key: str = "event_type", window: str = "1 hour",
                   watermark: str = "1 hour") -> DataFrame:
    """L3: events and mean value per tumbling window and key; rows later than
    the watermark are dropped by the engine.  Run it in append mode: a window
    is written once the watermark passes its end and its state is dropped, so
    the state holds only the windows still open."""
    return (events.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), key)
            .agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """L3 (session form): activity sessions per user (append mode: a session
    is written and evicted once the watermark passes its end)."""
    return (events.withWatermark("ts", watermark)
            .groupBy(F.session_window("ts", gap).alias("s"), "user_id")
            .agg(F.count("*").alias("n")))


def epoch_sink(out: str, mode: str = "append",
               transform_batch: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer that can be replayed: each epoch has a folder of its own
    under ``out``, overwritten when the engine runs the epoch again (complete
    mode holds the last result alone)."""
    def sink(batch: DataFrame, epoch: int) -> None:
        b = transform_batch(batch) if transform_batch else batch
        b.write.mode("overwrite").parquet(os.path.join(out, "epoch=0" if mode == "complete" else f"epoch={epoch}"))
    return sink


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def drain(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append",
          state_store: str | None = None) -> None:
    """Run the stream over all that has landed, batch by batch, and stop.
    ``state_store`` is the provider of this query alone."""
    conf = df.sparkSession.conf
    before = conf.get(_PROVIDER)
    if state_store:
        conf.set(_PROVIDER, state_store)
    try:
        q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint) \
            .foreachBatch(sink).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        conf.set(_PROVIDER, before)


def read_sink(stream: DataFrame, out: str, transform_batch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Batch read of what ``epoch_sink`` wrote under ``out``; an empty table of
    the same columns if no batch has run yet."""
    spark = stream.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(out)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.read.parquet(out).drop("epoch")
    none = spark.createDataFrame([], stream.schema)
    return transform_batch(none) if transform_batch else none


def run_available(df: DataFrame, name: str, mode: str = "append",
                  transform_batch: Callable[[DataFrame], DataFrame] | None = None, root: str | None = None,
                  state_store: str | None = None) -> DataFrame:
    """Drain what has landed and return a batch read of the sink.

    ``root`` (a shared folder) holds the sink and the checkpoint: a later call
    with the same folder takes up where the last one stopped and reads only
    new input.  Without it the call has a fresh folder under the shared
    checkpoint folder.  Where nothing has landed the result is empty."""
    root = root or scratch_path(df.sparkSession, f"stream-{name}")
    out = os.path.join(root, "out")
    drain(df, os.path.join(root, "_checkpoint"), epoch_sink(out, mode, transform_batch), mode, state_store)
    return read_sink(df, out, transform_batch)
