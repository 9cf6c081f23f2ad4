"""Registered streaming queries; each drains the landed
table as a stream and is compared with the same computation in batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..session import read_table
from ..sources import files as FS
from ..sources import listings as L
from ..streaming import stream as ST
from . import sqltext as S
from .q_codemix import ZIPF_CTE, common, detector_cte
from .q_dataset import _posts
from .registry import query


def _glob(sf: str, name: str) -> str:
    """File stream sources watch a directory or glob, not a single file."""
    return f"{sf}/{name}*.parquet"


def stream_ingest_q(spark, sf):
    ev = ST.read_stream(spark, _glob(sf, "events"), ST.EVENT_SCHEMA)
    out = ST.run_available(ST.ingest(ev), "ingest",
                           transform_batch=lambda b: b.select("event_id", "event_type", "k",
                                                              F.array_join("errors", ",").alias("errors")))
    return out


query("stream_ingest", """SELECT DISTINCT ON (event_id) event_id, event_type,
  coalesce(json_extract_string(props, '$.k'), 'unknown') AS k,
  array_to_string(list_filter([CASE WHEN NOT coalesce(value BETWEEN 0.0 AND 1000.0, FALSE) THEN 'value_range' END,
    CASE WHEN NOT coalesce(event_type IS NOT NULL, FALSE) THEN 'type_present' END], lambda e: e IS NOT NULL), ',') AS errors
FROM events ORDER BY event_id, ts""")(stream_ingest_q)


def stream_tag_q(spark, sf):
    """Common words of the English documents are published, then the stream
    of documents is cleaned and runs through the whole detector."""
    words = FS.scratch_path(spark, "common-words")
    FS.publish_replacing(common(spark, sf), words)
    docs = ST.read_stream(spark, _glob(sf, "documents"), "doc_id long, text string, lang string, source string, n_chars long")
    out = ST.tag_stream(docs, words)
    return out.select("doc_id", F.round("cm_ratio", 6).alias("cm_ratio"), F.col("cm_switches").cast("int").alias("cm_switches"),
                      F.round("cm_score", 6).alias("cm_score"), "is_cm")


query("stream_tag", f"""WITH {ZIPF_CTE},
c AS (SELECT doc_id, {S.clean_text("text")} AS text FROM documents),
{detector_cte("c")}
SELECT id AS doc_id, round(cm_ratio, 6) AS cm_ratio, cm_switches, round(cm_score, 6) AS cm_score,
       cm_score >= {P.CM_THRESHOLD} AS is_cm FROM cm""")(stream_tag_q)


# L1 (listings) ---------------------------------------------------------------
def stream_listings_q(spark, sf):
    """Conversations as landed listing pages (one JSON a line), every page
    polled twice and one broken page; roles stand for subreddits, each listed
    by two locales but for the system's."""
    c = read_table(spark, sf, "conversations")
    p = _posts(spark, sf).join(c.select("conv_id", F.col("turn").alias("_ord"), F.concat_ws("-", "conv_id", "turn").alias("id")),
                               ["conv_id", "_ord"])
    post = F.struct(*[F.col(k) for k in ("id", *L.POST_DEFAULTS)])
    pages = L.pack_listing(p, F.col("conv_id"), post).select(F.col("listing").alias("value"))
    path = FS.scratch_path(spark, "listings")
    pages.write.text(path)
    pages.union(spark.createDataFrame([('{"data": {"children": [',)], "value string")).write.mode("append").text(path)
    config = c.select(F.col("role").alias("subreddit"), F.explode(F.array(F.lit("en-AU"), F.lit("en-UK"))).alias("locale")).where("role <> 'system'")
    posts, rejects = ST.ingest_listings(spark, path, config, max_files=50)
    return posts.select("post_id", "locale", "subreddit", F.md5("selftext").alias("text_md5"), "score",
                        F.array_join("errors", ",").alias("errors"), "score_mismatch") \
        .unionByName(rejects.select(F.lit(None).cast("string").alias("post_id"), F.lit(None).cast("string").alias("locale"),
                                    F.col("reject").alias("subreddit"), F.md5("raw").alias("text_md5"), F.lit(None).cast("int").alias("score"),
                                    F.lit("rejected").alias("errors"), F.lit(False).alias("score_mismatch")))


query("stream_listings", """WITH p AS (SELECT DISTINCT conv_id || '-' || turn AS post_id, coalesce(role, 'unknown') AS subreddit,
    md5(coalesce(text, '')) AS text_md5, (turn % 7) / 5.0 AS upvote_ratio, CAST(turn AS INTEGER) AS ups,
    CAST(conv_id % 2 AS INTEGER) AS downs,
    CAST(CASE WHEN turn % 4 = 0 THEN turn + 1 ELSE turn - conv_id % 2 END AS INTEGER) AS score FROM conversations),
config AS (SELECT DISTINCT role AS subreddit, locale FROM conversations, (VALUES ('en-AU'), ('en-UK')) l(locale) WHERE role <> 'system')
SELECT post_id, locale, p.subreddit, text_md5, score,
  CASE WHEN upvote_ratio BETWEEN 0.0 AND 1.0 THEN '' ELSE 'upvote_ratio_range' END AS errors,
  coalesce(downs = 0 AND score <> ups, FALSE) AS score_mismatch
FROM p LEFT JOIN config ON p.subreddit = config.subreddit
UNION ALL SELECT NULL, NULL, 'malformed', md5('{"data": {"children": ['), NULL, 'rejected', FALSE""")(stream_listings_q)


# L3 (late rows) --------------------------------------------------------------
def stream_late_rows_q(spark, sf):
    """Events land in two parts: the second holds every event with an id
    divisible by 10, much of it behind the watermark of the first."""
    ev = read_table(spark, sf, "events").where("ts IS NOT NULL")
    path = FS.scratch_path(spark, "events")
    tail = F.col("event_id") % 10 == 0
    cols = [f.name for f in ST.EVENT_SCHEMA]
    root = FS.scratch_path(spark, "late")

    def drain():
        s = ST.read_stream(spark, path, ST.EVENT_SCHEMA)
        return ST.run_available(ST.rates_with_late_rows(s), "late", root=root, state_store=ST.STATE_STORE)
    ev.where(~tail).select(cols).write.parquet(path)
    drain()
    ev.where(tail).select(cols).write.mode("append").parquet(path)
    out = drain()
    return out.select("late", "key", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", "event_id",
                      F.round("total", 4).alias("total"))


query("stream_late_rows", """WITH e AS (SELECT *, date_trunc('hour', ts) AS w, event_id % 10 = 0 AS tail FROM events WHERE ts IS NOT NULL),
mark AS (SELECT date_trunc('millisecond', max(ts) FILTER (WHERE NOT tail)) - INTERVAL 1 HOUR AS first,
                date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS last FROM e),
x AS (SELECT e.*, tail AND w + INTERVAL 1 HOUR <= mark.first AS late FROM e, mark)
SELECT late, event_type AS key, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(1 AS BIGINT) AS n, event_id, round(value, 4) AS total
FROM x WHERE late
UNION ALL
SELECT FALSE, event_type, strftime(w, '%Y-%m-%d %H:%M:%S'), CAST(count(*) AS BIGINT), NULL, round(sum(coalesce(value, 0.0)), 4)
FROM x, mark WHERE NOT late GROUP BY event_type, w HAVING w + INTERVAL 1 HOUR <= max(mark.last)""")(stream_late_rows_q)


# L3 --------------------------------------------------------------------------
def stream_label_rate_q(spark, sf):
    ev = ST.read_stream(spark, _glob(sf, "events"), ST.EVENT_SCHEMA)
    rates = ST.windowed_rates(ev)
    return ST.run_available(rates, "rates", mode="append", transform_batch=lambda b: b.select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type",
        F.col("n").cast("long").alias("n"), F.round("mean_value", 6).alias("mean_value")))


# Append mode emits a window once the watermark (latest event time, kept to
# the millisecond, minus the 1 hour delay) has passed its end; later windows
# stay in the checkpointed state until newer data closes them.
WATERMARK_SQL = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"

query("stream_label_rate", f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
  CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean_value
FROM events WHERE ts IS NOT NULL GROUP BY date_trunc('hour', ts), event_type
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {WATERMARK_SQL}""")(stream_label_rate_q)


# L3 (sessions) ---------------------------------------------------------------
def stream_sessions_q(spark, sf):
    ev = ST.read_stream(spark, _glob(sf, "events"), ST.EVENT_SCHEMA).where(F.col("ts").isNotNull())
    sess = ST.sessions(ev, "30 minutes")
    return ST.run_available(sess, "sessions", mode="append", transform_batch=lambda b: b.select(
        "user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"),
        F.date_format("s.end", "yyyy-MM-dd HH:mm:ss").alias("session_end"), F.col("n").cast("long").alias("n")))


query("stream_sessions", f"""WITH e AS (SELECT user_id, ts,
    CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
           OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new
  FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start,
       strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, CAST(count(*) AS BIGINT) AS n
FROM s GROUP BY user_id, sid
HAVING max(ts) + INTERVAL 30 MINUTE <= {WATERMARK_SQL}""")(stream_sessions_q)
