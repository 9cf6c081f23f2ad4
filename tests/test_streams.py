"""Streams: a replayed batch, a resumed folder, rows later than the watermark."""

import datetime as dt
import json

from pyspark.sql import functions as F

from varieta.functions import codemix as CM
from varieta.sources import files as FS
from varieta.streaming import stream as ST

T0 = dt.datetime(2024, 1, 1)


def _events(spark, rows, path):
    spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), 1, "a", 1.0, None) for i, m in rows], ST.EVENT_SCHEMA) \
        .coalesce(1).write.mode("append").parquet(path)


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    out = str(tmp_path / "out")
    sink = ST.epoch_sink(out)
    batch = spark.range(5)
    sink(batch, 0)
    sink(batch, 1)
    sink(batch, 1)
    assert spark.read.parquet(out).count() == 10


def test_the_same_folder_resumes_and_late_rows_are_dropped(spark, tmp_path):
    src, root = str(tmp_path / "events"), str(tmp_path / "rates")

    def drain():
        rates = ST.windowed_rates(ST.read_stream(spark, src, ST.EVENT_SCHEMA))
        out = ST.run_available(rates, "rates", root=root, transform_batch=lambda b: b.select("w.start", "event_type", "n"))
        return {r.start: r.n for r in out.collect()}
    _events(spark, [(1, 0), (2, 30), (3, 300)], src)
    first = drain()
    assert first == {T0: 2}
    # minute 10 lies before the watermark (minute 240), minute 310 does not
    _events(spark, [(4, 10), (5, 310), (6, 600)], src)
    second = drain()
    assert second[T0] == 2
    assert second[T0 + dt.timedelta(hours=5)] == 2
    assert drain() == second


# -- landed listings -----------------------------------------------------------
def _page(*posts):
    return json.dumps({"data": {"children": [{"data": p} for p in posts]}})


def _land(path, name, *lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_listings_with_replayed_and_broken_pages(spark, tmp_path):
    src, root = tmp_path / "polls", str(tmp_path / "out")
    config = spark.createDataFrame([("en-AU", "sydney"), ("en-UK", "london"), ("en-AU", "london")], "locale string, subreddit string")

    def drain():
        posts, rejects = ST.ingest_listings(spark, str(src), config, root)
        return (sorted((r.post_id, r.locale or "", r.ups, ",".join(r.errors)) for r in posts.collect()),
                sorted((r.reject, r.raw) for r in rejects.collect()))
    src.mkdir()
    assert drain() == ([], [])                          # nothing has landed
    a = {"id": "a", "subreddit": "sydney", "ups": 3, "upvote_ratio": 0.5, "created_utc": 1700000000.5}
    b = {"id": "b", "subreddit": "london", "upvote_ratio": 1.5, "unknown_field": [1, {"x": 2}]}
    bad = {"id": "c", "subreddit": "perth", "ups": "many"}
    _land(src, "1.json", _page(a, b), "", _page(a))
    first = drain()
    assert first == ([("a", "en-AU", 3, ""), ("b", "en-AU", 0, "upvote_ratio_range"), ("b", "en-UK", 0, "upvote_ratio_range")], [])
    # the page comes again with a new post between others, then broken pages
    _land(src, "2.json", _page(b, {"id": "d", "subreddit": "nowhere"}, bad, a), '{"data": {"children": [', '{"kind": "other"}', "[1, 2]")
    posts, rejects = drain()
    assert posts == sorted([*first[0], ("d", "", 0, "")])
    assert [r[0] for r in rejects] == ["bad_post", "malformed", "malformed", "no_children"]
    assert json.loads(rejects[0][1])["ups"] == "many"
    _land(src, "3.json", _page(b, bad, a), '{"data": {"children": [')
    assert drain() == (posts, rejects)


def test_posts_without_ids_and_fields(spark, tmp_path):
    src = tmp_path / "polls"
    _land(src, "1.json", _page({}, {}, {"title": "t"}, {"title": "t", "selftext": None}))
    posts, rejects = ST.ingest_listings(spark, str(src), spark.createDataFrame([], "locale string, subreddit string"))
    assert sorted((r.subreddit, r.title, r.selftext, r.locale) for r in posts.collect()) == [("unknown", "", "", None), ("unknown", "t", "", None)]
    assert rejects.collect() == []


# -- detector on a stream --------------------------------------------------------
DOCS = "doc_id long, text string"


def test_a_new_word_version_takes_effect(spark, tmp_path):
    words, src, root = (str(tmp_path / x) for x in ("words", "docs", "out"))
    text = "yaaron kumaar yaaron plain words here"
    cue = [t for t in ("yaaron", "kumaar") if spark.range(1).select(CM.romanised_cue(F.lit(t)).alias("c")).first().c]
    assert cue

    def land(i):
        spark.createDataFrame([(i, text), (i + 1, None)], DOCS).coalesce(1).write.mode("append").parquet(src)

    def drain():
        return {r.doc_id: r for r in ST.tag_stream(ST.read_stream(spark, src, DOCS), words, root=root, clean=False).collect()}
    FS.publish_replacing(spark.createDataFrame([("plain",)], "word string"), words)
    land(1)
    first = drain()
    want = CM.detect_code_mixing(spark.createDataFrame([(1, text)], DOCS), FS.read_current(spark, words), "doc_id").first()
    assert first[1].cm_ratio == want.cm_ratio > 0 and first[1].words_version == 1
    assert (first[2].cm_ratio, first[2].is_cm) == (0.0, False)
    FS.publish_replacing(spark.createDataFrame([("plain",), *((t,) for t in cue)], "word string"), words)
    land(3)
    second = drain()
    assert second[3].words_version == 2 and second[3].cm_ratio < first[1].cm_ratio
    assert second[1] == first[1]


# -- late rows -----------------------------------------------------------------
def test_kept_and_late_rows_make_the_input(spark, tmp_path):
    src, root = str(tmp_path / "events"), str(tmp_path / "late")

    def drain():
        return ST.run_available(ST.rates_with_late_rows(ST.read_stream(spark, src, ST.EVENT_SCHEMA)), "late", root=root,
                                state_store=ST.STATE_STORE).collect()
    _events(spark, [(1, 0), (2, 30), (3, 70), (4, 300)], src)
    first = drain()
    assert sorted((r.window_start, r.n) for r in first if not r.late) == [(T0, 2), (T0 + dt.timedelta(hours=1), 1)]
    spark.createDataFrame([(9, None, 1, "a", 1.0, None)], ST.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    _events(spark, [(5, 10), (6, 100), (7, 310), (8, 900)], src)
    last = drain()
    late = {r.event_id: r.ts for r in last if r.late}
    assert set(late) == {5, 6, 9} and late[5] == T0 + dt.timedelta(minutes=10) and late[9] is None
    kept = sum(r.n for r in last if not r.late)
    # the window of the last event is still open
    assert kept + len(late) == 9 - 1
    assert sorted(map(str, drain())) == sorted(map(str, last))


def test_a_window_closes_when_the_watermark_meets_its_end(spark, tmp_path):
    for k, (ms, closed) in enumerate([(0, True), (-1, False)]):
        src, root = str(tmp_path / f"events{k}"), str(tmp_path / f"late{k}")
        rows = [(1, T0, 1, "a", 1.0, None), (2, T0 + dt.timedelta(hours=2, milliseconds=ms), 1, "a", 1.0, None)]
        spark.createDataFrame(rows, ST.EVENT_SCHEMA).coalesce(1).write.parquet(src)
        out = ST.run_available(ST.rates_with_late_rows(ST.read_stream(spark, src, ST.EVENT_SCHEMA)), "late", root=root,
                               state_store=ST.STATE_STORE)
        assert [(r.window_start, r.n) for r in out.collect()] == ([(T0, 1)] if closed else [])
