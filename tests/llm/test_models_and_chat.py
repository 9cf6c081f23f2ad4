"""Learned operators on held-out rows, page extraction, chat round trips, the
registered SQL and the pipeline."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varieta.llm import chat, html, quality, queries, toxicity
from varieta.llm.common import lowest_hashes

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"


# -- quality ---------------------------------------------------------------
def test_quality_sample_is_bounded(spark):
    """A third of the rows without id, a third one repeated row."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    texts = docs.select(F.lit(None).cast("long"), F.concat("text", F.lit(" x")))
    same = spark.range(1000).select(F.lit(7).cast("long"), F.lit("one text that stands in many rows of the table"))
    assert lowest_hashes(docs.union(texts).union(same), 200).count() == 200
    got = quality.quality_scores(docs.union(texts).union(same), sample_rows=200)
    assert got.count() == 2 * docs.count() + 1000


def test_quality_agrees_with_labels(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    got = quality.quality_scores(docs).join(labels, "doc_id").select("keep", labels["quality"].alias("y")).collect()
    right = sum(r.keep == (r.y == 1) for r in got)
    assert right >= 0.97 * len(got)


def test_label_model_finds_bad_labeller():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    good = [np.where(rng.random(4000) < 0.95, np.where(truth, 1, 2), np.where(truth, 2, 1)) for _ in range(3)]
    bad = rng.integers(1, 3, 4000)
    rows, counts = np.unique(np.stack([*good, bad], 1), axis=0, return_counts=True)
    prior, table = quality.fit_label_model(rows, counts.astype(float))
    assert abs(prior - 0.8) < 0.05
    assert table[1][0][1] > 0.9 and table[0][0][2] > 0.85 and abs(table[1][3][1] - 0.5) < 0.1


def test_quality_odd_rows(spark):
    rows = [(1, None, 0.5), (1, None, 0.5), (None, "", 0.1), (2, "word " * 20_000, 1.0), (3, "Plain words stand here, in a short text.", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality double")
    got = quality.quality_scores(df).collect()
    assert len(got) == 5 and all(0 <= r.quality <= 1 for r in got)
    kept = quality.quality_scores(df, keep_columns=True)
    assert kept.columns == df.columns
    assert quality.quality_scores(df.limit(0)).collect() == []


# -- toxicity --------------------------------------------------------------
def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = labels.where("doc_id % 4 != 0")
    got = toxicity.toxicity_scores(docs, seen).join(labels.where("doc_id % 4 = 0").select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    caught = sum(r.toxic for r in got if r.y) / sum(r.y for r in got)
    false = sum(r.toxic for r in got if not r.y) / sum(1 - r.y for r in got)
    assert caught >= 0.9 and false <= 0.03
    assert all(0 <= r.severity <= 3 and (r.severity > r.p_toxic - 1e-9) for r in got)


def test_ordinal_regression_shares_weights():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 2))
    s = 6 * x[:, 0] + 0 * x[:, 1] + rng.logistic(size=3000) * 0.5
    grade = np.digitize(s, [2, 3.5, 5])
    doc, col = np.nonzero(np.ones_like(x))
    m = toxicity.OrdinalModel({}, 2).fit(doc, col, x[doc, col], grade, ridge=0)
    assert m.w[0] > 4 * abs(m.w[1]) and (np.diff(m.thresholds()) > 0).all()
    above = m.above(x @ m.w)
    assert (np.diff(above, axis=1) <= 0).all()
    assert np.corrcoef(above.sum(1), s)[0, 1] > 0.8


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 1), (2, "idiot " * 9, 1), (2, "idiot " * 9, 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(2, 1), (2, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(docs, labels).count() == 4
    assert toxicity.toxicity_scores(docs, labels.limit(0)).where("toxic").count() == 0
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


# -- pages -----------------------------------------------------------------
def test_leaf_blocks_by_hand():
    page = ("<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p>'</script></head><body><!-- x --><p>One&nbsp;"
            "<b>two</b>thr<i>ee</i><br>four &amp; &lt;five&#x41;<p>six</p><div class='ad box'>seven<ul><li>a<li>b</ul></div>"
            "<noscript>no</noscript>tail<textarea>form</textarea></body>")
    assert html.leaf_blocks(page) == [
        (("html", "body", "p"), "One twothree"), (("html", "body", "p"), "four & <fiveA"), (("html", "body", "p"), "six"),
        (("html", "body", "div.ad.box"), "seven"), (("html", "body", "div.ad.box", "ul", "li"), "a"),
        (("html", "body", "div.ad.box", "ul", "li"), "b"), (("html", "body"), "tail")]


def test_leaf_blocks_after_self_closed_images_and_open_heads():
    body = [(("html", "body", "p"), "one"), (("html", "body", "p"), "two")]
    for empty in ("<svg class='i' width=\"1\" />", "<svg/>", "<math />"):
        assert html.leaf_blocks(f"<html><body><p>one</p>{empty}<p>two</p></body></html>") == body
        assert html.leaf_blocks(f"<html><body><p>one</p>{empty}<p>two</p><svg><text>no</text></svg><math><mi>x</mi></math></body>") == body
    assert html.leaf_blocks("<html><head><title>T</title><meta charset=x><body><p>one</p><p>two") == body
    assert html.leaf_blocks("<head><link rel=a><script>x()</script><style>p{}</style>\n<h1>one</h1>two") == [(("h1",), "one"), ((), "two")]
    assert html.leaf_blocks("<head><title>T</title>one <img src=x> two") == [((), "one two")]


def test_leaf_blocks_of_odd_tags_and_comments():
    def texts(page):
        return [t for _, t in html.leaf_blocks(page)]
    assert texts("<p class=it's>Hello world</p><p>I don't know</p>") == ["Hello world", "I don't know"]
    assert texts("<!--><p>text</p>") == texts("<!---><p>text</p>") == texts("<!-- x --!><p>text</p>") == ["text"]
    assert texts("<!-- <p>no</p> --><p>text</p><!-- never ends <p>no</p>") == ["text"]
    assert texts('<p title="x>one</p>') == ["one"] and texts("<p title='x>one</p><p>two") == ["one", "two"]
    assert texts('<p title="a > b" data-x=\'<i>\'>one</p>') == ["one"]
    assert texts("<svg><path d=x><p>one</p>two") == ["one", "two"]
    assert texts("<svg><foreignObject><p>no</p></foreignObject></svg><p>two") == ["two"]
    assert texts("one</ x>two<//>three<a href=x/>four</a> a < b") == ["onetwothreefour a < b"]
    assert html.leaf_blocks("<div class = ad  ID='b c'\n hidden = \"\">one</div><div class=x/>two") \
        == [(("div.ad.b.c.hidden",), "one"), (("div.x",), "two")]
    long = "<p a='" * 30_000
    assert texts(long + "x") == [] and texts('<p a="' * 30_000 + ">x") == ["x"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(
    ["<p>", "</p>", "<div class=it's>", "</div>", "<b title='a>b'>", "</b>", "<br/>", "<li x=\"1\" y>", "<!--x-->", "<!-->", "<!--a--!>", "</ >",
     "<img src=a/>", "<svg><g>x</g></svg>", "<svg/>", "<td =a>", "</table>", "<h1 a = \"it's\" >", "<a href=x/y?z>", "&amp;", "<span a=''b=\"\">", "W", "W", "W"])))
def test_every_visible_word_lands_in_a_block(parts):
    page, words = "", []
    for k, part in enumerate(parts):
        if part == "W":
            words.append(f"word{k}.")
        page += words[-1] if part == "W" else part
    found = "".join(t for _, t in html.leaf_blocks(page)).replace(" ", "").replace("&", "")
    assert found == "".join(words)


def test_stretches_cover_long_pages_to_their_ends():
    for n in (1, 255, 256, 257, 1000, 2048, 100_000):
        cut = html.stretches(n)
        assert cut[0].start == 0 and cut[-1].stop == n and len(cut) <= html.TRAIN_STRETCHES
        assert all(0 < c.stop - c.start <= html.TRAIN_BLOCKS for c in cut)
        if n <= html.TRAIN_STRETCHES * html.TRAIN_BLOCKS:
            assert [c.start for c in cut[1:]] == [c.stop for c in cut[:-1]]


def test_every_word_of_a_block_counts():
    table = html.Features()
    a, b = (html.page_features([(("p",), " ".join(["w"] * 400 + [w] * 400))], table) for w in ("x", "y"))
    assert not np.array_equal(a, b)


def test_samples_are_bounded_with_repeated_and_null_rows(spark):
    rows = [(None, None, "same")] * 1000 + [(None, None, f"t{k}") for k in range(1000)] + [(k, "u", "same") for k in range(1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, hash string").repartition(5)
    got = [tuple(r) for r in lowest_hashes(df, 300).collect()]
    assert len(got) == len(set(got)) == 300 and len(set(lowest_hashes(df, 5000).collect())) == 2001
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in lowest_hashes(df.repartition(2), 300).collect())
    assert lowest_hashes(df.limit(0), 300).collect() == []


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    m = html.BlockLabeller()
    x, mask, y = html.pad([rng.normal(size=(4, html.DIMS)), rng.normal(size=(2, html.DIMS))], [np.array([1, 0, 1, 0]), np.array([0, 1])])

    def loss():
        p = m.scores(x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()
    g = m.gradients(x, mask, y)
    for k, at in (("Wf", (3, 5)), ("Wb", (40, 33)), ("bf", (20,)), ("bb", (50,)), ("V", (7,)), ("V", (25,)), ("Wf", (90, 60)), ("Wb", (88, 10))):
        keep = m.p[k][at]
        m.p[k][at] = keep + 1e-5
        up = loss()
        m.p[k][at] = keep - 1e-5
        down = loss()
        m.p[k][at] = keep
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6


@pytest.fixture(scope="module")
def page_model(spark):
    return html.train(spark.read.parquet(f"{SF}/pages.parquet"))


def test_extraction_leaves_furniture_out(page_model):
    words = "these are the plain words of the article and they go on for a while".split()
    para = [" ".join(words[i:] + words[:i]) for i in range(8)]
    page = ("<html><body><header class='masthead'><div>Site name</div></header><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
            "<div class='cookie notice'><p>We use cookies here</p></div><aside class='sidebar'><p>Latest posts for you</p></aside><article><h1>Title of it</h1>"
            + "".join(f"<p>{p}</p>" for p in para) + "<div class='ad'>Buy now</div><form><label>Mail</label><button>Go</button></form></article>"
            "<section class='comments'><div class='comment'><p>First reader says hello</p></div></section><footer>&copy; us</footer></body></html>")
    assert html.main_text([page, None, "", "<p>"], page_model) == [" ".join(["Title of it", *para]), "", "", ""]


def test_extraction_of_driver_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    inner = F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1)
    plain = F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", " "), "&quot;", '"')
    want = F.trim(F.regexp_replace(F.replace(plain, F.lit("&amp;"), F.lit("&")), r"\s+", " "))
    got = html.extract_pages(pages.withColumn("text", F.lit(1))).join(pages.select("page_id", want.alias("want"), "html"), "page_id")
    assert got.where("text != want and html not rlike '&(amp|am|a|q|qu|quo|quot)(<|$| )'").count() == 0
    assert got.where("n_chars != length(text)").count() == 0
    assert html.extract_pages(pages.limit(0)).count() == 0


# -- chat ------------------------------------------------------------------
TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", r"<\|end|> \ \\ [\\INST] <\\/s>", "<s><s></s>[[INST]]",
         "line\nbreak\r\n\ttab", "<|image|> é 漢字 😀", "$1 \\$2", "<|", "|>", "[", "a<"]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in ("<|turn|>", "<|text|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]"))


def test_digest_reads_back_every_turn(spark):
    rows = [(1, i, ("user", "assistant", None, "a\nb")[i % 4], t) for i, t in enumerate(TEXTS)]
    rows += [(2, 0, "assistant", None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, None, "user", "nobody")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    turns = df.withColumn("parts", chat.text_parts(F.col("text")))
    got = {r.conv_id: r for r in chat.chat_digest(chat.format_chats(turns)).collect()}
    for c in (1, 2, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c), key=lambda v: v[0])
        want = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own)
        if c != 2:
            assert got[c].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_typed_parts(spark):
    parts = [("text", "see <|image|> ", None, None, None, None, None), ("image", None, "s3://a/1.png", 56, 57, None, None),
             ("audio", None, "b.wav", None, None, 2.01, None), ("text", " end", None, None, None, None, None),
             ("document", None, "c.pdf", None, None, None, 3)]
    df = spark.createDataFrame([(1, 0, "user", parts, "z"), (1, 1, "assistant", [("image", None, "d", None, None, None, None)], "z"),
                                (1, 2, "assistant", None, "z"), (1, 3, "user", [], "z")],
                               f"conv_id long, turn long, role string, parts {chat.PART_TYPE}, attachments string")
    r = chat.format_chats(df).first()
    assert r.formatted.startswith("<|turn|>user<|text|>see <\\|image|> <|image|><|audio|> end<|document|><|end|>")
    assert [(a.turn, a.kind, a.uri, a.tokens) for a in r.attachments] == [
        (0, "image", "s3://a/1.png", 6), (0, "audio", "b.wav", 51), (0, "document", "c.pdf", 768), (1, "image", "d", 0)]
    assert r.expanded_tokens == 825 and r.n_turns == 4
    assert [r.formatted[s.start:s.start + s.length] for s in r.loss_spans] == ["<|image|>", ""]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_plan_is_native(spark):
    plan = queries.op2_chat_formatting(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


# -- registered ------------------------------------------------------------
@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.QUERIES.items() if sql])
def test_registered_sql(spark, name):
    import duckdb
    from tools.oracle_check import TABLES, digest
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    build, sql = queries.QUERIES[name]
    df = build(spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    assert digest(df.columns, rows)[0] == digest(cols, res.fetchall())[0]


def test_pipeline(spark):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF)
        if k < len(p.STAGES) - 1:
            assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < out.count() <= n
        docs = out
    assert sorted(map(str, p.run(spark, SF).collect())) == sorted(map(str, docs.collect()))


def test_queries_run_where_workers_do_not_find_the_package(tmp_path):
    """The operators that broadcast a model, run from a folder away from the
    repository and without it on PYTHONPATH."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    names = ["op3_embedding_near_dedup", "op7_lm_scoring", "op8_quality_classifier", "op9_decontamination"]
    code = f"""
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as E
from varieta.session import build_session, checkpoint_dir
spark = build_session("local[2]", shuffle_partitions=2)
checkpoint_dir(spark, {str(tmp_path / "shared")!r})
for name in {names!r}:
    print(name, E.queries()[name](spark, E.SMOKE_DIR).count() > 0)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    for name in names:
        assert f"{name} True" in got.stdout, got.stderr[-2000:]
