"""Plan-shape and invariant checks for the scale devices: scan spreading,
outer generators (no tokeniser pushed to the scan) and one-pass language
scores."""

import math

from pyspark.sql import functions as F

from varieta.functions import codemix as CM
from varieta.operators import langid as LID
from varieta.session import SPREAD, read_table


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_spread_is_the_users_choice(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, f"t{i}") for i in range(100)], "doc_id long, text string").coalesce(1).write.parquet(path)
    assert "Exchange" not in _plan(read_table(spark, str(tmp_path), "documents"))
    spark.conf.set(SPREAD, "6")
    try:
        out = read_table(spark, str(tmp_path), "documents")
        assert "Exchange hashpartitioning(doc_id" in _plan(out)
        assert sorted(r[0] for r in out.collect()) == list(range(100))
    finally:
        spark.conf.unset(SPREAD)


def test_generators_do_not_push_the_tokeniser_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "bhai yaar kya scene hai"), (2, ""), (3, "plain english words here")],
                          "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    common = spark.createDataFrame([("words",)], "word string")
    flags = CM.token_flags(docs, "doc_id", "text", common)
    grams = LID.doc_grams(docs, "doc_id", "text")
    for df in (flags, grams):
        scan = [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n")
                if "FileScan" in line or "Scan parquet" in line]
        assert scan and not any("regexp_extract_all" in line for line in scan)
    assert {r["doc_id"] for r in flags.collect()} == {1, 3}


def test_language_scores_normalise_per_document(spark):
    train = spark.createDataFrame(
        [(i, t, lang) for i, (t, lang) in enumerate(
            [("the cat and the dog", "en"), ("the house is big", "en"), ("le chat et le chien", "fr"),
             ("la maison est grande", "fr")] * 3)], "doc_id long, text string, lang string")
    model, langs = LID.train_nb(train, "text", "lang")
    test = spark.createDataFrame([(100, "the big dog"), (101, "le grand chien"), (102, "x")],
                                 "doc_id long, text string")
    s = LID.language_scores(test, "doc_id", "text", model, langs).collect()
    by_doc = {}
    for r in s:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {100, 101, 102}
    for rows in by_doc.values():
        assert {r["lang"] for r in rows} == {"en", "fr"}
        assert math.isclose(sum(r["prob"] for r in rows), 1.0, abs_tol=1e-12)
    best = {d: max(rows, key=lambda r: r["score"])["lang"] for d, rows in by_doc.items()}
    assert best[100] == "en" and best[101] == "fr"


def test_romanised_cue_equals_the_fixed_pattern(spark):
    import random
    from varieta.functions import patterns as P
    rnd = random.Random(5)
    alphabet = "abcdeghijklnosuwy'-"
    tokens = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    tokens += list(P.ROMANISED_MARKERS) + list(P.ROMANISED_ENDINGS) + ["wala-x", "xna", "nax", ""]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    diff = df.where(F.col("t").rlike(P.ROMANISED_CUE) != CM.romanised_cue(F.col("t")))
    assert diff.count() == 0


def test_language_scores_are_the_same_by_both_joins(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "la maison", "fr"), (4, "the house", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, langs = LID.train_nb(docs, "text", "lang")

    def scores(limit):
        got = LID.language_scores(docs, "doc_id", "text", model, langs, broadcast_grams=limit)
        return {(r.doc_id, r.lang): round(r.prob, 9) for r in got.collect()}
    assert scores(0) == scores(10**6) and len(scores(0)) == 8
