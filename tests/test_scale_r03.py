"""Steps of long jobs that once cost time per character, per model or in one task."""

import sys

from pyspark.sql import functions as F

from varieta.functions import patterns as P
from varieta.functions import text as T
from varieta.operators import langid as LID
from varieta.operators import ml as ML
from varieta.operators import vectors as V


def test_jvm_spellings_match_what_the_portable_ones_do(spark):
    points = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["é" + "".join(f"a{c}" for c in points[i:i + 2000]) for i in range(0, len(points), 2000)]
    texts += ["é 1️⃣ ⃣ \U0001F468‍\U0001F469‍\U0001F467 क्‍ष ©️", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    c = F.col("text")
    assert df.where(~T.remove_emoji(c).eqNullSafe(F.regexp_replace(c, P.EMOJI_SEQUENCE, ""))).count() == 0
    one = df.where(c.isNotNull()).select(F.explode(F.split(c, "a")).alias("x"))
    assert one.where(F.col("x").rlike(P.REPAIR_TRIGGER) != F.col("x").rlike(P.REPAIR_TRIGGER_JVM)).count() == 0
    assert P.EMOJI_SEQUENCE_JVM != P.EMOJI_SEQUENCE


def test_grams_are_counted_per_text_not_per_character(spark):
    rows = [(1, "aaab"), (2, None), (3, ""), (4, "x\U0001F600y"), (1, "AB")]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = LID.gram_counts(docs, "id", "text")
    assert got.count() == got.select("id", "key", "G").distinct().count()
    seen = sorted((r.id, r.G, r.gram, r.k) for r in got.select("id", "G", LID.key_gram(F.col("key"), 3).alias("gram"), "k").collect())
    assert seen == sorted([(1, 4, " aa", 1), (1, 4, "aaa", 1), (1, 4, "aab", 1), (1, 4, "ab ", 1), (1, 2, " ab", 1), (1, 2, "ab ", 1),
                           (4, 3, " x\U0001F600", 1), (4, 3, "x\U0001F600y", 1), (4, 3, "\U0001F600y ", 1)])
    assert got.where(LID.gram_key(LID.key_gram(F.col("key"), 3), 3) != F.col("key")).count() == 0
    long = LID.gram_counts(docs, "id", "text", 5).collect()
    assert sorted((r.key, r.k) for r in long) == [(" aaab", 1), (" x\U0001F600y ", 1), ("aaab ", 1)]


def test_texts_longer_than_a_piece_keep_all_grams(spark, monkeypatch):
    monkeypatch.setattr(LID, "PIECE_CHARS", 4)
    docs = spark.createDataFrame([(1, "abcabcabcabc")], "id long, text string")
    got = LID.gram_counts(docs, "id", "text").agg(F.sum("k"), F.max("G")).first()
    assert tuple(got) == (12, 12)


def _labelled(spark):
    rows = [(i, ("good fine nice " if i % 2 else "bad poor sad ") * (1 + i % 3), i % 2) for i in range(40)]
    return spark.createDataFrame(rows, "id long, text string, label int")


def test_models_on_word_counts_are_those_on_texts(spark):
    df = _labelled(spark)
    counts = ML.with_word_counts(df, "n_words", num_features=64)
    assert "text" not in counts.columns
    for kind in ("lr", "svm"):
        a = ML.predict(ML.train_text_classifier(df, kind, max_iter=5, num_features=64), df, "m", ["id"])
        b = ML.predict(ML.train_text_classifier(counts, kind, max_iter=5, counts_col="n_words"), counts, "m", ["id"])
        assert sorted(a.select("id", "prediction").collect()) == sorted(b.select("id", "prediction").collect())


def test_shared_embedder_is_not_learned_again(spark, monkeypatch):
    df = _labelled(spark)
    embedder = ML.document_embedder(df, "w2v", dim=8, min_count=1, rounds=1)
    monkeypatch.setattr(V, "train_word2vec", None)
    model = ML.train_text_classifier(df, "lr", embed="w2v", max_iter=5, embedder=embedder)
    assert ML.predict(model, df, "m", ["id", "label"]).count() == 40


def test_skip_gram_partitions_follow_the_words(spark, monkeypatch):
    used = []
    real = V.Word2Vec

    def watched(**kw):
        used.append(kw["numPartitions"])
        return real(**kw)
    monkeypatch.setattr(V, "Word2Vec", watched)
    df = _labelled(spark)
    V.train_word2vec(df, dim=4, rounds=1)
    monkeypatch.setattr(V, "PART_WORDS", 100)
    model = V.train_word2vec(df, dim=4, rounds=1)
    n = df.select(F.sum(F.size(V.words_of()))).first()[0]
    assert used == [1, -(-n // 100)] and len(model.words) == 6
