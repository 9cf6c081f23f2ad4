"""text_models: passes over texts, skip-gram over counted pairs, packed rounds."""

import numpy as np
from pyspark.sql import functions as F

from varieta.operators import ml as ML
from varieta.operators import mlp
from varieta.operators import vectors as V

TEXTS = ["a b c a x b", None, "", "b b", "a", "c a. B  c-d", "É é_1 d d d a", "a b c a x b"]


def _docs(spark, parts=3):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(parts)


def test_word_numbers_are_those_of_the_words(spark):
    docs = _docs(spark)
    corpus = V.read_words(docs, min_count=2)
    assert corpus.seen == docs.select(F.sum(F.size(V.words_of()))).first()[0] == corpus.counts.sum() + 2   # é and é_1 stand once
    want = {r.id: [corpus.words.index(w) for w in r.w if w in corpus.words] for r in docs.select("id", V.words_of().alias("w")).collect()}
    assert {r.id: r.n for r in V.word_ids(docs, corpus.words, ["id"], out="n").collect()} == want
    model = V.GloveModel(corpus.words, np.random.default_rng(1).normal(size=(len(corpus.words), 3)), [])
    by_text = {r.id: r.embedding for r in V.document_vectors(docs, model, ["id"]).collect()}
    by_id = {r.id: r.embedding for r in V.document_vectors(V.word_ids(docs, corpus.words, ["id"]), model, ["id"], ids_col="_ids").collect()}
    assert by_text == by_id and by_text[1] == [0.0] * 3
    mean = model.vectors[want[0]].mean(axis=0)
    assert np.allclose(by_text[0], mean / np.linalg.norm(mean))


def test_pair_weights_equal_brute_force_in_any_chunks_and_blocks(spark):
    docs = _docs(spark)
    corpus = V.read_words(docs, min_count=1)
    ids = V.word_ids(docs, corpus.words, ["id"])
    want: dict = {}
    for r in ids.collect():
        for i, a in enumerate(r._ids):
            for j, b in enumerate(r._ids):
                if 0 < abs(i - j) <= 3:
                    x, y = want.get((a, b), (0.0, 0.0))
                    want[a, b] = (x + 1 / abs(i - j), y + (4 - abs(i - j)) / 3)
    for chunk in (1, 7, 500_000):
        got = {(r.a, r.b): (r.x, r.y) for r in V.word_pairs(ids, len(corpus.words), window=3, chunk_words=chunk).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
    packed = corpus.over(ids).pairs(3, 4).collect()
    assert corpus.pairs(3) is corpus.pairs(3, 9)   # written once
    assert sum(len(set(r.a)) for r in packed) == len({a for a, _ in want})   # a word lies in one block
    assert {(a, b): (x, y) for r in packed for a, b, x, y in zip(r.a, r.b, r.x, r.y)} == got


def test_skip_gram_counts_every_pair_and_its_objective_never_falls(spark):
    docs = _docs(spark)
    corpus = V.read_words(docs, min_count=1)
    corpus.over(V.word_ids(docs, corpus.words, ["id"]))
    n = len(corpus.words)
    y = np.zeros((n, n))
    for r in corpus.pairs(2).collect():
        y[r.a, r.b] = r.y
    noise = y.sum(axis=1) ** 0.75 / (y.sum(axis=1) ** 0.75).sum()
    seen = []
    real = V.Word2Vec._step

    def watched(self, spark_, pairs, mine, other, scale, weight):
        out = real(self, spark_, pairs, mine, other, scale, weight)
        s, drawn = out @ other.T, scale[:, None] * weight[None, :]
        seen.append((y * np.logaddexp(0, -s)).sum() + (drawn * np.logaddexp(0, s)).sum()
                    + 0.05 * ((out ** 2).sum() + (other ** 2).sum()))
        assert np.allclose(drawn, 5 * np.outer(y.sum(axis=1), noise)) or np.allclose(drawn, 5 * np.outer(noise, y.sum(axis=1)))
        return out
    V.Word2Vec._step = watched
    try:
        a = V.Word2Vec(vectorSize=3, windowSize=2, maxIter=6).fit(corpus)
        assert all(after <= before + 1e-6 for before, after in zip(seen[1:], seen[2:])) and seen[-1] < seen[1]
        again = V.read_words(docs.repartition(5), min_count=1)
        again.over(V.word_ids(docs.repartition(5), again.words))
        assert np.allclose(a.vectors, V.Word2Vec(vectorSize=3, windowSize=2, maxIter=6, numPartitions=3).fit(again).vectors, atol=1e-3)
    finally:
        V.Word2Vec._step = real


def test_vectors_of_one_corpus_are_those_of_its_texts(spark):
    docs = _docs(spark)
    corpus = V.read_words(docs)
    corpus.over(V.word_ids(docs, corpus.words, ["id"]))
    for fit in (V.train_glove, V.train_word2vec):
        a, b = fit(docs, dim=4, rounds=2), fit(docs, dim=4, rounds=2, corpus=corpus)
        assert a.words == b.words == corpus.words and np.allclose(a.vectors, b.vectors, atol=1e-3)   # negatives are summed in single precision


def test_text_models_reads_its_texts_a_few_times(spark, tmp_path, monkeypatch):
    from varieta.plans import q_model as Q
    rows = [(i, f"text {i % 7} of {i}", "en", "src1", 300 + i) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    asked = []
    real = V.words_of
    monkeypatch.setattr(V, "words_of", lambda *a: asked.append(a) or real(*a))
    got = {r.model: (r.n, r.f1_ok) for r in Q.text_models_q(spark, str(tmp_path)).collect()}
    n = 300 - 2 * 105
    assert got == {f"{e}-{k}": (n, True) for k, e in Q.TEXT_MODELS}
    assert len(asked) == 4   # words counted, written as numbers, weighed by rarity, projected


def test_perceptron_reads_its_rows_once_for_all_rounds(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b
    rows = spark.createDataFrame([([float(i % 2), 1.0], i % 2, 1.0) for i in range(40)], "embedding array<double>, label int, weight double")
    net = mlp.train_perceptron(rows.mapInArrow(counted, rows.schema), rounds=30)
    assert reads.value <= 4 * 40   # classes, width, weight, packing
    assert [r.prediction for r in mlp.predict_perceptron(net, rows.orderBy("label").limit(1), []).collect()] == [0]
    assert ML.given_vectors(rows, ["label"]).columns == ["label", "embedding"]
