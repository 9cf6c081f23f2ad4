"""Perceptron, skip-gram and co-occurrence vectors, parameter search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varieta.operators import ml as ML
from varieta.operators import vectors as V
from varieta.operators.mlp import Perceptron, predict_perceptron, train_perceptron
from varieta.session import cut_lineage


def _texts(spark, n=160, seed=3):
    """Sentences in which alfa and bravo stand in the same places, and other
    words at random."""
    rng = random.Random(seed)
    filler = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(12):
            words += ["red", rng.choice(["alfa", "bravo"]), "blue"] + [rng.choice(filler) for _ in range(4)]
        rows.append((i, " ".join(words), i % 2))
    return spark.createDataFrame(rows + [(n, None, 0), (n + 1, "", 1), (n + 2, "?!", 1)], "id long, text string, label int")


# -- perceptron ----------------------------------------------------------------
def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    net = Perceptron([4, 5, 3], [0, 1, 2])
    x, y, w = rng.normal(size=(7, 4)), rng.integers(0, 3, 7), rng.random(7)
    flat = net.flat()
    _, grad = net.gradient(x, y, w)
    for i in rng.choice(len(flat), 12, replace=False):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        up, down = (net.with_flat(flat + s).gradient(x, y, w)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - grad[i]) < 1e-5


def test_perceptron_learns_what_no_line_splits(spark):
    rng = np.random.default_rng(2)
    points = rng.uniform(-1, 1, (400, 2))
    rows = [(i, [float(a), float(b)], int((a > 0) != (b > 0)), 1.0) for i, (a, b) in enumerate(points)]
    df = cut_lineage(spark.createDataFrame(rows + [(999, None, 1, 1.0), (1000, [0.1, 0.1], None, 1.0)], "id long, embedding array<double>, label int, weight double"))
    net = train_perceptron(df, hidden=(12,), rounds=120)
    got = predict_perceptron(net, df, ["id", "label"]).collect()
    right = [r.prediction == r.label for r in got if r.label is not None and r.id != 999]
    assert sum(right) / len(right) > 0.93
    assert [r.prediction for r in got if r.id == 999] == [None]
    again = train_perceptron(df.repartition(5), hidden=(12,), rounds=120)
    assert np.allclose(net.flat(), again.flat(), atol=1e-6)


def test_weights_change_the_answer(spark):
    rows = [([1.0], int(i < 10), 9.0 if heavy and i < 10 else 1.0, heavy) for heavy in (0, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "embedding array<double>, label int, weight double, heavy int")
    got = []
    for heavy in (0, 1):
        part = cut_lineage(df.where(F.col("heavy") == heavy))
        got.append(predict_perceptron(train_perceptron(part, hidden=(2,), rounds=60), part, []).first().prediction)
    assert got == [0, 1]


# -- vectors ---------------------------------------------------------------------
def test_vocabulary_is_bounded_and_ordered(spark):
    df = spark.createDataFrame([("b b a a c d d d", ), (None,)], "text string")
    got = [(r.id, r.word, r.n) for r in V.vocabulary(df, min_count=2, max_words=2).orderBy("id").collect()]
    assert got == [(0, "d", 3), (1, "a", 2)]


@pytest.mark.parametrize("chunk", [1, 500_000])
def test_cooccurrence_equals_brute_force(spark, chunk):
    texts = ["a b c a x b", None, "b b", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "word string, id int")
    want: dict = {}
    for t in texts:
        ids = ["abc".index(w) for w in (t or "").split() if w in "abc"]
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if i != j and abs(i - j) <= 2:
                    want[a, b] = want.get((a, b), 0) + 1 / abs(i - j)
    got = {(r.a, r.b): r.x for r in V.cooccurrence(df, vocab, window=2, chunk_words=chunk).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_glove_loss_falls_and_synonyms_meet(spark):
    docs = _texts(spark)
    model = V.train_glove(docs, dim=12, rounds=4, min_count=1)
    assert all(b <= a + 1e-9 for a, b in zip(model.losses, model.losses[1:])) and model.losses[-1] < 0.8 * model.losses[0]
    near = dict(V.nearest_words(model, "alfa", len(model.words)))
    others = [near[w] for w in model.words if w.startswith("w")]
    assert near["bravo"] > max(others)


def test_skip_gram_synonyms_meet_and_norms(spark):
    docs = _texts(spark)
    model = V.train_word2vec(docs, dim=16, rounds=6, min_count=1)
    near = dict(V.nearest_words(model, "alfa", len(model.words)))
    assert near["bravo"] > np.mean([near[w] for w in model.words if w.startswith("w")])
    assert len(V.train_word2vec(docs, dim=4, rounds=1, min_count=1, max_words=3).words) <= 3
    for df in (V.document_vectors(docs, model, ["id"]), V.projected_vectors(docs, ["id"])):
        norms = {r.id: float(np.linalg.norm(r.embedding)) for r in df.collect()}
        assert len(norms) == 163 and all(abs(n - (0 if i >= 160 else 1)) < 1e-9 for i, n in norms.items())


def test_vectors_without_words(spark):
    none = spark.createDataFrame([(1, None)], "id long, text string")
    for model in (V.train_glove(none, dim=4, rounds=1), V.train_word2vec(none, dim=4)):
        assert model.words == []
        assert V.document_vectors(none, model, ["id"]).first().embedding == [0.0] * 4


# -- search ---------------------------------------------------------------------
def test_random_search_equals_an_exhaustive_loop(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["good", "fine", "cat", "dog"] if i % 2 else ["bad", "poor", "cat", "dog"]) for _ in range(3)), i % 2)
            for i in range(120)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    space = {"regParam": [0.0, 0.5, 50.0], "elasticNetParam": [0.0, 1.0]}
    params = ML.sample_params(space, 99, seed=1)
    assert len(params) == 6 and ML.sample_params(space, 99, seed=1) == params and len(ML.sample_params(space, 2)) == 2
    at_once = ML.search_params(df, params, folds=2, num_features=256, max_iter=10)
    one_by_one = [ML.search_params(df.repartition(3), [p], folds=2, num_features=256, max_iter=10, parallel=1)[0] for p in params]
    want = sorted(one_by_one, key=lambda x: -x[1])
    assert [p for p, _ in at_once] == [p for p, _ in want]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(at_once, want))
    drawn = ML.sample_params({"regParam": (1e-4, 1.0), "elasticNetParam": [0.0]}, 50, seed=2)
    assert all(1e-4 <= p["regParam"] <= 1.0 for p in drawn) and len({p["regParam"] for p in drawn}) == 50
