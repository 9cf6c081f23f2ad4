"""Spark ML re-aims of the modelling work.

The reference fine-tunes transformers on GPUs; what a Spark user builds on
the same data is a Spark ML pipeline: tokenise, hash, IDF, a linear model
with class weights.  Training is distributed by Spark ML; scoring adds a
``model`` column so many models are evaluated with one grouped metric job.
"""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product
from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import vectors as VEC
from .metrics import class_weights
from .mlp import Perceptron, predict_perceptron, train_perceptron


def text_features(text_col: str = "text", num_features: int = 1 << 18):
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern="\\W+", toLowercase=True)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="features")
    return [tok, tf, idf]


def classifier_features(text_col: str = "text", num_features: int = 1 << 18, counts_col: str | None = None):
    """TF-IDF scaled to length 1 per text: a long text weighs no more than a
    short one, as linear text models expect (their features are not scaled
    one by one, which would favour rare words).  With ``counts_col`` the words
    are already counted (``with_word_counts``)."""
    tok, tf, idf = text_features(text_col, num_features)
    weigh = [idf.setOutputCol("_idf"), Normalizer(inputCol="_idf", outputCol="features")]
    return [idf.setInputCol(counts_col), *weigh[1:]] if counts_col else [tok, tf, *weigh]


def with_word_counts(df: DataFrame, out: str, text_col: str = "text", num_features: int = 1 << 18) -> DataFrame:
    """``df`` with the hashed word counts of its texts in ``out`` instead of
    the texts.  Texts are the same for every model, fold and parameter: where
    many are trained, count once and write the rows."""
    tok, tf, _ = text_features(text_col, num_features)
    return tf.setOutputCol(out).transform(tok.transform(df)).drop(text_col, "_tokens")


def with_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """E4 weights attached as ``weight`` (the weight table has one row per
    class — bounded by the label set — and is broadcast)."""
    w = class_weights(df, label)
    return df.join(F.broadcast(w), label)


EMBEDS = ("tfidf", "w2v", "glove")
KINDS = ("lr", "svm", "nn")


@dataclass
class VectorTextModel:
    """A classifier on dense document vectors: ``vectors(df, keep, text)``
    makes them, ``classifier`` is a Spark ML model or a ``Perceptron``."""
    vectors: Callable[[DataFrame, Sequence[str]], DataFrame]
    classifier: object


def document_embedder(train: DataFrame, embed: str, text_col: str = "text", dim: int = 32, ids_col: str | None = None,
                      **options) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """A function (rows, keep columns) -> keep columns and ``embedding``, with
    vectors learned from ``train``: skip-gram or co-occurrence vectors averaged
    per document, or TF-IDF reduced to ``dim`` features.  ``ids_col``: the rows
    carry their texts as word numbers (``vectors.word_ids``) of the ``corpus``
    that the options give."""
    if embed == "tfidf":
        idf = VEC.hashed_idf(train, text_col)
        return lambda df, keep: VEC.projected_vectors(df, keep, text_col, dim, len(idf), idf=idf)
    if embed not in EMBEDS:
        raise ValueError(f"unknown embedding {embed!r}: use one of {', '.join(EMBEDS)}")
    fit = VEC.train_word2vec if embed == "w2v" else VEC.train_glove
    model = fit(train, text_col, dim=dim, **options)
    return lambda df, keep: VEC.document_vectors(df, model, keep, text_col, ids_col=ids_col)


def given_vectors(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The embedder of rows that carry their ``embedding`` already: vectors
    that several models read are made and written once."""
    return df.select(*keep, "embedding")


def train_text_classifier(train: DataFrame, kind: str = "lr", text_col: str = "text",
                          label: str = "label", reg: float = 0.0, elastic_net: float = 0.0,
                          max_iter: int = 50, tol: float = 1e-6, num_features: int = 1 << 18,
                          embed: str = "tfidf", dim: int = 64, hidden: Sequence[int] = (16,), seed: int = 7,
                          counts_col: str | None = None, embedder: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None, **options):
    """A class-weighted text classifier.

    ``kind``: logistic regression (lr), linear SVM (svm) or a multilayer
    perceptron (nn).  ``embed``: TF-IDF (sparse for lr and svm, reduced to
    ``dim`` dense features for nn), skip-gram (w2v) or co-occurrence (glove)
    vectors, learned from the same rows.  ``counts_col``: word counts of rows
    that ``with_word_counts`` made, for lr and svm on TF-IDF.  ``embedder``:
    what ``document_embedder`` learned from the same rows, where several
    models share it."""
    if kind not in KINDS:
        raise ValueError(f"unknown model type {kind!r}; use one of {', '.join(KINDS)}")
    data = with_class_weights(train, label)
    linear = {"lr": lambda: LogisticRegression(labelCol=label, weightCol="weight", regParam=reg, elasticNetParam=elastic_net,
                                               maxIter=max_iter, tol=tol,
                                               standardization=False),
              "svm": lambda: LinearSVC(labelCol=label, weightCol="weight", regParam=reg, maxIter=max_iter, tol=tol, standardization=False)}
    if embed == "tfidf" and kind in linear:
        return Pipeline(stages=classifier_features(text_col, num_features, counts_col) + [linear[kind]()]).fit(data)
    embedder = embedder or document_embedder(train, embed, text_col, dim, **options)
    rows = cut_lineage(embedder(data, [label, "weight"]))   # read once a round
    if kind == "nn":
        return VectorTextModel(embedder, train_perceptron(rows, label=label, hidden=hidden, seed=seed, rounds=max_iter))
    return VectorTextModel(embedder, linear[kind]().fit(rows.withColumn("features", array_to_vector("embedding"))))


def predict(model, df: DataFrame, name: str, keep: Sequence[str]) -> DataFrame:
    if isinstance(model, VectorTextModel):
        rows = model.vectors(df, keep)
        if isinstance(model.classifier, Perceptron):
            return predict_perceptron(model.classifier, rows, keep, name=name)
        out = model.classifier.transform(rows.withColumn("features", array_to_vector("embedding")))
    else:
        out = model.transform(df)
    cols = [F.col("prediction").cast("int").alias("prediction"), F.lit(name).alias("model")]
    if "probability" in out.columns:
        cols.append(vector_to_array("probability").alias("probability"))
    return out.select(*keep, *cols)


def sample_params(space: dict[str, object], n: int, seed: int = 7) -> list[dict]:
    """``n`` parameter maps from ``space``: a list is a set of choices, a pair
    (low, high) a range drawn evenly in the logarithm.  Choices alone are drawn
    without repeats, so ``n`` above their number gives every combination."""
    rng = random.Random(seed)
    names = sorted(space)
    if all(isinstance(space[k], list) for k in names):
        every = [dict(zip(names, values)) for values in product(*[space[k] for k in names])]
        rng.shuffle(every)
        return every[:n]

    def draw(x):
        return rng.choice(x) if isinstance(x, list) else math.exp(rng.uniform(math.log(x[0]), math.log(x[1])))
    return [{k: draw(space[k]) for k in names} for _ in range(n)]


def search_params(train: DataFrame, params: Sequence[dict], text_col: str = "text", label: str = "label", id_col: str = "id",
                  folds: int = 3, parallel: int = 4, num_features: int = 1 << 16, max_iter: int = 30,
                  counts_col: str | None = None) -> list[tuple[dict, float]]:
    """(parameters, mean validation F1) of each map of logistic-regression
    parameters (names as Spark ML's), best first, ties in the order given.

    Folds follow from the md5 of the id: the same rows however the table is
    laid out.  A fold's features are made and written once for all maps, and
    ``parallel`` fits run at a time.  A fold whose training rows hold fewer
    than two classes, or that has no validation rows, is left out.

    Words are counted once for all folds, or before (``counts_col``)."""
    if not counts_col:
        counts_col = "_tf"
        train = _written_counts(train, counts_col, text_col, label, id_col, num_features)
    digest = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long")
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    scores: dict[int, list[float]] = {k: [] for k in range(len(params))}
    for fold in range(folds):
        held = digest % folds == fold
        fit_rows, test_rows = train.where(~held), train.where(held)
        if fit_rows.select(label).distinct().limit(2).count() < 2 or not test_rows.limit(1).count():
            continue
        features = Pipeline(stages=classifier_features(counts_col=counts_col)).fit(fit_rows)
        data = cut_lineage(features.transform(with_class_weights(fit_rows, label)).select(label, "weight", "features"))
        test = cut_lineage(features.transform(test_rows).select(label, "features"))

        def one(k):
            clf = LogisticRegression(labelCol=label, weightCol="weight", maxIter=max_iter, standardization=False)
            fitted = clf.fit(data, {clf.getParam(name): value for name, value in params[k].items()})
            return judge.evaluate(fitted.transform(test))
        with ThreadPoolExecutor(parallel) as pool:
            for k, f1 in enumerate(pool.map(inheritable_thread_target(train.sparkSession)(one), range(len(params)))):
                scores[k].append(f1)
    ranked = [(params[k], sum(s) / len(s)) for k, s in scores.items() if s]
    return sorted(ranked, key=lambda x: -x[1])


def _written_counts(rows: DataFrame, out: str, text_col: str, label: str, id_col: str, num_features: int) -> DataFrame:
    return cut_lineage(with_word_counts(rows.select(id_col, label, text_col), out, text_col, num_features))


def param_search(train: DataFrame, text_col: str = "text", label: str = "label", id_col: str = "id",
                 regs: Sequence[float] = (0.0, 0.1), counts_col: str | None = None) -> list[tuple[float, float]]:
    """Grid search, (reg, weighted F1) for each value.  A quarter of the
    rows, by the md5 of their id, validates: the same rows however the table
    is laid out.  Words are counted once, or before (``counts_col``, 2^16
    features); weights and features are made and written once for all values."""
    if not counts_col:
        counts_col = "_tf"
        train = _written_counts(train, counts_col, text_col, label, id_col, 1 << 16)
    lr = LogisticRegression(labelCol=label, weightCol="weight", maxIter=30, standardization=False)
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    held = F.substring(F.md5(F.col(id_col).cast("string")), 1, 1).isin("0", "1", "2", "3")
    features = Pipeline(stages=classifier_features(counts_col=counts_col)).fit(train.where(~held))
    data = cut_lineage(features.transform(with_class_weights(train.where(~held), label)).select(label, "weight", "features"))
    test = cut_lineage(features.transform(train.where(held)).select(label, "features"))
    return [(reg, judge.evaluate(lr.fit(data, {lr.regParam: reg}).transform(test))) for reg in regs]


def embed_text(df: DataFrame, text_col: str = "text", num_features: int = 1 << 12) -> DataFrame:
    """Text -> unit vector (TF-IDF + L2 normalisation) as ARRAY<DOUBLE>."""
    stages = text_features(text_col, num_features) + [Normalizer(inputCol="features", outputCol="_u")]
    fitted = Pipeline(stages=stages).fit(df)
    return fitted.transform(df).withColumn("embedding", vector_to_array("_u")) \
        .drop("_tokens", "_tf", "features", "_u")


def batch_infer(df: DataFrame, text_col: str, loader: Callable[[], Callable[[pd.Series], pd.Series]],
                model_name: str, version: str, out_type: str = "int") -> DataFrame:
    """Apply any Python model to a text column with Arrow batches.
    ``loader`` runs once per task, before its first batch; the model is never
    shipped with the rows."""
    def infer(batches):
        model = loader()
        for texts in batches:
            yield model(texts)
    infer.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    infer = F.pandas_udf(infer, out_type)

    return df.withColumn("prediction", infer(F.col(text_col))) \
        .withColumn("model", F.lit(model_name)).withColumn("model_version", F.lit(version))
