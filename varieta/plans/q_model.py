"""Registered join, language-id and Spark ML queries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import langid as LID
from ..operators import metrics as M
from ..session import read_table
from . import bindings as B
from .q_metrics import r6
from .registry import query


# D1 ------------------------------------------------------------------------
def _translations(spark, sf):
    d = read_table(spark, sf, "documents").where(F.col("lang") != "es")
    return d.select(F.col("doc_id").alias(" id"),
                    F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string"))
                    .otherwise(F.concat(F.lit("[tr] "), "text")).alias("text "),
                    (F.col("n_chars") % 2).cast("int").alias(" label "),
                    F.lit(False).alias("is_cm "))


def merge_translations_q(spark, sf):
    a = B.ann(spark, sf)
    base = a.select("id", "text", F.col("sentiment_label").alias("label"), (F.col("n_chars") % 2 == 0).alias("is_cm"))
    m = J.merge_translations(base, _translations(spark, sf))
    return m.select("id", F.md5("text").alias("text_md5"), "label", "is_cm")


query("merge_translations", f"""WITH {B.ANN_CTE},
base AS (SELECT id, text, sentiment_label AS label, n_chars % 2 = 0 AS is_cm FROM ann),
tr AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE '[tr] ' || text END AS text,
              CAST(n_chars % 2 AS INTEGER) AS label, FALSE AS is_cm FROM documents WHERE lang <> 'es')
SELECT b.id, md5(CASE WHEN b.is_cm AND t.id IS NOT NULL THEN t.text ELSE b.text END) AS text_md5,
       CASE WHEN b.is_cm AND t.id IS NOT NULL THEN t.label ELSE b.label END AS label,
       CASE WHEN b.is_cm AND t.id IS NOT NULL THEN t.is_cm ELSE b.is_cm END AS is_cm
FROM base b LEFT JOIN tr t ON b.id = t.id""")(merge_translations_q)


# D2 ------------------------------------------------------------------------
def join_by_position_q(spark, sf):
    data = B.ann(spark, sf).select("id", F.col("sentiment_label").alias("label"))
    preds = B.preds(spark, sf, ("m1",)).where(F.col("task") == "Sentiment") \
        .select(F.col("id").alias("pid"), "prediction")
    j = J.join_by_position(data, preds, "id", "pid")
    return j.select("id", "label", "prediction")


query("join_by_position", f"""WITH {B.preds_cte(('m1',))},
d AS (SELECT id, sentiment_label AS label, row_number() OVER (ORDER BY id) AS pos FROM ann),
p AS (SELECT prediction, row_number() OVER (ORDER BY id) AS pos FROM preds WHERE task = 'Sentiment')
SELECT d.id, d.label, p.prediction FROM d JOIN p ON d.pos = p.pos""")(join_by_position_q)


# J6 ------------------------------------------------------------------------
def language_probability_q(spark, sf):
    d = read_table(spark, sf, "documents")
    model, langs = LID.train_nb(d, "text", "lang")
    s = LID.language_scores(d, "doc_id", "text", model, langs)
    best = s.groupBy("doc_id").agg(F.max_by("lang", F.struct("score", "lang")).alias("pred_lang"),
                                   F.max(F.when(F.col("lang") == "en", F.col("prob"))).alias("p_en"))
    return best.select("doc_id", "pred_lang", F.round("p_en", 4).alias("p_en"))


LP_CTE = """pt AS (SELECT doc_id, lang, ' ' || lower(text) || ' ' AS t FROM documents),
g AS (SELECT doc_id, lang, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM pt),
counts AS (SELECT lang, gram, count(*) AS c FROM g GROUP BY ALL),
v AS (SELECT count(DISTINCT gram) AS V FROM counts),
tot AS (SELECT lang, sum(c) AS N FROM counts GROUP BY lang),
nd AS (SELECT lang, count(*) AS nd FROM documents GROUP BY lang),
langs AS (SELECT tot.lang, ln(CAST(nd.nd AS DOUBLE) / (SELECT sum(nd) FROM nd)) AS prior,
                 -ln(tot.N + v.V) AS unseen, tot.N, v.V FROM tot JOIN nd ON tot.lang = nd.lang, v),
model AS (SELECT c.gram, c.lang, ln(c.c + 1) - ln(l.N + l.V) AS logp FROM counts c JOIN langs l ON c.lang = l.lang),
dg AS (SELECT doc_id, gram, count(*) AS k FROM g GROUP BY ALL),
total AS (SELECT doc_id, sum(k) AS G FROM dg GROUP BY doc_id),
matched AS (SELECT dg.doc_id, m.lang, sum(dg.k * (m.logp - l.unseen)) AS m FROM dg JOIN model m ON dg.gram = m.gram
            JOIN langs l ON l.lang = m.lang GROUP BY ALL),
s AS (SELECT t.doc_id, l.lang, l.prior + t.G * l.unseen + coalesce(mt.m, 0.0) AS score
      FROM total t CROSS JOIN langs l LEFT JOIN matched mt ON mt.doc_id = t.doc_id AND mt.lang = l.lang),
z AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM s),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id) AS prob,
             row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang DESC) AS rk FROM z)"""
LP_FINAL = """SELECT doc_id, max(CASE WHEN rk = 1 THEN lang END) AS pred_lang,
       round(max(CASE WHEN lang = 'en' THEN prob END), 4) AS p_en FROM p GROUP BY doc_id"""
query("language_probability", f"WITH {LP_CTE} {LP_FINAL}")(language_probability_q)


# Trained models -------------------------------------------------------
# The texts carry words of a label with even classes (bindings.planted), so
# that a right model must reach F1 >= FLOOR; the SQL counts each cell's rows.
# A penalty keeps words of single texts from standing for their label.
FLOOR, REG = 0.9, 0.02
# Logistic regression stops after few rounds in the search; well above even odds.
SEARCH_FLOOR = 0.6


def _planted_rows(spark, sf):
    from .q_dataset import splits
    return B.planted(splits(spark, sf).withColumn("label", B.coin_label()))


COUNTS = "word_counts"


def _planted_counts(spark, sf, num_features: int = 1 << 16):
    """The same rows with the texts' word counts in ``COUNTS`` instead of the
    texts: every model reads those, so texts are tokenised once, not once a
    pass of each model."""
    from ..operators import ml as ML
    from ..session import cut_lineage
    return cut_lineage(ML.with_word_counts(_planted_rows(spark, sf), COUNTS, num_features=num_features))


def _split_cte():
    from .q_dataset import SPLIT_CTE
    return SPLIT_CTE


TASKS = ("Sarcasm", "Sentiment")


def _floor(f1="f1_score"):
    return (F.col(f1) >= FLOOR).alias("f1_ok")


def train_text_classifier_q(spark, sf):
    """One model per task, scored on all held-out rows by variety."""
    from ..operators import ml as ML
    s = _planted_counts(spark, sf, 1 << 18)
    parts = []
    for task in TASKS:
        of = s.where(F.col("task") == task)
        model = ML.train_text_classifier(of.where(F.col("split") == "train"), "svm", max_iter=30, reg=REG, counts_col=COUNTS)
        parts.append(ML.predict(model, of.where(F.col("split") != "train"), "tfidf-svm", ["id", "task", "variety", "label"]))
    f1 = M.macro_prf(reduce(DataFrame.unionByName, parts), ["model", "task", "variety"])
    return f1.select("model", "task", "variety", F.col("n").cast("long").alias("n"), _floor())


query("train_text_classifier", f"""WITH {_split_cte()}
SELECT 'tfidf-svm' AS model, task, variety, CAST(count(*) AS BIGINT) AS n, TRUE AS f1_ok
FROM splits WHERE split <> 'train' GROUP BY task, variety""")(train_text_classifier_q)


# model x features of the study's argument lists
TEXT_MODELS = (("nn", "tfidf"), ("nn", "w2v"), ("svm", "glove"), ("lr", "w2v"), ("svm", "tfidf"))


def text_models_q(spark, sf):
    """Every kind of model and of features on the Sentiment task.  Rows are
    planted and written once; vectors of one kind are learned once, and each
    row's written once, for all models.  A fit is many short jobs: those of
    the kinds of features run at the same time."""
    from ..operators import ml as ML
    from ..operators import vectors as VEC
    from ..session import cut_lineage
    keep, dim = ["id", "label"], 32
    s = cut_lineage(_planted_rows(spark, sf).where(F.col("task") == "Sentiment").select(*keep, "split", "text"))

    def part(rows, of_train):
        return rows.where((F.col("split") == "train") == of_train)

    def fitted(kind, embed, rows, **options):
        model = ML.train_text_classifier(part(rows, True), kind, max_iter=40, embed=embed, dim=dim, reg=0.02, **options)
        return ML.predict(model, part(rows, False), f"{embed}-{kind}", keep).select(*keep, "prediction", "model")

    def on_counts():
        rows = cut_lineage(ML.with_word_counts(s, COUNTS))
        return [fitted(k, "tfidf", rows, counts_col=COUNTS) for k, e in TEXT_MODELS if e == "tfidf" and k != "nn"]

    def on_vectors(embed, rows, **options):
        embedder = ML.document_embedder(part(rows, True), embed, dim=dim, **options)
        rows = cut_lineage(embedder(rows, [*keep, "split"]))
        return [fitted(k, embed, rows, embedder=ML.given_vectors) for k, e in TEXT_MODELS if e == embed and (k == "nn" or e != "tfidf")]

    def on_words():
        corpus = VEC.read_words(part(s, True))
        ids = cut_lineage(VEC.word_ids(s, corpus.words, [*keep, "split"]))
        corpus.over(part(ids, True))
        return [m for e in ("w2v", "glove") for m in on_vectors(e, ids, ids_col="_ids", corpus=corpus, rounds=2)]
    jobs = (on_words, on_counts, lambda: on_vectors("tfidf", s))
    with ThreadPoolExecutor(len(jobs)) as pool:
        done = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]
    f1 = M.macro_prf(reduce(DataFrame.unionByName, [m for d in done for m in d]), ["model"])
    return f1.select("model", F.col("n").cast("long").alias("n"), _floor())


query("text_models", f"""WITH {_split_cte()}
SELECT m.model, CAST(count(*) AS BIGINT) AS n, TRUE AS f1_ok
FROM splits, (VALUES {', '.join(f"('{e}-{k}')" for k, e in TEXT_MODELS)}) m(model)
WHERE split <> 'train' AND task = 'Sentiment' GROUP BY m.model""")(text_models_q)


ONE_CLASS = "fewer than two classes to train on"


def _per_part(s, by: str):
    """Train one model per task and value of ``by``, score every held-out row
    of the task: (predictions with the trained value, cells without a model)."""
    from ..operators import ml as ML
    tests, train = s.where(F.col("split") != "train"), s.where(F.col("split") == "train")
    classes = s.groupBy("task", by).agg(F.count_distinct(F.when(F.col("split") == "train", F.col("label"))).alias("n")).orderBy("task", by)
    cells = classes.collect()  # one row per model to train

    def one(cell):
        task, value, n = cell
        of = tests.where(F.col("task") == task)
        if n < 2:
            return None, of.groupBy("task", "variety", "domain").agg(F.count("*").alias("n")).withColumn("trained", F.lit(value))
        m = ML.train_text_classifier(train.where((F.col("task") == task) & (F.col(by) == value)), "svm", max_iter=20, reg=REG, counts_col=COUNTS)
        return ML.predict(m, of, value, ["id", "task", "variety", "domain", "label"]).withColumnRenamed("model", "trained"), None
    # a fit is many short jobs: a few run at a time
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(inheritable_thread_target(s.sparkSession)(one), cells))
    scored, none = ([d[k] for d in done if d[k] is not None] for k in (0, 1))
    return [reduce(DataFrame.unionByName, x) if x else None for x in (scored, none)]


def _matrix(s, by: str, cell: list[str]):
    scored, none = _per_part(s, by)
    parts = []
    if scored is not None:
        f1 = M.macro_prf(scored, ["task", "trained", *cell])
        parts.append(f1.select("task", "trained", *cell, F.col("n").cast("long").alias("n"), _floor(), F.lit(None).cast("string").alias("reason")))
    if none is not None:
        parts.append(none.groupBy("task", "trained", *cell).agg(F.sum("n").alias("n"))
                     .select("task", "trained", *cell, "n", F.lit(None).cast("boolean").alias("f1_ok"), F.lit(ONE_CLASS).alias("reason")))
    return reduce(DataFrame.unionByName, parts)


def _matrix_sql(by: str, cell: str) -> str:
    return f"""WITH {_split_cte()},
c AS (SELECT task, {by} AS trained, count(DISTINCT CASE WHEN split = 'train' THEN {B.COIN_SQL} END) AS classes FROM splits GROUP BY task, {by})
SELECT c.task, c.trained, {cell}, CAST(count(*) AS BIGINT) AS n, CASE WHEN max(classes) >= 2 THEN TRUE END AS f1_ok,
  CASE WHEN max(classes) < 2 THEN '{ONE_CLASS}' END AS reason
FROM c JOIN splits s ON s.task = c.task WHERE s.split <> 'train' GROUP BY c.task, c.trained, {cell}"""


def cross_variety_matrix_q(spark, sf):
    """Train one model per task and variety, score every held-out row of the
    task: a cell for each (task, trained, tested).  The row ``PT`` holds the
    model that saw no variety's labels in particular: trained on all of them.
    A variety whose train part has one class has no model; its cells stay,
    with the reason."""
    from ..operators import ml as ML
    s = _planted_counts(spark, sf)
    own = _matrix(s, "variety", ["variety"])
    parts = []
    for task in TASKS:
        of = s.where(F.col("task") == task)
        m = ML.train_text_classifier(of.where(F.col("split") == "train"), "svm", max_iter=20, reg=REG, counts_col=COUNTS)
        parts.append(ML.predict(m, of.where(F.col("split") != "train"), "PT", ["task", "variety", "label"]))
    pt = M.macro_prf(reduce(DataFrame.unionByName, parts).withColumnRenamed("model", "trained"), ["task", "trained", "variety"])
    return own.unionByName(pt.select("task", "trained", "variety", F.col("n").cast("long").alias("n"), _floor(),
                                     F.lit(None).cast("string").alias("reason"))).withColumnRenamed("variety", "tested")


query("cross_variety_matrix", f"""SELECT task, trained, variety AS tested, n, f1_ok, reason FROM ({_matrix_sql("variety", "variety")})
UNION ALL SELECT task, 'PT', tested, n, TRUE, NULL FROM (WITH {_split_cte()}
  SELECT task, variety AS tested, CAST(count(*) AS BIGINT) AS n FROM splits WHERE split <> 'train' GROUP BY task, variety)""")(cross_variety_matrix_q)


def cross_domain_matrix_q(spark, sf):
    """A cell for each (task, train domain, variety, test domain)."""
    return _matrix(_planted_counts(spark, sf), "domain", ["variety", "domain"]).withColumnRenamed("trained", "train_domain").withColumnRenamed("domain", "test_domain")


query("cross_domain_matrix", f"""SELECT task, trained AS train_domain, variety, domain AS test_domain, n, f1_ok, reason
FROM ({_matrix_sql("domain", "variety, domain")})""")(cross_domain_matrix_q)


# --- fixed values: varieties of the outer circle; all others are inner ones
OUTER_CIRCLE = ("de", "es")


def variety_identification_q(spark, sf):
    """Inner circle = 0 vs outer = 1: is the mean probability of the own class
    above one half, by (variety, domain)."""
    from ..operators import ml as ML
    from ..operators import split as SP
    a = B.ann(spark, sf).withColumn("label", F.col("variety").isin(*OUTER_CIRCLE).cast("int"))
    s = SP.stratified_split3(B.planted(a), ["domain"], "label", "id")
    m = ML.train_text_classifier(s.where(F.col("split") == "train"), "lr", max_iter=20, reg=REG)
    p = ML.predict(m, s.where(F.col("split") != "train"), "variety-lr", ["id", "variety", "domain", "label"])
    own = F.element_at("probability", F.col("label") + 1)
    return p.groupBy("variety", "domain").agg((F.avg(own) > 0.5).alias("own_class_likelier"), F.count("*").alias("n"))


query("variety_identification", f"""WITH {B.ANN_CTE},
a AS (SELECT *, CASE WHEN variety IN ({', '.join(f"'{v}'" for v in OUTER_CIRCLE)}) THEN 1 ELSE 0 END AS label FROM ann),
r AS (SELECT *, row_number() OVER (PARTITION BY domain, label ORDER BY md5(CAST(id AS VARCHAR) || '7'), id) - 1 AS rk,
             count(*) OVER (PARTITION BY domain, label) AS n FROM a
      WHERE id IS NOT NULL AND text IS NOT NULL AND domain IS NOT NULL)
SELECT variety, domain, TRUE AS own_class_likelier, CAST(count(*) AS BIGINT) AS n
FROM r WHERE rk >= floor(n * 0.7) GROUP BY variety, domain""")(variety_identification_q)


def param_search_q(spark, sf):
    """Grid and random search on each task: how many parameter sets were
    tried, and whether the best one reaches the floor."""
    from ..operators import ml as ML
    s = _planted_counts(spark, sf).where(F.col("split") == "train")
    rows = []
    for task in TASKS:
        of = s.where(F.col("task") == task)
        grid = ML.param_search(of, regs=(0.02, 0.1), counts_col=COUNTS)
        rows.append((task, "grid", len(grid), max(f1 for _, f1 in grid) >= SEARCH_FLOOR))
        tried = ML.search_params(of, ML.sample_params({"regParam": (1e-2, 1e-1), "elasticNetParam": [0.0]}, 3), folds=2, max_iter=20, counts_col=COUNTS)
        rows.append((task, "random", len(tried), tried[0][1] >= SEARCH_FLOOR))
    return spark.createDataFrame(rows, "task string, search string, n_tried long, f1_ok boolean")


query("param_search", """SELECT task, search, CAST(n AS BIGINT) AS n_tried, TRUE AS f1_ok
FROM (VALUES ('Sarcasm'), ('Sentiment')) t(task), (VALUES ('grid', 2), ('random', 3)) s(search, n)""")(param_search_q)


def embed_text_q(spark, sf):
    from ..operators import ml as ML
    d = read_table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    e = ML.embed_text(d)
    return e.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6)
                    .alias("norm_sq"))


query("embed_text", """SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[A-Za-z0-9_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm_sq
FROM documents""")(embed_text_q)


def _length_model():
    import numpy as np

    def run(texts):
        return (texts.fillna("").str.len().to_numpy() > 2000).astype(np.int32)
    return lambda s: __import__("pandas").Series(run(s))


def batch_infer_q(spark, sf):
    from ..operators import ml as ML
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    out = ML.batch_infer(d, "text", _length_model, "length-stub", "1")
    return out.select("doc_id", "prediction", "model", "model_version")


query("batch_infer", """SELECT doc_id, CASE WHEN length(text) > 2000 THEN 1 ELSE 0 END AS prediction,
       'length-stub' AS model, '1' AS model_version FROM documents""")(batch_infer_q)


# E5 with J6: dataset card including mean English probability ---------------
def dataset_card_langprob_q(spark, sf):
    from .q_dataset import STRATA, splits
    d = read_table(spark, sf, "documents")
    model, langs = LID.train_nb(d, "text", "lang")
    p_en = LID.language_scores(d, "doc_id", "text", model, langs).where(F.col("lang") == "en") \
        .select(F.col("doc_id").alias("id"), F.col("prob").alias("p_en"))
    s = splits(spark, sf).join(p_en, "id")
    return s.groupBy(*STRATA).agg(
        *[F.count_if(F.col("split") == x).cast("long").alias(f"n_{x}") for x in ("train", "valid", "test")],
        F.round(F.avg("label"), 6).alias("positive_rate"), F.round(F.avg("p_en"), 4).alias("mean_p_en"))


def _card_sql():
    from .q_dataset import SPLIT_CTE
    return f"""WITH {SPLIT_CTE}, {LP_CTE},
pe AS (SELECT doc_id AS id, prob AS p_en FROM p WHERE lang = 'en')
SELECT task, variety, domain,
  CAST(count_if(split = 'train') AS BIGINT) AS n_train, CAST(count_if(split = 'valid') AS BIGINT) AS n_valid,
  CAST(count_if(split = 'test') AS BIGINT) AS n_test, round(avg(label), 6) AS positive_rate,
  round(avg(pe.p_en), 4) AS mean_p_en
FROM splits JOIN pe ON splits.id = pe.id GROUP BY task, variety, domain"""


query("dataset_card_langprob", _card_sql())(dataset_card_langprob_q)
