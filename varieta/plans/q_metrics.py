"""Registered metric queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..session import read_table
from . import bindings as B
from .registry import query
from .sqlgen import class_counts_sql, per_class_sql


def r6(c: str):
    return F.round(F.col(c).cast("double"), 6).alias(c)


def big(c: str):
    return F.col(c).cast("long").alias(c)


LB_GROUP = ["model", "task", "variety", "domain"]
TASKS = ("Sarcasm", "Sentiment")


# ---------------------------------------------------------------- E9 ------
def macro_prf_q(spark, sf):
    out = M.macro_prf(B.preds(spark, sf), ["model", "task", "variety"])
    return out.select("model", "task", "variety", r6("precision"), r6("recall"),
                      r6("f1_score"), big("n"), r6("accuracy"))


MACRO_PRF_SQL = f"""WITH {B.preds_cte()},
pc AS ({per_class_sql(class_counts_sql('preds', ['model', 'task', 'variety']))})
SELECT model, task, variety, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(f1), 6) AS f1_score, CAST(sum(support) AS BIGINT) AS n,
       round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy
FROM pc GROUP BY model, task, variety"""
query("macro_prf", MACRO_PRF_SQL)(macro_prf_q)


# ---------------------------------------------------------------- E22 -----
def leaderboard_q(spark, sf):
    lb = M.macro_prf(B.preds(spark, sf), LB_GROUP)
    w = Window.partitionBy("task", "variety", "domain").orderBy(F.desc("f1_score"), "model")
    return lb.select(*LB_GROUP, r6("precision"), r6("recall"), r6("f1_score"), big("n"),
                     F.rank().over(w).cast("long").alias("rank"))


LEADERBOARD_SQL = f"""WITH {B.preds_cte()},
pc AS ({per_class_sql(class_counts_sql('preds', LB_GROUP))}),
lb AS (SELECT model, task, variety, domain, avg(precision) AS precision, avg(recall) AS recall,
              avg(f1) AS f1_score, sum(support) AS n FROM pc GROUP BY ALL)
SELECT model, task, variety, domain, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1_score, 6) AS f1_score, CAST(n AS BIGINT) AS n,
       CAST(rank() OVER (PARTITION BY task, variety, domain ORDER BY f1_score DESC, model) AS BIGINT) AS rank
FROM lb"""
query("leaderboard", LEADERBOARD_SQL)(leaderboard_q)


# ---------------------------------------------------------------- E8 ------
def classification_report_q(spark, sf):
    rep = M.classification_report(B.preds(spark, sf), ["model", "task"])
    return rep.select("model", "task", "row", r6("precision"), r6("recall"), r6("f1_score"),
                      big("support"))


CLASSIFICATION_REPORT_SQL = f"""WITH {B.preds_cte()},
pc AS ({per_class_sql(class_counts_sql('preds', ['model', 'task']))}),
s AS (SELECT model, task, CAST(sum(tp) AS DOUBLE) / sum(support) AS acc, sum(support) AS n,
             avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
             CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(precision * support) / sum(support) END AS wp,
             CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(recall * support) / sum(support) END AS wr,
             CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(f1 * support) / sum(support) END AS wf
      FROM pc GROUP BY model, task)
SELECT model, task, CAST(cls AS VARCHAR) AS row, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM pc
UNION ALL SELECT model, task, 'accuracy', NULL, NULL, round(acc, 6), CAST(n AS BIGINT) FROM s
UNION ALL SELECT model, task, 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(n AS BIGINT) FROM s
UNION ALL SELECT model, task, 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), CAST(n AS BIGINT) FROM s"""
query("classification_report", CLASSIFICATION_REPORT_SQL)(classification_report_q)


# ---------------------------------------------------------------- A10 -----
def report_text_q(spark, sf):
    rep = M.classification_report(B.preds(spark, sf), ["model", "task"])
    return M.report_text(rep, ["model", "task"])


REPORT_TEXT_SQL = CLASSIFICATION_REPORT_SQL.replace(
    "SELECT model, task, CAST(cls AS VARCHAR) AS row", "SELECT * FROM (SELECT model, task, CAST(cls AS VARCHAR) AS row", 1)
REPORT_TEXT_SQL = f"""WITH {B.preds_cte()},
pc AS ({per_class_sql(class_counts_sql('preds', ['model', 'task']))}),
s AS (SELECT model, task, CAST(sum(tp) AS DOUBLE) / sum(support) AS acc, sum(support) AS n,
             avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
             sum(precision * support) / sum(support) AS wp,
             sum(recall * support) / sum(support) AS wr,
             sum(f1 * support) / sum(support) AS wf
      FROM pc GROUP BY model, task)
SELECT model, task, CAST(cls AS VARCHAR) AS row,
       printf('%12s %9.2f %9.2f %9.2f %9d', CAST(cls AS VARCHAR), precision, recall, f1, CAST(support AS BIGINT)) AS line FROM pc
UNION ALL SELECT model, task, 'accuracy', printf('%12s %9s %9s %9.2f %9d', 'accuracy', '', '', acc, CAST(n AS BIGINT)) FROM s
UNION ALL SELECT model, task, 'macro avg', printf('%12s %9.2f %9.2f %9.2f %9d', 'macro avg', mp, mr, mf, CAST(n AS BIGINT)) FROM s
UNION ALL SELECT model, task, 'weighted avg', printf('%12s %9.2f %9.2f %9.2f %9d', 'weighted avg', wp, wr, wf, CAST(n AS BIGINT)) FROM s"""
query("report_text", REPORT_TEXT_SQL)(report_text_q)


# ---------------------------------------------------------------- E10 -----
def binary_prf_acc_q(spark, sf):
    out = M.binary_prf_acc(B.preds(spark, sf), ["model", "task"])
    return out.select("model", "task", r6("precision"), r6("recall"), r6("f1"), r6("accuracy"))


BINARY_PRF_ACC_SQL = f"""WITH {B.preds_cte()},
a AS (SELECT model, task, sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN prediction = 1 THEN 1 ELSE 0 END) AS pp,
             sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS ap,
             avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy
      FROM preds GROUP BY model, task)
SELECT model, task,
       round(CASE WHEN pp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / pp END, 6) AS precision,
       round(CASE WHEN ap = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / ap END, 6) AS recall,
       round(CASE WHEN pp + ap = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (pp + ap) END, 6) AS f1,
       round(CAST(accuracy AS DOUBLE), 6) AS accuracy
FROM a"""
query("binary_prf_acc", BINARY_PRF_ACC_SQL)(binary_prf_acc_q)


# ---------------------------------------------------------------- E11 -----
def weighted_f1_q(spark, sf):
    out = M.weighted_f1(B.preds(spark, sf), ["model", "task", "domain"])
    return out.select("model", "task", "domain", r6("precision"), r6("recall"), r6("f1_score"))


WEIGHTED_F1_SQL = f"""WITH {B.preds_cte()},
pc AS ({per_class_sql(class_counts_sql('preds', ['model', 'task', 'domain']))})
SELECT model, task, domain,
       round(sum(precision * support) / sum(support), 6) AS precision,
       round(sum(recall * support) / sum(support), 6) AS recall,
       round(sum(f1 * support) / sum(support), 6) AS f1_score
FROM pc GROUP BY model, task, domain"""
query("weighted_f1", WEIGHTED_F1_SQL)(weighted_f1_q)


# ---------------------------------------------------------------- E12 -----
def accuracy_q(spark, sf):
    return M.accuracy(B.preds(spark, sf), ["model", "variety"]).select(
        "model", "variety", r6("accuracy"))


ACCURACY_SQL = f"""WITH {B.preds_cte()}
SELECT model, variety, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM preds GROUP BY model, variety"""
query("accuracy", ACCURACY_SQL)(accuracy_q)


# ---------------------------------------------------------------- E1 / E2 -
def label_counts_q(spark, sf):
    return M.label_counts(B.task_rows(spark, sf), "label", ["task", "variety"]).select(
        "task", "variety", "label", big("n"))


LABEL_COUNTS_SQL = f"""WITH {B.TASKS_CTE}
SELECT task, variety, label, CAST(count(*) AS BIGINT) AS n FROM tasks GROUP BY task, variety, label"""
query("label_counts", LABEL_COUNTS_SQL)(label_counts_q)


def label_shares_q(spark, sf):
    return M.label_shares(B.task_rows(spark, sf), "label", ["task"]).select(
        "task", "label", big("n"), r6("pct"))


LABEL_SHARES_SQL = f"""WITH {B.TASKS_CTE},
c AS (SELECT task, label, count(*) AS n FROM tasks GROUP BY task, label)
SELECT task, label, CAST(n AS BIGINT) AS n,
       round(round(100.0 * n / sum(n) OVER (PARTITION BY task), 2), 6) AS pct FROM c"""
query("label_shares", LABEL_SHARES_SQL)(label_shares_q)


# ---------------------------------------------------------------- F4 ------
def share_of_total_q(spark, sf):
    c = M.label_counts(B.task_rows(spark, sf), "label", ["task", "domain"])
    return M.share_of_total(c, "n", ["task", "domain"]).select(
        "task", "domain", "label", big("n"), r6("share"))


SHARE_OF_TOTAL_SQL = f"""WITH {B.TASKS_CTE},
c AS (SELECT task, domain, label, count(*) AS n FROM tasks GROUP BY ALL)
SELECT task, domain, label, CAST(n AS BIGINT) AS n,
       round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY task, domain), 6) AS share FROM c"""
query("share_of_total", SHARE_OF_TOTAL_SQL)(share_of_total_q)


# ---------------------------------------------------------------- E4 ------
def class_weights_q(spark, sf):
    return M.class_weights(B.task_rows(spark, sf), "label", ["task"]).select(
        "task", "label", r6("weight"))


CLASS_WEIGHTS_SQL = f"""WITH {B.TASKS_CTE},
c AS (SELECT task, label, count(*) AS n FROM tasks GROUP BY task, label),
t AS (SELECT task, sum(n) AS total, count(*) AS k FROM c GROUP BY task)
SELECT c.task, c.label, round(CAST(t.total AS DOUBLE) / (2 * c.n), 6) AS weight
FROM c JOIN t ON c.task = t.task"""
query("class_weights", CLASS_WEIGHTS_SQL)(class_weights_q)


# ---------------------------------------------------------------- E7 ------
def confusion_matrix_q(spark, sf):
    lab = read_table(spark, sf, "labels")
    return M.confusion_matrix(lab, "quality", "toxic").select(
        F.col("a").alias("quality"), F.col("b").alias("toxic"), "n")


CONFUSION_MATRIX_SQL = """WITH v AS (SELECT DISTINCT x AS v FROM (
    SELECT quality AS x FROM labels UNION ALL SELECT toxic FROM labels) WHERE x IS NOT NULL),
cells AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL)
SELECT a.v AS quality, b.v AS toxic, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM v a JOIN v b ON TRUE LEFT JOIN cells c ON c.quality = a.v AND c.toxic = b.v"""
query("confusion_matrix", CONFUSION_MATRIX_SQL)(confusion_matrix_q)


# ---------------------------------------------------------------- E14 -----
def _pair_rows(spark, sf):
    t = B.task_rows(spark, sf)
    t = t.select("id", "task", *[B.flip_prediction("id", "label", F.lit(m)).alias(m) for m in B.MODELS],
                 "label")
    return t.select("task", F.expr("stack(3, 'label~m1', label, m1, 'm1~m2', m1, m2, "
                                   "'m2~m3', m2, m3)").alias("pair", "a", "b"))


def cohen_kappa_q(spark, sf):
    return M.cohen_kappa(_pair_rows(spark, sf), "a", "b", ["task", "pair"]).select(
        "task", "pair", r6("kappa"))


COHEN_KAPPA_SQL = f"""WITH {B.TASKS_CTE},
w AS (SELECT id, task, label, {B.flip_sql('id', 'label', "'m1'")} AS m1,
             {B.flip_sql('id', 'label', "'m2'")} AS m2, {B.flip_sql('id', 'label', "'m3'")} AS m3 FROM tasks),
base AS (SELECT task, 'label~m1' AS pair, label AS a, m1 AS b FROM w
         UNION ALL SELECT task, 'm1~m2', m1, m2 FROM w UNION ALL SELECT task, 'm2~m3', m2, m3 FROM w),
tot AS (SELECT task, pair, count(*) AS n, sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS agree FROM base GROUP BY ALL),
ma AS (SELECT task, pair, a AS v, count(*) AS na FROM base GROUP BY ALL),
mb AS (SELECT task, pair, b AS v, count(*) AS nb FROM base GROUP BY ALL),
pe AS (SELECT ma.task, ma.pair, sum(CAST(na AS DOUBLE) * nb) AS pp FROM ma JOIN mb
       ON ma.task = mb.task AND ma.pair = mb.pair AND ma.v = mb.v GROUP BY ALL),
k AS (SELECT tot.task, tot.pair, CAST(agree AS DOUBLE) / n AS po,
             coalesce(pp, 0.0) / (CAST(n AS DOUBLE) * n) AS pe FROM tot LEFT JOIN pe
             ON tot.task = pe.task AND tot.pair = pe.pair)
SELECT task, pair, round(CASE WHEN pe = 1.0 THEN NULL ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM k"""
query("cohen_kappa", COHEN_KAPPA_SQL)(cohen_kappa_q)


# ---------------------------------------------------------------- E15 -----
def weighted_ce_loss_q(spark, sf):
    e = B.emb(spark, sf).withColumn("logits", F.slice("embedding", 1, 2))
    w = M.class_weights(e, "label")
    j = e.join(w, "label")
    return M.weighted_ce_loss(j, "logits", "label", "weight", ["class10"]).select(
        "class10", r6("loss"))


WEIGHTED_CE_LOSS_SQL = f"""WITH {B.EMB_CTE},
c AS (SELECT label, count(*) AS n FROM emb GROUP BY label),
t AS (SELECT sum(n) AS total, count(*) AS k FROM c),
w AS (SELECT c.label, CAST(t.total AS DOUBLE) / (2 * c.n) AS weight FROM c, t),
z AS (SELECT e.class10, e.label, w.weight,
             CAST(e.embedding[1:2] AS DOUBLE[]) AS logits FROM emb e JOIN w ON e.label = w.label),
l AS (SELECT class10, weight,
             list_max(logits) + ln(list_sum(list_transform(logits, lambda v: exp(v - list_max(logits)))))
               - logits[label + 1] AS nll FROM z)
SELECT class10, round(sum(weight * nll) / sum(weight), 6) AS loss FROM l GROUP BY class10"""
query("weighted_ce_loss", WEIGHTED_CE_LOSS_SQL)(weighted_ce_loss_q)


# ---------------------------------------------------------------- E16 -----
def score_stats_q(spark, sf):
    d = read_table(spark, sf, "documents")
    return M.score_stats(d, "n_chars", ["lang"]).select("lang", big("n"), "mean", "std", "min",
                                                         "q25", "q50", "q75", "max")


SCORE_STATS_SQL = """SELECT lang, CAST(count(n_chars) AS BIGINT) AS n,
  round(avg(CAST(n_chars AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST(n_chars AS DOUBLE)), 4) AS std,
  round(CAST(min(n_chars) AS DOUBLE), 4) AS min,
  round(quantile_cont(CAST(n_chars AS DOUBLE), 0.25), 4) AS q25,
  round(quantile_cont(CAST(n_chars AS DOUBLE), 0.5), 4) AS q50,
  round(quantile_cont(CAST(n_chars AS DOUBLE), 0.75), 4) AS q75,
  round(CAST(max(n_chars) AS DOUBLE), 4) AS max
FROM documents GROUP BY lang"""
query("score_stats", SCORE_STATS_SQL)(score_stats_q)


# ---------------------------------------------------------------- E17 -----
def histogram_q(spark, sf):
    d = read_table(spark, sf, "documents")
    return M.histogram(d, "n_chars", ["lang"], bins=30).select(
        "lang", F.col("bin").cast("long").alias("bin"), r6("left"), r6("right"), "n")


HISTOGRAM_SQL = """WITH r AS (SELECT lang, CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi
                FROM documents GROUP BY lang),
b AS (SELECT d.lang, CASE WHEN r.hi = r.lo THEN 0 ELSE
             CAST(least(floor((CAST(d.n_chars AS DOUBLE) - r.lo) / ((r.hi - r.lo) / 30)), 29) AS INTEGER) END AS bin
      FROM documents d JOIN r ON d.lang = r.lang WHERE d.n_chars IS NOT NULL),
c AS (SELECT lang, bin, count(*) AS n FROM b GROUP BY ALL),
s AS (SELECT lang, lo, hi, unnest(range(0, 30)) AS bin FROM r)
SELECT s.lang, CAST(s.bin AS BIGINT) AS bin, round(s.lo + s.bin * ((s.hi - s.lo) / 30), 6) AS "left",
       round(s.lo + (s.bin + 1) * ((s.hi - s.lo) / 30), 6) AS "right", CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM s LEFT JOIN c ON s.lang = c.lang AND s.bin = c.bin"""
query("histogram", HISTOGRAM_SQL)(histogram_q)


# ---------------------------------------------------------------- E18 -----
def box_stats_q(spark, sf):
    d = read_table(spark, sf, "documents")
    out = M.box_stats(d, "n_chars", ["lang"])
    return out.select("lang", r6("q1"), r6("med"), r6("q3"), r6("whisker_lo"), r6("whisker_hi"),
                      big("n_outliers"))


BOX_STATS_SQL = """WITH q AS (SELECT lang, quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS q1,
                 quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS med,
                 quantile_cont(CAST(n_chars AS DOUBLE), 0.75) AS q3 FROM documents GROUP BY lang),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q)
SELECT f.lang, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3,
  round(min(CASE WHEN d.n_chars >= lo_f AND d.n_chars <= hi_f THEN CAST(d.n_chars AS DOUBLE) END), 6) AS whisker_lo,
  round(max(CASE WHEN d.n_chars >= lo_f AND d.n_chars <= hi_f THEN CAST(d.n_chars AS DOUBLE) END), 6) AS whisker_hi,
  CAST(sum(CASE WHEN d.n_chars >= lo_f AND d.n_chars <= hi_f THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM documents d JOIN f ON d.lang = f.lang WHERE d.n_chars IS NOT NULL
GROUP BY f.lang, q1, med, q3"""
query("box_stats", BOX_STATS_SQL)(box_stats_q)


# ---------------------------------------------------------------- E6 / E19 -
LB_CTE = f"""{B.preds_cte()},
pc AS ({per_class_sql(class_counts_sql('preds', LB_GROUP))}),
lb AS (SELECT model, task, variety, domain, avg(f1) AS f1_score FROM pc GROUP BY ALL)"""


def mean_by_group_q(spark, sf):
    lb = M.macro_prf(B.preds(spark, sf), LB_GROUP)
    return M.mean_by_group(lb, "f1_score", ["model", "task"]).select(
        "model", "task", r6("mean_f1_score"))


MEAN_BY_GROUP_SQL = f"""WITH {LB_CTE}
SELECT model, task, round(avg(f1_score), 6) AS mean_f1_score FROM lb GROUP BY model, task"""
query("mean_by_group", MEAN_BY_GROUP_SQL)(mean_by_group_q)


def best_worst_model_q(spark, sf):
    lb = M.macro_prf(B.preds(spark, sf), LB_GROUP)
    return M.best_worst(lb, "model", "f1_score", ["task", "domain"]).select(
        "task", "domain", "best", r6("best_mean"), "worst", r6("worst_mean"))


BEST_WORST_MODEL_SQL = f"""WITH {LB_CTE},
m AS (SELECT task, domain, model, avg(f1_score) AS m FROM lb GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY task, domain ORDER BY m DESC, model DESC) AS rb,
               row_number() OVER (PARTITION BY task, domain ORDER BY m ASC, model ASC) AS rw FROM m)
SELECT b.task, b.domain, b.model AS best, round(b.m, 6) AS best_mean, w.model AS worst, round(w.m, 6) AS worst_mean
FROM r b JOIN r w ON b.task = w.task AND b.domain = w.domain AND b.rb = 1 AND w.rw = 1"""
query("best_worst_model", BEST_WORST_MODEL_SQL)(best_worst_model_q)


# ---------------------------------------------------------------- E20 -----
def pivot_matrix_q(spark, sf):
    """trained (model) x tested (variety) F1 for each task, a column for every
    variety of the data."""
    f1 = M.macro_prf(B.preds(spark, sf), ["task", "model", "variety"]).withColumnRenamed("model", "trained")
    out = M.pivot_matrix(f1, ["task", "trained"], "variety", "f1_score")
    return out.select("task", "trained", *[r6(v) for v in out.columns[2:]])


PIVOT_MATRIX_SQL = f"""WITH {B.preds_cte()},
pc AS ({per_class_sql(class_counts_sql('preds', ['task', 'model', 'variety']))}),
f AS (SELECT task, model AS trained, variety, avg(f1) AS f1 FROM pc GROUP BY ALL)
SELECT task, trained, {', '.join(f"round(max(CASE WHEN variety = '{v}' THEN f1 END), 6) AS {v}" for v in ('de', 'en', 'es', 'fr'))}
FROM f GROUP BY task, trained"""
query("pivot_matrix", PIVOT_MATRIX_SQL)(pivot_matrix_q)


# ---------------------------------------------------------------- E21 -----
def pivot_mean_q(spark, sf):
    lb = M.macro_prf(B.preds(spark, sf), LB_GROUP)
    out = M.pivot_mean(lb, "task", "domain", "f1_score", digits=3)
    return out.select("task", *[F.col(d).cast("double").alias(d) for d in out.columns[1:]])


PIVOT_MEAN_SQL = f"""WITH {LB_CTE}
SELECT task, {', '.join(f"CAST(round_even(avg(CASE WHEN domain = '{d}' THEN f1_score END), 3) AS DOUBLE) AS {q}{d}{q}" for q in ('"',) for d in ('Google', 'Reddit'))}
FROM lb GROUP BY task"""
query("pivot_mean", PIVOT_MEAN_SQL)(pivot_mean_q)


# ---------------------------------------------------------------- D6 ------
def grid_spine_q(spark, sf):
    """model x task x variety x domain minus (Google, Sarcasm), with the
    leaderboard F1 attached; cells without data are kept and flagged.  The
    axes are the values of the data (one row of short sets)."""
    lb = M.macro_prf(B.preds(spark, sf), LB_GROUP)
    axes = B.preds(spark, sf).groupBy(*LB_GROUP).agg(F.count("*")).agg(*[F.collect_set(c).alias(c) for c in LB_GROUP])
    spine = (axes.withColumn("model", F.explode("model")).withColumn("task", F.explode("task"))
             .withColumn("variety", F.explode("variety")).withColumn("domain", F.explode("domain"))
             .where(~((F.col("domain") == "Google") & (F.col("task") == "Sarcasm"))))
    return (spine.join(lb, LB_GROUP, "left")
            .select(*LB_GROUP, r6("f1_score"), F.col("n").isNull().alias("missing")))


GRID_SPINE_SQL = f"""WITH {LB_CTE},
spine AS (SELECT * FROM (SELECT DISTINCT model FROM preds) a, (SELECT DISTINCT task FROM preds) b,
          (SELECT DISTINCT variety FROM preds) c, (SELECT DISTINCT domain FROM preds) d
          WHERE NOT (domain = 'Google' AND task = 'Sarcasm'))
SELECT s.model, s.task, s.variety, s.domain, round(lb.f1_score, 6) AS f1_score, lb.f1_score IS NULL AS missing
FROM spine s LEFT JOIN lb ON s.model = lb.model AND s.task = lb.task AND s.variety = lb.variety AND s.domain = lb.domain"""
query("grid_spine", GRID_SPINE_SQL)(grid_spine_q)


# ---------------------------------------------------------------- D11 -----
LABEL_ORDER = (0, 1, 2)


def reindex_fill_q(spark, sf):
    """Sentiment label counts per variety on a fixed label order 0,1,2
    (2 = discard), absent classes filled with 0."""
    a = B.ann(spark, sf)
    c = a.groupBy("variety", F.col("sentiment_label").alias("label")).agg(F.count("*").alias("n"))
    spine = a.select("variety").distinct().select(
        "variety", F.posexplode(F.array(*[F.lit(v) for v in LABEL_ORDER])).alias("order", "label"))
    return spine.join(c, ["variety", "label"], "left").select(
        "variety", "label", F.col("order").cast("long").alias("order"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


REINDEX_FILL_SQL = f"""WITH {B.ANN_CTE},
c AS (SELECT variety, sentiment_label AS label, count(*) AS n FROM ann GROUP BY ALL),
o(label, ord) AS (VALUES {', '.join(f'({v}, {i})' for i, v in enumerate(LABEL_ORDER))}),
s AS (SELECT DISTINCT variety FROM ann)
SELECT s.variety, o.label, CAST(o.ord AS BIGINT) AS "order", CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM s CROSS JOIN o LEFT JOIN c ON c.variety = s.variety AND c.label = o.label"""
query("reindex_fill", REINDEX_FILL_SQL)(reindex_fill_q)


# ---------------------------------------------------------------- H1 ------
def stack_frames_q(spark, sf):
    """Stack per-task frames with different columns (bag semantics)."""
    a = B.ann(spark, sf)
    sent = a.select("id", F.lit("Sentiment").alias("task"), F.col("sentiment_label").alias("label"),
                    F.col("n_chars").alias("rating_source"))
    sarc = a.select("id", F.lit("Sarcasm").alias("task"), F.col("sarcasm_label").alias("label"),
                    "variety")
    return sent.unionByName(sarc, allowMissingColumns=True).select(
        "id", "task", F.col("label").cast("long").alias("label"), "rating_source", "variety")


STACK_FRAMES_SQL = f"""WITH {B.ANN_CTE}
SELECT id, 'Sentiment' AS task, CAST(sentiment_label AS BIGINT) AS label, n_chars AS rating_source,
       CAST(NULL AS VARCHAR) AS variety FROM ann
UNION ALL
SELECT id, 'Sarcasm', CAST(sarcasm_label AS BIGINT), CAST(NULL AS BIGINT), variety FROM ann"""
query("stack_frames", STACK_FRAMES_SQL)(stack_frames_q)


# G3 ------------------------------------------------------------------------
# --- fixed values: presentation order of varieties
VARIETY_ORDER = ("en", "fr", "de", "es")


def fixed_order_q(spark, sf):
    lb = M.macro_prf(B.preds(spark, sf).where(F.col("model") == "m1"), ["task", "variety"])
    order = F.array_position(F.array(*[F.lit(v) for v in VARIETY_ORDER]), F.col("variety"))
    return lb.select("task", "variety", order.cast("long").alias("order_idx"), r6("f1_score")) \
        .orderBy("task", "order_idx")


_ord_case = " ".join(f"WHEN '{v}' THEN {i + 1}" for i, v in enumerate(VARIETY_ORDER))
query("fixed_order", f"""WITH {B.preds_cte(('m1',))},
pc AS ({per_class_sql(class_counts_sql('preds', ['task', 'variety']))})
SELECT task, variety, CAST(CASE variety {_ord_case} ELSE 0 END AS BIGINT) AS order_idx,
       round(avg(f1), 6) AS f1_score FROM pc GROUP BY task, variety ORDER BY task, order_idx""")(fixed_order_q)


# M9 ------------------------------------------------------------------------
def round_n_q(spark, sf):
    d = read_table(spark, sf, "documents")
    x = F.col("n_chars") / 8.0
    return d.select("doc_id", F.round(x, 0).alias("half_up"), F.bround(x, 0).alias("half_even"),
                    F.round(x, 2).alias("half_up_2"), F.bround(x, 2).alias("half_even_2"))


query("round_n", """SELECT doc_id, round(n_chars / 8.0, 0) AS half_up, round_even(n_chars / 8.0, 0) AS half_even,
  round(n_chars / 8.0, 2) AS half_up_2, round_even(n_chars / 8.0, 2) AS half_even_2 FROM documents""")(round_n_q)
