"""Registered split, dataset-layout and ingestion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import NA_TOKENS
from ..functions.patterns import sql_str as q
from ..operators import metrics as M
from ..operators import split as SP
from ..session import read_table
from ..sources import files as FS
from ..sources import listings as L
from . import bindings as B
from . import sqltext as S
from .q_metrics import LB_GROUP, r6
from .registry import query
from .sqlgen import class_counts_sql, per_class_sql

STRATA = ["task", "variety", "domain"]
OUT_COLS = ["id", "task", "variety", "domain", "label", "split"]


def splits(spark, sf):
    return SP.stratified_split3(B.task_rows(spark, sf), STRATA, "label", "id")


SPLIT_CTE = B.TASKS_CTE + """,
r AS (SELECT *, row_number() OVER (PARTITION BY task, variety, domain, label
                                   ORDER BY md5(CAST(id AS VARCHAR) || '7'), id) - 1 AS rk,
             count(*) OVER (PARTITION BY task, variety, domain, label) AS n
      FROM tasks WHERE id IS NOT NULL AND text IS NOT NULL AND variety IS NOT NULL AND domain IS NOT NULL),
splits AS (SELECT id, text, task, variety, domain, label,
  CASE WHEN rk < floor(n * 0.7) THEN 'train'
       WHEN rk < floor(n * 0.7) + floor((n - floor(n * 0.7)) * 0.3) THEN 'valid'
       ELSE 'test' END AS split FROM r)"""
SPLIT_SQL = f"WITH {SPLIT_CTE} SELECT {', '.join(OUT_COLS)} FROM splits"


# I1 ------------------------------------------------------------------------
def stratified_split3_q(spark, sf):
    return splits(spark, sf).select(*OUT_COLS)


query("stratified_split3", SPLIT_SQL)(stratified_split3_q)


# I2 ------------------------------------------------------------------------
def split_half_q(spark, sf):
    v = splits(spark, sf).where(F.col("split") == "valid").drop("split")
    return SP.split_half(v, "label", "id", 0.5, 50, STRATA).select(*OUT_COLS)


query("split_half", f"""WITH {SPLIT_CTE},
v AS (SELECT * FROM splits WHERE split = 'valid'),
r2 AS (SELECT *, row_number() OVER (PARTITION BY task, variety, domain, label
                                    ORDER BY md5(CAST(id AS VARCHAR) || '50'), id) - 1 AS rk2,
              count(*) OVER (PARTITION BY task, variety, domain, label) AS n2 FROM v)
SELECT id, task, variety, domain, label,
       CASE WHEN rk2 < n2 - ceil(n2 * 0.5) THEN 'valid' ELSE 'test' END AS split FROM r2""")(split_half_q)


# E3 ------------------------------------------------------------------------
def split_balance_q(spark, sf):
    s = splits(spark, sf)
    out = M.split_balance(s, ["task", "split"], "label", (0, 1))
    return out.select("task", "split", *[F.col(c).cast("long").alias(c) for c in ("n", "n_0", "n_1")],
                      r6("pct_0"), r6("pct_1"))


query("split_balance", f"""WITH {SPLIT_CTE}
SELECT task, split, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_0,
  CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_1,
  round(round(100.0 * sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) / count(*), 1), 6) AS pct_0,
  round(round(100.0 * sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) / count(*), 1), 6) AS pct_1
FROM splits GROUP BY task, split""")(split_balance_q)


# E5 ------------------------------------------------------------------------
def dataset_card_q(spark, sf):
    s = splits(spark, sf)
    card = s.groupBy(*STRATA).agg(
        *[F.count_if(F.col("split") == x).cast("long").alias(f"n_{x}") for x in ("train", "valid", "test")],
        F.avg("label").alias("positive_rate"),
        F.avg(F.length("text")).alias("mean_chars"))
    return card.select(*STRATA, "n_train", "n_valid", "n_test", r6("positive_rate"), r6("mean_chars"))


query("dataset_card", f"""WITH {SPLIT_CTE}
SELECT task, variety, domain,
  CAST(count_if(split = 'train') AS BIGINT) AS n_train, CAST(count_if(split = 'valid') AS BIGINT) AS n_valid,
  CAST(count_if(split = 'test') AS BIGINT) AS n_test, round(avg(label), 6) AS positive_rate,
  round(avg(length(text)), 6) AS mean_chars
FROM splits GROUP BY task, variety, domain""")(dataset_card_q)


# D10 -----------------------------------------------------------------------
def split_leakage_q(spark, sf):
    s = splits(spark, sf)
    return SP.split_leakage(s, "split", "text", ["task"]).select(
        "task", "split_a", "split_b", F.col("n_shared").cast("long").alias("n_shared"))


_KEY_SQL = "md5(lower(" + S.normalize_ws("text") + "))"
query("split_leakage", f"""WITH {SPLIT_CTE},
k AS (SELECT DISTINCT task, {_KEY_SQL} AS k, split FROM splits)
SELECT a.task, a.split AS split_a, b.split AS split_b, CAST(count(*) AS BIGINT) AS n_shared
FROM k a JOIN k b ON a.task = b.task AND a.k = b.k AND a.split <> b.split
GROUP BY a.task, a.split, b.split""")(split_leakage_q)


def purge_leaks_q(spark, sf):
    s = splits(spark, sf)
    return SP.purge_leaks(s).select(*OUT_COLS)


query("purge_leaks", f"""WITH {SPLIT_CTE},
k AS (SELECT *, {_KEY_SQL} AS k FROM splits)
SELECT {', '.join(OUT_COLS)} FROM k WHERE split = 'train'
UNION ALL SELECT {', '.join(OUT_COLS)} FROM k x WHERE split = 'valid'
  AND NOT EXISTS (SELECT 1 FROM k y WHERE y.split = 'train' AND y.k = x.k)
UNION ALL SELECT {', '.join(OUT_COLS)} FROM k x WHERE split = 'test'
  AND NOT EXISTS (SELECT 1 FROM k y WHERE y.split IN ('train', 'valid') AND y.k = x.k)""")(purge_leaks_q)


# D3 ------------------------------------------------------------------------
def attach_train_size_q(spark, sf):
    s = splits(spark, sf)
    size = s.where(F.col("split") == "train").groupBy(*STRATA).agg(F.count("*").alias("size"))
    lb = M.macro_prf(B.preds(spark, sf), LB_GROUP)
    return lb.join(size, STRATA, "left").select(*LB_GROUP, r6("f1_score"),
                                                F.col("size").cast("long").alias("size"))


query("attach_train_size", f"""WITH {SPLIT_CTE},
size AS (SELECT task, variety, domain, count(*) AS size FROM splits WHERE split = 'train' GROUP BY ALL),
models(model) AS (VALUES {', '.join(f"('{m}')" for m in B.MODELS)}),
preds AS (SELECT t.*, m.model, {B.flip_sql('t.id', 't.label', 'm.model')} AS prediction FROM tasks t, models m),
pc AS ({per_class_sql(class_counts_sql('preds', LB_GROUP))}),
lb AS (SELECT model, task, variety, domain, avg(f1) AS f1_score FROM pc GROUP BY ALL)
SELECT lb.model, lb.task, lb.variety, lb.domain, round(lb.f1_score, 6) AS f1_score, CAST(size.size AS BIGINT) AS size
FROM lb LEFT JOIN size ON lb.task = size.task AND lb.variety = size.variety AND lb.domain = size.domain""")(attach_train_size_q)


# A1 ------------------------------------------------------------------------
def read_labeled_q(spark, sf):
    a = B.ann(spark, sf).select("id", "text", F.col("sentiment_label").alias("label"))
    path = FS.scratch_path(spark, "labeled") + ".csv"
    FS.write_labeled_csv(a, path)
    return FS.read_labeled(spark, path, fmt="csv").select("id", "text", "label")


_na = ", ".join(q(t) for t in NA_TOKENS)
query("read_labeled", f"""WITH {B.ANN_CTE},
p AS (SELECT id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS text, sentiment_label AS label FROM ann),
n AS (SELECT id, CASE WHEN text IN ({_na}) THEN NULL ELSE text END AS text, label FROM p)
SELECT id, text, label FROM n WHERE id IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL""")(read_labeled_q)


# A8 + A2 -------------------------------------------------------------------
def scan_splits_q(spark, sf):
    path = FS.scratch_path(spark, "splits")
    FS.write_splits(splits(spark, sf), path)
    tree = FS.scan_splits(spark, path)
    return tree.select(F.col("id").cast("long").alias("id"), "task", "variety", "domain",
                       F.col("label").cast("int").alias("label"), "split")


query("scan_splits", SPLIT_SQL)(scan_splits_q)


# A11 -----------------------------------------------------------------------
def publish_replacing_q(spark, sf):
    root = FS.scratch_path(spark, "published")
    rows = splits(spark, sf).select(*OUT_COLS)
    FS.publish_replacing(rows, root, "1")
    FS.publish_replacing(FS.read_current(spark, root), root, "2", base=1)
    return FS.read_current(spark, root)


query("publish_replacing", SPLIT_SQL)(publish_replacing_q)


# A3 ------------------------------------------------------------------------
def _posts(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select(
        "conv_id", F.col("turn").alias("_ord"), F.col("role").alias("subreddit"),
        F.when(F.col("turn") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("title"),
        F.col("text").alias("selftext"),
        ((F.col("turn") % 7) / 5.0).alias("upvote_ratio"),
        F.col("turn").cast("int").alias("ups"), (F.col("conv_id") % 2).cast("int").alias("downs"),
        F.when(F.col("turn") % 4 == 0, F.col("turn") + 1)
         .otherwise(F.col("turn") - F.col("conv_id") % 2).cast("int").alias("score"))


def flatten_posts_q(spark, sf):
    p = _posts(spark, sf)
    post = F.struct(*[F.col(c) for c in L.POST_DEFAULTS])
    listings = L.pack_listing(p, F.col("conv_id"), post).withColumnRenamed("_key", "conv_id")
    flat = L.flatten_posts(listings, "listing", keep=("conv_id",))
    return flat.select("conv_id", *L.POST_DEFAULTS.keys(), F.array_join("errors", ",").alias("errors"),
                       "score_mismatch")


query("flatten_posts", """WITH p AS (SELECT conv_id, role AS subreddit,
    coalesce(CASE WHEN turn % 5 = 0 THEN NULL ELSE text END, '') AS title,
    coalesce(text, '') AS selftext, (turn % 7) / 5.0 AS upvote_ratio, CAST(turn AS INTEGER) AS ups,
    CAST(conv_id % 2 AS INTEGER) AS downs,
    CAST(CASE WHEN turn % 4 = 0 THEN turn + 1 ELSE turn - conv_id % 2 END AS INTEGER) AS score
  FROM conversations)
SELECT conv_id, coalesce(subreddit, 'unknown') AS subreddit, title, selftext, upvote_ratio, ups, downs, score,
  CASE WHEN upvote_ratio BETWEEN 0.0 AND 1.0 THEN '' ELSE 'upvote_ratio_range' END AS errors,
  coalesce(downs = 0 AND score <> ups, FALSE) AS score_mismatch
FROM p""")(flatten_posts_q)


# A4 ------------------------------------------------------------------------
def flatten_reviews_q(spark, sf):
    a = B.ann(spark, sf)
    uri = F.when(F.col("id") % 9 == 0, F.lit("not a url")).otherwise(
        F.concat(F.lit("https://maps.example.com/contrib/"), F.col("id").cast("string"), F.lit("/reviews")))
    rating = (F.when(F.col("id") % 17 == 0, F.lit(0)).when(F.col("id") % 19 == 0, F.lit(6))
              .otherwise(F.col("quality") * 4 + 1))
    review = F.struct(
        F.struct(uri.alias("uri"), F.concat(F.lit("user"), F.col("id").cast("string")).alias("displayName"))
        .alias("authorAttribution"),
        rating.cast("int").alias("rating"),
        F.struct(F.when(F.col("id") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("text"))
                 .alias("text"), F.col("variety").alias("languageCode")).alias("originalText"),
        F.lit(None).cast("string").alias("publishTime"))
    places = (a.groupBy(F.concat("domain", F.lit("-"), F.floor(F.col("id") / 5).cast("string")).alias("place_id"),
                        F.col("variety").alias("city"))
              .agg(F.collect_list(review).alias("reviews")))
    flat = L.flatten_reviews(places)
    return flat.select("place_id", "city", "id", "rating", "review", F.array_join("errors", ",").alias("errors"))


query("flatten_reviews", f"""WITH {B.ANN_CTE},
r AS (SELECT domain || '-' || CAST(CAST(floor(id / 5) AS BIGINT) AS VARCHAR) AS place_id, variety AS city,
        CASE WHEN id % 9 = 0 THEN 'not a url' ELSE 'https://maps.example.com/contrib/' || CAST(id AS VARCHAR) || '/reviews' END AS uri,
        CAST(CASE WHEN id % 17 = 0 THEN 0 WHEN id % 19 = 0 THEN 6 ELSE quality * 4 + 1 END AS INTEGER) AS rating,
        coalesce(CASE WHEN id % 11 = 0 THEN NULL ELSE text END, 'N/A') AS review FROM ann),
f AS (SELECT *, CASE WHEN len(string_split(uri, '/')) >= 2 THEN (string_split(uri, '/'))[-2] END AS aid FROM r)
SELECT place_id, city, aid AS id, rating, review,
  array_to_string(list_filter([CASE WHEN NOT coalesce(rating BETWEEN 1 AND 5, FALSE) THEN 'rating_range' END,
    CASE WHEN NOT coalesce(regexp_matches(uri, '^https?://[^/]+/.+'), FALSE) THEN 'uri_is_url' END,
    CASE WHEN NOT coalesce(aid IS NOT NULL AND aid <> '', FALSE) THEN 'author_present' END], lambda e: e IS NOT NULL), ',') AS errors
FROM f""")(flatten_reviews_q)


# A5 ------------------------------------------------------------------------
def explode_config_q(spark, sf):
    d = read_table(spark, sf, "documents")
    pairs = d.select("lang", "source").distinct()
    cfg = pairs.select(F.to_json(F.create_map("lang", F.array("source"))).alias("config"))  # one small config a pair
    return L.explode_config(cfg)


query("explode_config", "SELECT DISTINCT lang AS locale, source AS subreddit FROM documents")(explode_config_q)


# A6 ------------------------------------------------------------------------
def _landed_results(spark, sf):
    p = B.preds(spark, sf)
    lb = M.macro_prf(p, LB_GROUP)
    root = FS.scratch_path(spark, "results")
    FS.write_results(p.select("id", "prediction", *LB_GROUP), root, lb)
    return root


def scan_results_q(spark, sf):
    got = FS.scan_results(spark, _landed_results(spark, sf))
    return got.select("model", "task", "variety", "domain", r6("precision"), r6("recall"), r6("f1_score"))


query("scan_results", f"""WITH {B.preds_cte()},
pc AS ({per_class_sql(class_counts_sql('preds', LB_GROUP))})
SELECT model, task, variety, domain, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(f1), 6) AS f1_score FROM pc GROUP BY ALL""")(scan_results_q)


def combined_metrics_q(spark, sf):
    """The combined sheet from landed metric files: train sizes attached, the
    pair (Google, Sarcasm) left out."""
    size = splits(spark, sf).where(F.col("split") == "train").groupBy(*STRATA).agg(F.count("*").alias("size"))
    got = FS.combined_metrics(FS.scan_results(spark, _landed_results(spark, sf)), size)
    return got.select("model", "locale", "task", F.col("size").cast("long").alias("size"), r6("precision"), r6("recall"), r6("f1_score"))


query("combined_metrics", f"""WITH {SPLIT_CTE},
size AS (SELECT task, variety, domain, count(*) AS size FROM splits WHERE split = 'train' GROUP BY ALL),
models(model) AS (VALUES {', '.join(f"('{m}')" for m in B.MODELS)}),
preds AS (SELECT t.*, m.model, {B.flip_sql('t.id', 't.label', 'm.model')} AS prediction FROM tasks t, models m),
pc AS ({per_class_sql(class_counts_sql('preds', LB_GROUP))}),
lb AS (SELECT model, task, variety, domain, avg(precision) AS p, avg(recall) AS r, avg(f1) AS f FROM pc GROUP BY ALL)
SELECT lb.model, lb.variety AS locale, lower(lb.domain) || '-' || lower(lb.task) AS task, CAST(size.size AS BIGINT) AS size,
       round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score
FROM lb LEFT JOIN size ON lb.task = size.task AND lb.variety = size.variety AND lb.domain = size.domain
WHERE NOT (lb.domain = 'Google' AND lb.task = 'Sarcasm')""")(combined_metrics_q)


# A7 ------------------------------------------------------------------------
def latest_file_q(spark, sf):
    p = B.preds(spark, sf).select("id", "model", "prediction")
    root = FS.scratch_path(spark, "predictions")
    # Each run lands as many part files as its tasks write; the newest file
    # by modification time belongs to the run written last.
    p.where(F.col("model") == "m1").write.option("header", True).csv(root + "/run1")
    p.where(F.col("model") == "m2").write.option("header", True).csv(root + "/run2")
    # the first pattern matches nothing: the second one is taken
    latest = FS.latest_file(spark, root + "/best*/*.csv", root + "/run*/*.csv")
    return latest.select(F.regexp_extract("path", r"/(run\d)/", 1).alias("run"))


query("latest_file", "SELECT 'run2' AS run")(latest_file_q)


# A9 ------------------------------------------------------------------------
def write_predictions_q(spark, sf):
    back = spark.read.parquet(_landed_results(spark, sf) + "/prediction")
    return back.select("id", "model", "task", "variety", "domain", "prediction")


query("write_predictions", f"""WITH {B.preds_cte()}
SELECT id, model, task, variety, domain, prediction FROM preds""")(write_predictions_q)
