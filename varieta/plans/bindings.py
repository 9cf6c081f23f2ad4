"""Bindings of the driver tables to the reference's data model.

Each binding exists twice, side by side: a DataFrame builder (what the
library runs) and the same definition as a SQL common-table expression
(what the DuckDB oracle runs).  Both read the whole tables.

* ``ann``   documents ⋈ labels as an annotated review sheet
* ``preds`` ``ann`` × pseudo-models with deterministic md5-flipped predictions
* ``noisy`` documents with deterministic dirty suffixes (URLs, links, emoji…)
* ``emb``   embeddings with a binary label
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

# --- fixed values: pseudo-model salts and dirty-text suffixes -------------
MODELS = ("m1", "m2", "m3")
NOISE_SUFFIXES = (
    " see https://example.com/x?a=1 now",
    " [a link](http://b.example/y) and [dangling](http://c.example/z",
    " they aren 't here, it 's fine",
    " unbalanced ) close and ( open { brace ] bracket [ x",
    " ![gif](giphy|abc) lol ![GIF](x)",
    " emoji \U0001F600\U0001F44D\U0001F3FD ☀️ ok",
    "\n\n\nblank lines\n\n  ",
    " &amp; “curly” ‘quotes’ ＦＵＬＬ &lt;tag&gt;",
    " www.example.org/page visit (nested (round) text) {ok}",
    " caf\u00c3\u00a9 na\u00c3\u00afve \u00c3\u20ac la carte \u00c2\u00a35 \u00e2\u20ac\u0153so\u00e2\u20ac\u009d \u00e2\u20ac\u201c \u00c3x \u00c3",
    " \u2192 \u25a0 \u2605 \u2318 \u0915\u094d\u200d\u0937 1\ufe0f\u20e3 \U0001F468\u200D\U0001F469\u200D\U0001F467 done",
    "",
)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- ann -----
def ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    lab = read_table(spark, sf_dir, "labels")
    domain = F.when(F.expr("CAST(substr(source, 4) AS INT)") % 2 == 0, F.lit("Google")) \
        .otherwise(F.lit("Reddit"))
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("variety"),
        domain.alias("domain"),
        F.when(F.col("n_chars") < 200, F.lit(2)).otherwise(F.col("quality")).alias("sentiment_label"),
        F.col("toxic").alias("sarcasm_label"), "quality", "n_chars")


ANN_CTE = """ann AS (
  SELECT d.doc_id AS id, d.text, d.lang AS variety,
         CASE WHEN CAST(substr(d.source, 4) AS INT) % 2 = 0 THEN 'Google' ELSE 'Reddit' END AS domain,
         CASE WHEN d.n_chars < 200 THEN 2 ELSE l.quality END AS sentiment_label,
         l.toxic AS sarcasm_label, l.quality, d.n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


# ------------------------------------------------------------ tasks -------
def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ann`` in long form: one row per (id, task) with ``label``; the
    discard label 2 is removed for every task."""
    return (ann(spark, sf_dir)
            .select("id", "text", "variety", "domain",
                    F.expr("stack(2, 'Sentiment', sentiment_label, 'Sarcasm', sarcasm_label)")
                    .alias("task", "label"))
            .where(F.col("label") != 2))


TASKS_CTE = ANN_CTE + """,
tasks AS (
  SELECT id, text, variety, domain, 'Sentiment' AS task, sentiment_label AS label FROM ann WHERE sentiment_label <> 2
  UNION ALL
  SELECT id, text, variety, domain, 'Sarcasm' AS task, sarcasm_label AS label FROM ann WHERE sarcasm_label <> 2)"""


# --- fixed values: words planted for each label
MARKERS = (("mornblat", "quervil", "tasklon"), ("zephrin", "oldrake", "vintuco"))


def planted(rows: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """Rows whose texts end in words that give their label away, as long as the
    text itself: input for which a right classifier must score high."""
    kind = F.col(label).cast("int")
    n = F.size(F.split(text, " ")) / 2 + 1
    own = [F.when(kind == 0, F.lit(a + " ")).otherwise(F.lit(b + " ")) for a, b in zip(*MARKERS)]
    return rows.withColumn(text, F.concat(F.col(text), F.lit(" "), *[F.repeat(w, n.cast("int")) for w in own]))


def coin_label(id_col: str = "id"):
    """A label for planting: even classes, whatever the row's own label."""
    h = F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit("plant"))), 1, 1)
    return F.when(h < "8", F.lit(1)).otherwise(F.lit(0))


COIN_SQL = "CASE WHEN substr(md5(CAST(id AS VARCHAR) || 'plant'), 1, 1) < '8' THEN 1 ELSE 0 END"


# ------------------------------------------------------------ preds -------
def flip_prediction(id_col, label_col, salt_col):
    h = F.substring(F.md5(F.concat(F.col(id_col).cast("string"), salt_col)), 1, 1)
    return F.when(h.isin("0", "1", "2"), 1 - F.col(label_col)).otherwise(F.col(label_col))


def flip_sql(id_col: str, label_col: str, salt_sql: str) -> str:
    return (f"CASE WHEN substr(md5(concat(CAST({id_col} AS VARCHAR), {salt_sql})), 1, 1) "
            f"IN ('0','1','2') THEN 1 - {label_col} ELSE {label_col} END")


def preds(spark: SparkSession, sf_dir: str, models=MODELS) -> DataFrame:
    """Every task row scored by every pseudo-model (long form)."""
    t = task_rows(spark, sf_dir)
    return (t.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
            .withColumn("prediction", flip_prediction("id", "label", F.col("model"))))


def preds_cte(models=MODELS) -> str:
    vals = ", ".join(f"({_q(m)})" for m in models)
    return TASKS_CTE + f""",
models(model) AS (VALUES {vals}),
preds AS (
  SELECT t.*, m.model, {flip_sql('t.id', 't.label', 'm.model')} AS prediction
  FROM tasks t, models m)"""


# ------------------------------------------------------------ noisy -------
def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    suffix = F.element_at(F.array(*[F.lit(s) for s in NOISE_SUFFIXES]),
                          (F.col("doc_id") % len(NOISE_SUFFIXES) + 1).cast("int"))
    return d.select("doc_id", F.concat("text", suffix).alias("text"), "lang", "source", "n_chars")


def noisy_cte() -> str:
    arr = ", ".join(_q(s) for s in NOISE_SUFFIXES)
    return f"""noisy AS (
  SELECT doc_id, text || ([{arr}])[CAST(doc_id % {len(NOISE_SUFFIXES)} AS INTEGER) + 1] AS text,
         lang, source, n_chars
  FROM documents)"""


# -------------------------------------------------------------- emb -------
def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", F.col("label").alias("class10"),
                    (F.col("label") % 2).alias("label"))


EMB_CTE = """emb AS (
  SELECT vec_id, embedding, label AS class10, label % 2 AS label FROM embeddings)"""
