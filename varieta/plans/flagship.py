"""Flagship job: noisy documents -> clean text -> code-mixing tag ->
stratified split -> pseudo-model predictions -> macro F1 per
(model, split, variety, is_cm).

Shuffles: the split's two-level rank (strata × hash bucket), the detector's
per-document fold of token flags (one small array per document), and the
metric's partial-aggregated class counts.  The text itself is cleaned
in place and never shuffled; only ids, labels and scores move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codemix as CM
from ..functions import text as T
from ..operators import metrics as M
from ..operators import split as SP
from ..session import read_table
from . import bindings as B


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = B.noisy(spark, sf_dir)
    # Clean once; only (doc_id, cleaned text) feeds the detector.
    cleaned = T.clean_text(raw.select("doc_id", "text"), "text")
    common = CM.common_words(CM.zipf_table(read_table(spark, sf_dir, "documents")
                                           .where(F.col("lang") == "en")))
    cm = CM.detect_code_mixing(cleaned, common, "doc_id", "text").select(
        F.col("doc_id").alias("id"), "is_cm", "cm_score")
    labels = read_table(spark, sf_dir, "labels")
    domain = F.when(F.expr("CAST(substr(source, 4) AS INT)") % 2 == 0, F.lit("Google")).otherwise(F.lit("Reddit"))
    ann = raw.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("variety"), domain.alias("domain"),
        F.when(F.col("n_chars") < 200, F.lit(2)).otherwise(F.col("quality")).alias("sentiment_label"),
        F.col("toxic").alias("sarcasm_label"))
    tasks = ann.select("id", "variety", "domain",
                       F.expr("stack(2, 'Sentiment', sentiment_label, 'Sarcasm', sarcasm_label)")
                       .alias("task", "label")).where(F.col("label") != 2)
    split = SP.stratified_split3(tasks, ["task", "variety", "domain"], "label", "id")
    preds = (split.withColumn("model", F.explode(F.array(*[F.lit(m) for m in B.MODELS])))
             .withColumn("prediction", B.flip_prediction("id", "label", F.col("model"))))
    scored = preds.join(cm, "id")
    out = M.macro_prf(scored, ["model", "split", "variety", "is_cm"])
    return out.select("model", "split", "variety", "is_cm",
                      *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")],
                      F.col("n").cast("long").alias("n"))
