"""Joins with reference semantics."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import add_row_id, trim_headers


def merge_translations(base: DataFrame, translations: DataFrame, key: str = "id",
                       cols: Sequence[str] = ("text", "label", "is_cm"), flag: str = "is_cm",
                       on_duplicate: str = "error") -> DataFrame:
    """Keep every base row; where ``flag`` is true and the key exists in
    ``translations``, overwrite ``cols`` with the translated values (nulls
    overwrite too — this is not a coalesce).  Translation-only keys are
    ignored.  Duplicate translation keys raise (``on_duplicate="error"``) or
    keep the row with the smallest translated text (``"first"``)."""
    tr = trim_headers(translations)
    packed = F.struct(*[F.col(c).alias(c) for c in cols])
    agg = tr.groupBy(key).agg(F.count("*").alias("_n"), F.min_by(packed, F.coalesce(F.col(cols[0]).cast("string"), F.lit(""))).alias("_t"))
    if on_duplicate == "error":
        agg = agg.withColumn("_t", F.when(F.col("_n") > 1, F.raise_error(
            F.concat(F.lit("duplicate translation key "), F.col(key).cast("string")))).otherwise(F.col("_t")))
    j = base.join(agg.select(key, "_t", F.lit(True).alias("_hit")), key, "left")
    use = F.col(flag) & F.coalesce(F.col("_hit"), F.lit(False))
    out = j.select(*[F.when(use, F.col(f"_t.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
                     for c in base.columns])
    return out


def join_by_position(dataset: DataFrame, predictions: DataFrame, order_col: str,
                     pred_order_col: str, keep_unmatched: bool = False) -> DataFrame:
    """Align a positional prediction file with dataset rows by row index
    (both indexed with the distributed dense row id).  Unmatched rows get a
    null prediction and are dropped unless ``keep_unmatched``."""
    d = add_row_id(dataset, order_col, "_pos")
    p = add_row_id(predictions, pred_order_col, "_pos").drop(pred_order_col)
    j = d.join(p, "_pos", "left")
    if not keep_unmatched:
        j = j.na.drop(subset=[c for c in p.columns if c != "_pos"])
    return j.drop("_pos")
