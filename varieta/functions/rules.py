"""Projections, filters and row rules."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# B1 -----------------------------------------------------------------------
def task_projection(df: DataFrame, tasks: Mapping[str, str] | None = None,
                    keep: Sequence[str] = ("id", "text")) -> DataFrame:
    """``[id, text, <task>_label]`` -> ``[id, text, task, label]`` for every
    task at once (one ``stack`` generator, no union of scans)."""
    tasks = tasks or {"Sentiment": "sentiment_label", "Sarcasm": "sarcasm_label"}
    args = ", ".join(f"'{t}', `{c}`" for t, c in tasks.items())
    return df.select(*keep, F.expr(f"stack({len(tasks)}, {args})").alias("task", "label"))


# B2 -----------------------------------------------------------------------
def drop_discarded(df: DataFrame, label: str = "sentiment_label", discard: int = 2,
                   strict_cols: Sequence[str] = ()) -> DataFrame:
    """Keep rows whose ``label`` is not the discard label, then drop rows with
    any null.  ``strict_cols`` applies the discard test to more columns."""
    cond = F.col(label) != discard
    for c in strict_cols:
        cond = cond & (F.col(c) != discard)
    return df.where(cond).na.drop("any")


# B5 -----------------------------------------------------------------------
def slice_dataset(df: DataFrame, task: str, variety: str, source: str = "BOTH",
                  source_col: str = "domain") -> DataFrame:
    cond = (F.col("task") == task) & (F.col("variety") == variety)
    if source != "BOTH":
        cond = cond & (F.col(source_col) == source)
    return df.where(cond)


# B6 / D7 ------------------------------------------------------------------
def location_string(lat, lng) -> Column:
    """``"lat,lng"`` from the values' canonical text form."""
    return F.concat(_c(lat).cast("string"), F.lit(","), _c(lng).cast("string"))


def filter_cities(rows: DataFrame, config: DataFrame, key: str = "country",
                  value: str = "population", minimum: str = "min_population") -> DataFrame:
    """Config theta join: ``key`` equal and ``value > minimum`` (strict).
    The config has one row per country — bounded by its literal
    construction — so it is broadcast."""
    j = rows.join(F.broadcast(config), (rows[key] == config[key]) & (rows[value] > config[minimum]))
    return j.select(rows[key].alias(key), rows["city"], location_string(rows["lat"], rows["lng"]).alias("location"))


# B7 -----------------------------------------------------------------------
def binarize_rating(rating, threshold: float = 2.0) -> Column:
    """``1 if rating > threshold else 0``; null and NaN become 0 (pandas
    semantics — Spark alone would rank NaN above every number)."""
    r = _c(rating)
    return F.when(r.isNull() | F.isnan(r), F.lit(0)).when(r > threshold, F.lit(1)).otherwise(F.lit(0))


# B8 -----------------------------------------------------------------------
def relabel(col, mapping: Mapping, keep_unmapped: bool = False) -> Column:
    """Dictionary relabel: unmapped -> null, or -> itself with ``keep_unmapped``."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    looked = F.try_element_at(m, _c(col))
    return F.coalesce(looked, _c(col)) if keep_unmapped else looked


# B9 -----------------------------------------------------------------------
def quality_gate(df: DataFrame, rules: Sequence[tuple[str, Column]],
                 out: str = "errors") -> DataFrame:
    """Evaluate every rule per row; ``errors`` lists the names of the rules a
    row fails (a null test counts as a failure).  Valid rows have []."""
    flags = [F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules]
    return df.withColumn(out, F.filter(F.array(*flags), lambda e: e.isNotNull()))


def gate_report(df: DataFrame, errors: str = "errors") -> DataFrame:
    """Rejections per rule plus the number of valid rows (one pass)."""
    tags = F.when(F.size(errors) == 0, F.array(F.lit("valid"))).otherwise(F.col(errors))
    return df.select(F.explode(tags).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


# B10 ----------------------------------------------------------------------
def soft_check(cond: Column) -> Column:
    """A warning flag (row is kept); null tests are not flagged."""
    return F.coalesce(cond, F.lit(False))


# B11 ----------------------------------------------------------------------
def parse_location(col) -> Column:
    """``"lat,lng"`` -> struct(lat, lng, valid); invalid when not exactly two
    numeric parts (values are null then)."""
    parts = F.split(_c(col), ",")
    a = F.try_element_at(parts, F.lit(1)).try_cast("double")
    b = F.try_element_at(parts, F.lit(2)).try_cast("double")
    ok = F.coalesce((F.size(parts) == 2) & a.isNotNull() & b.isNotNull(), F.lit(False))
    return F.struct(F.when(ok, a).alias("lat"), F.when(ok, b).alias("lng"), ok.alias("valid"))


def coordinate_rules(lat, lng) -> list[tuple[str, Column]]:
    return [("lat_range", _c(lat).between(-90, 90)), ("lng_range", _c(lng).between(-180, 180))]


def request_rules(lat, lng, radius, max_results) -> list[tuple[str, Column]]:
    """B9 rules of a place-search request: centre on the globe, a positive
    radius, 1 to 20 results."""
    return [*coordinate_rules(lat, lng), ("radius_positive", _c(radius) > 0), ("max_results_range", _c(max_results).between(1, 20))]


def weight_rules(*weights) -> list[tuple[str, Column]]:
    """B9 rules of class weights: every weight is positive."""
    return [(f"weight_{k}_positive", _c(w) > 0) for k, w in enumerate(weights)]


# B12 ----------------------------------------------------------------------
def build_request(lat, lng, types: Sequence[str], radius: float = 500.0,
                  max_results: int = 20) -> Column:
    """Nested place-search request as JSON (plan data for an external fetcher)."""
    center = F.struct(_c(lat).alias("latitude"), _c(lng).alias("longitude"))
    body = F.struct(F.array(*[F.lit(t) for t in types]).alias("includedTypes"),
                    F.lit(max_results).alias("maxResultCount"),
                    F.struct(F.struct(center.alias("center"), F.lit(float(radius)).alias("radius"))
                             .alias("circle")).alias("locationRestriction"))
    return F.to_json(body)


# B13 ----------------------------------------------------------------------
def add_row_id(df: DataFrame, order_col: str, out: str = "row_id") -> DataFrame:
    """Dense ``0..n-1`` ids in ``order_col`` order, computed distributed.

    Rows are range-sorted, tagged with ``monotonically_increasing_id`` and
    checkpointed (reliable, into ``spark.checkpoint.dir``) so partition
    contents and tags are fixed even if executors are lost.  Per-partition
    counts (one row per partition, a bound set by the partition count)
    give each partition its offset.  No window over all rows, no driver
    collect.  ``order_col`` must be unique for the result to be defined."""
    from ..session import cut_lineage
    tagged = cut_lineage(df.orderBy(order_col).withColumn("_mono", F.monotonically_increasing_id()))
    pid = F.shiftright("_mono", 33)
    counts = tagged.groupBy(pid.alias("_pid")).agg(F.count("*").alias("_n"), F.min("_mono").alias("_first"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    j = tagged.join(F.broadcast(offsets), pid == F.col("_pid"))
    return j.withColumn(out, (F.col("_off") + F.col("_mono") - F.col("_first")).cast("long")) \
        .drop("_mono", "_pid", "_n", "_first", "_off")


# A12 / A13 ----------------------------------------------------------------
def require_columns(df: DataFrame, needed: Sequence[str], strict: bool = True) -> list[str]:
    """Schema check before a plan runs; returns the missing names (or raises)."""
    missing = [c for c in needed if c not in df.columns]
    if missing and strict:
        raise ValueError(f"missing columns: {missing}")
    return missing


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])
