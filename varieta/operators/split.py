"""Deterministic stratified splits and leakage checks.

A split is decided by each row's rank inside its stratum under a hash order
``md5(id || seed)``.  The splits find the (hash, id) at each stratum's cuts
from bucket counts and the ids of the cut buckets, and compare every row with
them in place (``cut_by_rank``).  Where the rank itself is asked for it is
computed in two levels so that a hot stratum (one that holds a third of all
rows) is never a single window partition:

1. bucket = the first ``hex_digits`` hex characters of the hash — a prefix,
   so bucket order agrees with hash order (4 digits = 65,536 buckets: a
   33 TB stratum becomes ~0.5 GB window partitions; the result is the same
   for any digit count);
2. rows per (stratum, bucket) with a map-side combined count; running
   offsets of the buckets inside each stratum on that small table;
3. rank inside (stratum, bucket) with a window whose partitions hold about
   1/16^hex_digits of the stratum.

The result is identical to ``row_number() OVER (PARTITION BY stratum ORDER
BY md5(id||seed), id)`` and does not depend on partitioning or on task
retries (no ``rand``, no ``monotonically_increasing_id``).
"""

from __future__ import annotations

from decimal import Decimal
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(id_col: str, seed) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def stratum_rank(df: DataFrame, strata: Sequence[str], id_col: str = "id", seed=7,
                 hex_digits: int = 4) -> DataFrame:
    """Adds ``_rank`` (0-based, hash order) and ``_n`` (stratum size)."""
    s = list(strata)
    keyed = df.withColumn("_h", hash_key(id_col, seed)) \
        .withColumn("_b", F.substring("_h", 1, hex_digits))
    counts = keyed.groupBy(*s, "_b").agg(F.count("*").alias("_bn"))
    wcum = Window.partitionBy(*s).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("_off", F.coalesce(F.sum("_bn").over(wcum), F.lit(0)))
               .withColumn("_n", F.sum("_bn").over(Window.partitionBy(*s)))
               .drop("_bn"))
    inner = Window.partitionBy(*s, "_b").orderBy("_h", id_col)
    ranked = keyed.withColumn("_r", F.row_number().over(inner) - 1)
    # null-safe join keys (strata may contain nulls)
    cond = [ranked[c].eqNullSafe(offsets[c]) for c in s + ["_b"]]
    j = ranked.join(offsets, cond).select(ranked["*"], offsets["_off"], offsets["_n"])
    return j.withColumn("_rank", F.col("_off") + F.col("_r")).drop("_h", "_b", "_r", "_off")


# Above so many strata the cut table is joined instead of broadcast.
MAX_BROADCAST_STRATA = 100_000


def _share(n: Column, part: float, up: bool = False) -> Column:
    """``floor(n * part)`` (``ceil`` if ``up``) in exact decimals: 90 * 0.7 is 63."""
    x = n.cast("decimal(20,0)") * F.lit(Decimal(str(part)))
    return (F.ceil(x) if up else F.floor(x)).cast("long")


def cut_by_rank(df: DataFrame, strata: Sequence[str], id_col: str, seed, cuts, names: Sequence[str], out: str,
                hex_digits: int = 4) -> DataFrame:
    """Name the part of every row by its hash rank in its stratum.

    ``cuts(n)`` gives the first ranks of the second, third, ... part.  Strata
    and hash buckets are counted, only the ids of the buckets with a cut are
    ranked, and each stratum gets the (hash, id) at its cuts; rows are then
    compared with them where they stand, so no other column moves."""
    s = list(strata)
    keyed = df.select(*s, id_col).withColumn("_h", hash_key(id_col, seed)).withColumn("_b", F.substring("_h", 1, hex_digits))
    counts = keyed.groupBy(*s, "_b").agg(F.count("*").alias("_bn"))
    before = Window.partitionBy(*s).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_bn").over(before), F.lit(0))) \
        .withColumn("_n", F.sum("_bn").over(Window.partitionBy(*s)))
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), c.alias("rank")) for k, c in enumerate(cuts(F.col("_n")))]))
    marks = counts.select(*s, "_b", "_off", "_bn", at.alias("_c")) \
        .where((F.col("_c.rank") >= F.col("_off")) & (F.col("_c.rank") < F.col("_off") + F.col("_bn"))) \
        .select(*[F.col(c).alias(f"_m_{c}") for c in [*s, "_b"]], F.col("_c.k").alias("_k"),
                (F.col("_c.rank") - F.col("_off")).alias("_need"))
    near = keyed.join(marks, [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in [*s, "_b"]]) \
        .select(*s, "_b", id_col, "_h", "_k", "_need")
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy(*s, "_b", "_k").orderBy("_h", id_col)) - 1) \
        .where(F.col("_r") == F.col("_need"))
    ends = [F.max(F.when(F.col("_k") == k, F.struct("_h", id_col))).alias(f"_cut{k}") for k in range(len(names) - 1)]
    from ..session import cut_lineage
    table = cut_lineage(ranked.groupBy(*s).agg(*ends).withColumnsRenamed({c: f"_m_{c}" for c in s}))
    if table.count() <= MAX_BROADCAST_STRATA:
        table = F.broadcast(table)
    rows = df.join(table, [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in s], "left").drop(*[f"_m_{c}" for c in s])
    own = F.struct(hash_key(id_col, seed).alias("_h"), F.col(id_col))
    part = F.lit(names[-1])
    for k in range(len(names) - 2, -1, -1):
        cut = F.col(f"_cut{k}")
        part = F.when(cut.isNull() | (own < cut), F.lit(names[k])).otherwise(part)
    return rows.withColumn(out, part).drop(*[f"_cut{k}" for k in range(len(names) - 1)])


def validate_split_sizes(train: float, valid: float, min_size: float = 0.05) -> None:
    test = (1.0 - train) * (1.0 - valid)
    if not (0 <= train <= 1 and 0 <= valid <= 1):
        raise ValueError("split fractions must be within [0, 1]")
    if train < min_size or test < min_size or valid * (1.0 - train) < min_size:
        raise ValueError(f"split sizes too small: train={train}, val={valid * (1 - train)}, test={test}")


def stratified_split3(df: DataFrame, strata: Sequence[str], label: str = "label",
                      id_col: str = "id", train: float = 0.7, valid: float = 0.3,
                      seed=7, hex_digits: int = 4, out: str = "split") -> DataFrame:
    """Per stratum×label, ``floor(n·train)`` rows to train; of the rest,
    ``floor(rest·valid)`` to valid, the remainder to test (70/9/21 by
    default, as the reference's two chained splits)."""
    validate_split_sizes(train, valid)

    def cuts(n):
        n_train = _share(n, train)
        return n_train, n_train + _share(n - n_train, valid)
    return cut_by_rank(df, [*strata, label], id_col, seed, cuts, ("train", "valid", "test"), out, hex_digits).na.drop("any")


def split_half(df: DataFrame, label: str | None = "label", id_col: str = "id",
               test_size: float = 0.5, seed=50, strata: Sequence[str] = (),
               hex_digits: int = 4, out: str = "split") -> DataFrame:
    """Re-split one split into ``valid``/``test`` with ``ceil(n·test)``
    test rows per stratum (stratified by ``label`` when present)."""
    s = list(strata) + ([label] if label and label in df.columns else [])
    return cut_by_rank(df, s, id_col, seed, lambda n: (n - _share(n, test_size, up=True),), ("valid", "test"), out, hex_digits)


def text_key(text_col: str) -> Column:
    """Normalised-text hash used for leakage checks (case, whitespace)."""
    from ..functions.text import normalize_ws
    return F.md5(F.lower(normalize_ws(F.col(text_col))))


def split_leakage(df: DataFrame, split: str = "split", text_col: str = "text",
                  group: Sequence[str] = ()) -> DataFrame:
    """For every ordered pair of different splits, the number of distinct
    normalised texts present in both.  Each text's split set has at most as
    many members as there are splits, so pairs are formed inside that tiny
    array — no self-join, no per-text fan-out beyond #splits²."""
    g = list(group)
    sets = (df.select(*g, text_key(text_col).alias("_k"), F.col(split).alias("_s"))
            .groupBy(*g, "_k").agg(F.array_sort(F.collect_set("_s")).alias("_ss"))
            .where(F.size("_ss") > 1))
    pairs = sets.select(*g, F.explode("_ss").alias("split_a"), "_ss") \
        .select(*g, "split_a", F.explode("_ss").alias("split_b")) \
        .where(F.col("split_a") != F.col("split_b"))
    return pairs.groupBy(*g, "split_a", "split_b").agg(F.count("*").alias("n_shared"))


def purge_leaks(df: DataFrame, split: str = "split", text_col: str = "text",
                keep_priority: Sequence[str] = ("train", "valid", "test")) -> DataFrame:
    """Remove a row when its normalised text also occurs in a split of
    higher priority (train wins, then valid).  One pass: the best priority
    per text key is a partial-aggregated ``min`` (safe for a hot text), then
    rows keep only if they belong to that best split."""
    pos = F.array_position(F.array(*[F.lit(x) for x in keep_priority]), F.col(split))
    prio = F.when(pos == 0, F.lit(len(keep_priority) + 1)).otherwise(pos)  # unknown splits rank last
    keyed = df.withColumn("_k", text_key(text_col)).withColumn("_p", prio)
    best = keyed.groupBy("_k").agg(F.min("_p").alias("_best"))
    return keyed.join(best, "_k").where(F.col("_p") == F.col("_best")).drop("_k", "_p", "_best")
