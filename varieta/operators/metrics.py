"""Classification metrics and descriptive aggregates.

All metrics are two-level hash aggregates: a map-side partial aggregate of
per-class counts (tp, predicted, support) keyed by the grouping columns and
the class, then a tiny per-group aggregate over classes.  Nothing is
collected; any number of (model, task, variety, domain) groups is scored in
one job, and a hot group is pre-aggregated on every mapper before the
shuffle, so skew does not concentrate rows in one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _safe_div(num: Column, den: Column) -> Column:
    """``num / den`` with 0/0 -> 0 (the scikit-learn ``zero_division=0`` rule)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def attach(df: DataFrame, per_group: DataFrame, group: Sequence[str]) -> DataFrame:
    """Join a per-group aggregate back onto rows.  With no grouping the
    aggregate is exactly one row: it becomes a scalar subquery (evaluated
    once and shipped as a value), not a join."""
    g = list(group)
    if g:
        return _join_null_safe(df, per_group, g)
    row = per_group.select(F.struct(*per_group.columns).alias("_s")).scalar()
    return df.select("*", *[row[c].alias(c) for c in per_group.columns])


def class_counts(df: DataFrame, group: Sequence[str] = (), label: str = "label",
                 prediction: str = "prediction") -> DataFrame:
    """Per (group…, cls): support, predicted, tp.

    The class set is the union of true and predicted labels (a class that is
    only ever predicted still appears, with support 0)."""
    rows = F.explode(F.array(
        F.struct(F.col(label).alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p"),
                 (F.col(label) == F.col(prediction)).cast("int").alias("tp")),
        F.struct(F.col(prediction).alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"),
                 F.lit(0).alias("tp")),
    ))
    g = list(group)
    return (df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
            .select(*g, rows.alias("r"))
            .groupBy(*g, F.col("r.cls").alias("cls"))
            .agg(F.sum("r.t").alias("support"), F.sum("r.p").alias("predicted"),
                 F.sum("r.tp").alias("tp")))


def per_class_metrics(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and F1 (``2tp / (support + predicted)``)."""
    return (counts
            .withColumn("precision", _safe_div(F.col("tp"), F.col("predicted")))
            .withColumn("recall", _safe_div(F.col("tp"), F.col("support")))
            .withColumn("f1", _safe_div(2 * F.col("tp"), F.col("support") + F.col("predicted"))))


def macro_prf(df: DataFrame, group: Sequence[str] = (), label: str = "label",
              prediction: str = "prediction") -> DataFrame:
    """Macro-averaged precision / recall / F1 per group (+ n, accuracy)."""
    pc = per_class_metrics(class_counts(df, group, label, prediction))
    return (pc.groupBy(*group)
            .agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                 F.avg("f1").alias("f1_score"),
                 F.sum("support").alias("n"),
                 (F.sum("tp") / F.sum("support")).alias("accuracy")))


def weighted_f1(df: DataFrame, group: Sequence[str] = (), label: str = "label",
                prediction: str = "prediction") -> DataFrame:
    """Support-weighted precision / recall / F1 per group."""
    pc = per_class_metrics(class_counts(df, group, label, prediction))
    tot = F.sum("support")
    return (pc.groupBy(*group)
            .agg(_safe_div(F.sum(F.col("precision") * F.col("support")), tot).alias("precision"),
                 _safe_div(F.sum(F.col("recall") * F.col("support")), tot).alias("recall"),
                 _safe_div(F.sum(F.col("f1") * F.col("support")), tot).alias("f1_score")))


def classification_report(df: DataFrame, group: Sequence[str] = (), label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Per-class rows + ``accuracy`` + ``macro avg`` + ``weighted avg``.

    Columns: group…, ``row`` (class label as text or summary name),
    precision, recall, f1_score, support.  The accuracy row carries the
    accuracy in ``f1_score`` and null precision/recall, as the text report."""
    g = list(group)
    pc = per_class_metrics(class_counts(df, g, label, prediction))
    per_class = pc.select(*g, F.col("cls").cast("string").alias("row"),
                          "precision", "recall", F.col("f1").alias("f1_score"),
                          F.col("support").cast("long").alias("support"))
    tot = F.sum("support")
    summary = pc.groupBy(*g).agg(
        (F.sum("tp") / tot).alias("acc"), tot.alias("n"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        _safe_div(F.sum(F.col("precision") * F.col("support")), tot).alias("wp"),
        _safe_div(F.sum(F.col("recall") * F.col("support")), tot).alias("wr"),
        _safe_div(F.sum(F.col("f1") * F.col("support")), tot).alias("wf"))
    rows = F.explode(F.array(
        F.struct(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1_score")),
        F.struct(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1_score")),
        F.struct(F.lit("weighted avg").alias("row"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1_score")),
    ))
    summ = summary.select(*g, rows.alias("x"), F.col("n").cast("long").alias("support")) \
        .select(*g, "x.row", "x.precision", "x.recall", "x.f1_score", "support")
    return per_class.unionByName(summ)


def report_text(report: DataFrame, group: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """A10: fixed-width report lines (one row per line), ready for ``write.text``;
    a row without precision (accuracy) leaves the first two fields blank."""
    fmt = f"%12s %9.{digits}f %9.{digits}f %9.{digits}f %9d"
    line = F.when(F.col("precision").isNull(),
                  F.format_string(f"%12s %9s %9s %9.{digits}f %9d", F.col("row"), F.lit(""),
                                  F.lit(""), F.col("f1_score"), F.col("support"))) \
        .otherwise(F.format_string(fmt, F.col("row"), F.col("precision"), F.col("recall"),
                                   F.col("f1_score"), F.col("support")))
    return report.select(*group, "row", line.alias("line"))


def binary_prf_acc(df: DataFrame, group: Sequence[str] = (), label: str = "label",
                   prediction: str = "prediction", positive: int = 1) -> DataFrame:
    """Positive-class precision / recall / F1 + accuracy."""
    y, p = F.col(label), F.col(prediction)
    tp = F.sum(((y == positive) & (p == positive)).cast("int"))
    pp = F.sum((p == positive).cast("int"))
    ap = F.sum((y == positive).cast("int"))
    return (df.groupBy(*group)
            .agg(tp.alias("tp"), pp.alias("pp"), ap.alias("ap"),
                 F.avg((y == p).cast("double")).alias("accuracy"))
            .select(*group, _safe_div(F.col("tp"), F.col("pp")).alias("precision"),
                    _safe_div(F.col("tp"), F.col("ap")).alias("recall"),
                    _safe_div(2 * F.col("tp"), F.col("pp") + F.col("ap")).alias("f1"),
                    "accuracy"))


def accuracy(df: DataFrame, group: Sequence[str] = (), label: str = "label",
             prediction: str = "prediction") -> DataFrame:
    """E12."""
    return df.groupBy(*group).agg(
        F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def confusion_matrix(df: DataFrame, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """E7 (long form): every (a, b) cell over the sorted label union,
    zero cells included.  The per-group label set (bounded by the number of
    classes) is collected once and crossed with itself by two generators on
    that one row — no join; cells are a map-side combined count."""
    g = list(group)
    cells = df.groupBy(*g, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    labels = (df.select(*g, F.explode(F.array(F.col(a), F.col(b))).alias("v"))
              .where(F.col("v").isNotNull())
              .groupBy(*g).agg(F.array_sort(F.collect_set("v")).alias("_ls")))
    spine = labels.select(*g, F.explode("_ls").alias("a"), "_ls").select(*g, "a", F.explode("_ls").alias("b"))
    return _join_null_safe(spine, cells, g + ["a", "b"], "left") \
        .select(*g, "a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cohen_kappa(df: DataFrame, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """``(po - pe) / (1 - pe)`` with pe from the two marginals."""
    g = list(group)
    base = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    tot = base.groupBy(*g).agg(F.count("*").alias("n"),
                               F.sum((F.col(a) == F.col(b)).cast("long")).alias("agree"))
    ma = base.groupBy(*g, F.col(a).alias("v")).agg(F.count("*").alias("na"))
    mb = base.groupBy(*g, F.col(b).alias("v")).agg(F.count("*").alias("nb"))
    pe = _join_null_safe(ma, mb, g + ["v"]).groupBy(*g).agg(
        F.sum(F.col("na").cast("double") * F.col("nb")).alias("pp"))
    j = _join_null_safe(tot, pe, g, "left") if g else attach(tot, pe, g)
    po = F.col("agree") / F.col("n")
    pee = F.coalesce(F.col("pp"), F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return j.select(*g, F.when(pee == 1.0, F.lit(None).cast("double"))
                    .otherwise((po - pee) / (1 - pee)).alias("kappa"))


def label_counts(df: DataFrame, label: str = "label", group: Sequence[str] = ()) -> DataFrame:
    """E1."""
    return df.groupBy(*group, label).agg(F.count("*").alias("n"))


def label_shares(df: DataFrame, label: str = "label", group: Sequence[str] = (),
                 digits: int = 2) -> DataFrame:
    """Count and percent of the group total.  The total is a second
    tiny aggregate joined back (no unpartitioned window over all rows)."""
    g = list(group)
    c = label_counts(df, label, g)
    tot = c.groupBy(*g).agg(F.sum("n").alias("total"))
    j = attach(c, tot, g)
    return j.select(*g, label, "n", F.round(100.0 * F.col("n") / F.col("total"), digits).alias("pct"))


def split_balance(df: DataFrame, group: Sequence[str] = ("split",), label: str = "label",
                  classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Per split n and count / percent of each class (absent class -> 0)."""
    aggs = [F.count("*").alias("n")]
    for c in classes:
        aggs.append(F.sum((F.col(label) == c).cast("long")).alias(f"n_{c}"))
    out = df.groupBy(*group).agg(*aggs)
    for c in classes:
        out = out.withColumn(f"pct_{c}", F.round(100.0 * F.col(f"n_{c}") / F.col("n"), 1))
    return out


def class_weights(df: DataFrame, label: str = "label", group: Sequence[str] = ()) -> DataFrame:
    """``n / (2 * n_c)`` per class: the two-class balance, whatever classes
    a group holds."""
    g = list(group)
    c = label_counts(df, label, g)
    j = attach(c, c.groupBy(*g).agg(F.sum("n").alias("total")), g)
    return j.select(*g, label, (F.col("total") / (2 * F.col("n"))).alias("weight"))


def value_counts(df: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    """(group..., v, c): the non-null values and how often they stand there, by
    a map-side combined aggregate.  Everything the descriptive statistics need
    is in this table; a plan that reads it several times shuffles the input
    once (the exchange is reused)."""
    x = F.col(col).cast("double")
    return df.select(*group, x.alias("v")).where(F.col("v").isNotNull()).groupBy(*group, "v").agg(F.count("*").alias("c"))


def score_stats(df: DataFrame, col: str, group: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear), max.  The
    input is read twice: with nulls, which keep groups without any value
    (count 0, nulls), and without."""
    g = list(group)
    x = F.col(col).cast("double")
    # null values stay in the counts as one row a group, so that groups without values stay too
    vc = df.select(*g, x.alias("v")).groupBy(*g, "v").agg(F.count("*").alias("c"))
    known = vc.where(F.col("v").isNotNull())
    n = F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0))
    basic = vc.groupBy(*g).agg(n.alias("n"), F.sum(F.col("v") * F.col("c")).alias("_s"), F.min("v").alias("min"), F.max("v").alias("max")) \
        .withColumn("mean", F.when(F.col("n") > 0, F.col("_s") / F.col("n"))).drop("_s")
    # the spread around the mean: no difference of large squares
    around = attach(known, basic.select(*g, "mean", "n"), g).groupBy(*g).agg(
        F.sum(F.col("c") * (F.col("v") - F.col("mean")) ** 2).alias("_ss"))
    q = quantiles_of_counts(known, (0.25, 0.5, 0.75), g, ("q25", "q50", "q75"))
    j = basic
    for part in (around, q):
        j = _join_null_safe(j, part, g, "left") if g else attach(j, part, g)
    std = F.when(F.col("n") > 1, F.sqrt(F.col("_ss") / (F.col("n") - 1)))
    return j.withColumn("std", std).select(*g, "n", *[F.round(F.col(c), digits).alias(c)
                                                      for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


# -- mergeable sketches ------------------------------------------------------------
# Rank error of a KLL sketch with parameter k, at 99 % confidence (published with the algorithm).
SKETCH_K = 200


def sketch_rank_error(k: int = SKETCH_K) -> float:
    """Share of rows by which the rank of a returned quantile may be off, with
    99 % confidence: 2.446 / k^0.943 (about 1.65 % at k = 200)."""
    return 2.446 / k ** 0.943


def score_sketch(df: DataFrame, col: str, group: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """E16 in mergeable form: (group..., n, total, low, high, sketch) in one
    pass with map-side partial sketches.  Rows of such tables (one a day, one a
    partition) are put together by ``merge_sketches``; a group holds some
    kilobytes whatever its size.  NaN counts as no value; a group without
    values has n = 0 and a null sketch."""
    x = F.col(col).cast("double")
    v = F.when(~F.isnan(x), x)
    return df.select(*group, v.alias("_v")).groupBy(*group).agg(
        F.count("_v").alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("low"), F.max("_v").alias("high"),
        F.kll_sketch_agg_double("_v", F.lit(k)).alias("_sk")).select(
            *group, "n", "total", "low", "high", F.when(F.col("n") > 0, F.col("_sk")).alias("sketch"))


def merge_sketches(sketches: DataFrame, group: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """Sketch rows of the same group put together; null sketches add nothing."""
    return sketches.groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("_sk")).select(
            *group, "n", "total", "low", "high", F.when(F.col("n") > 0, F.col("_sk")).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float], group: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """(group..., n, mean, min, one column a probability, max) of sketch rows:
    values of the data whose rank is within ``sketch_rank_error`` of the asked."""
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    at = [F.when(F.col("sketch").isNotNull(), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias(nm) for p, nm in zip(probs, names)]
    return sketches.select(*group, "n", (F.col("total") / F.when(F.col("n") > 0, F.col("n"))).alias("mean"), F.col("low").alias("min"), *at,
                           F.col("high").alias("max"))


def histogram(df: DataFrame, col: str, group: Sequence[str] = (), bins: int = 30) -> DataFrame:
    """Equal-width bins between the group's min and max (last bin closed),
    zero bins included."""
    g = list(group)
    x = F.col(col).cast("double")
    rng = df.groupBy(*g).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((x - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    j = attach(df, rng, g)
    counts = j.where(x.isNotNull()).groupBy(*g, b.alias("bin")).agg(F.count("*").alias("n"))
    spine = rng.select(*g, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("hi") - F.col("lo")) / bins
    return (_join_null_safe(spine, counts, g + ["bin"], "left")
            .select(*g, "bin", (F.col("lo") + F.col("bin") * w).alias("left"),
                    (F.col("lo") + (F.col("bin") + 1) * w).alias("right"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def box_stats(df: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    """Quartiles, 1.5·IQR whiskers (most extreme values inside the
    fences) and the outlier count; one scan."""
    g = list(group)
    vc = value_counts(df, col, g)
    q = quantiles_of_counts(vc, (0.25, 0.5, 0.75), g, ("q1", "med", "q3"))
    q = q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
        .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = attach(vc, q, g)
    x = F.col("v")
    inside = (x >= F.col("lo_fence")) & (x <= F.col("hi_fence"))
    return j.groupBy(*g, "q1", "med", "q3").agg(
        F.min(F.when(inside, x)).alias("whisker_lo"), F.max(F.when(inside, x)).alias("whisker_hi"),
        F.sum(F.when(~inside, F.col("c")).otherwise(0)).alias("n_outliers"))


def mean_by_group(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """E6."""
    return df.groupBy(*group).agg(F.avg(value).alias(f"mean_{value}"))


def best_worst(df: DataFrame, key: str, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Key with the highest and lowest mean value per group."""
    g = list(group)
    m = df.groupBy(*g, key).agg(F.avg(value).alias("m"))
    return m.groupBy(*g).agg(F.max_by(key, F.struct("m", key)).alias("best"),
                             F.max("m").alias("best_mean"),
                             F.min_by(key, F.struct("m", key)).alias("worst"),
                             F.min("m").alias("worst_mean"))


def pivot_matrix(df: DataFrame, rows: Sequence[str], col: str, value: str,
                 order: Sequence[str] | None = None) -> DataFrame:
    """One value per (rows, col) — a duplicate key is an error, detected
    lazily as a null-producing ``raise_error`` in the cell expression.  The
    columns are ``order``, or all values of ``col`` if none is given."""
    cell = F.when(F.count("*") > 1,
                  F.raise_error(F.lit(f"duplicate ({', '.join(rows)}, {col}) key in pivot"))) \
        .otherwise(F.first(value))
    long = df.groupBy(*rows, col).agg(cell.alias("v"))
    return long.groupBy(*rows).pivot(col, list(order) if order else None).agg(F.first("v"))


def pivot_mean(df: DataFrame, row: str, col: str, value: str, order: Sequence[str] | None = None,
               digits: int = 3) -> DataFrame:
    """Pivot-table mean, rounded half-to-even, missing cells null; the
    columns are ``order``, or all values of ``col`` if none is given."""
    return df.groupBy(row).pivot(col, list(order) if order else None).agg(F.bround(F.avg(value), digits))


def sliced_f1(df: DataFrame, slice_col: str, group: Sequence[str] = (),
              label: str = "label", prediction: str = "prediction",
              slices: Sequence = (False, True)) -> DataFrame:
    """Positive-class F1 and count for each slice value (0 for an empty
    slice) and the drop F1(first) - F1(second).

    One grouped aggregate: the slice values are a fixed short list, so each
    group gets conditional counts per slice in a single pass (map-side
    partial aggregation), and the per-slice rows come from exploding a fixed
    array — no spine join and no self-join for the drop, so the input is
    read once."""
    g = list(group)
    y, p, s = F.col(label), F.col(prediction), F.col(slice_col)
    aggs = []
    for i, v in enumerate(slices):
        inside = s == F.lit(v)
        aggs += [F.count_if(inside).alias(f"_n{i}"),
                 F.count_if(inside & (y == 1) & (p == 1)).alias(f"_tp{i}"),
                 F.count_if(inside & (p == 1)).alias(f"_pp{i}"),
                 F.count_if(inside & (y == 1)).alias(f"_ap{i}")]
    a = df.groupBy(*g).agg(*aggs)
    f1 = [_safe_div(2 * F.col(f"_tp{i}"), F.col(f"_pp{i}") + F.col(f"_ap{i}")) for i in range(len(slices))]
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("slice"), F.col(f"_n{i}").alias("n"), f1[i].alias("f1"))
                               for i, v in enumerate(slices)]))
    return (a.select(*g, rows.alias("_r"), (f1[0] - f1[1]).alias("drop"))
            .select(*g, "_r.slice", "_r.n", "_r.f1", "drop"))


def log_softmax_at(logits: Column, index: Column) -> Column:
    """``log softmax(z)[index]`` (0-based index), computed stably."""
    z = F.transform(logits, lambda v: v.cast("double"))
    mx = F.array_max(z)
    shifted = F.zip_with(z, F.array_repeat(mx, F.size(z)), lambda v, m: F.exp(v - m))
    lse = mx + F.log(F.aggregate(shifted, F.lit(0.0), lambda acc, v: acc + v))
    return F.element_at(z, index + 1) - lse


def weighted_ce_loss(df: DataFrame, logits: str, label: str, weight: str,
                     group: Sequence[str] = ()) -> DataFrame:
    """Class-weighted cross entropy, weighted-mean reduction:
    ``sum(w_y * -log softmax(z)_y) / sum(w_y)``."""
    nll = -log_softmax_at(F.col(logits), F.col(label))
    w = F.col(weight)
    return df.groupBy(*group).agg((F.sum(w * nll) / F.sum(w)).alias("loss"))


def share_of_total(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """``value`` / its group total.  The total is a map-side combined sum
    joined back on the group keys (null keys match; a scalar when there is
    no group), so no group is gathered into one window partition."""
    g = list(group)
    tot = df.groupBy(*g).agg(F.sum(value).alias("_tot"))
    j = _join_null_safe(df, tot, g) if g else attach(df, tot, g)
    return j.withColumn("share", F.col(value) / F.col("_tot")).drop("_tot")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null keys match (group keys may be null);
    keeps the left columns plus the right non-key columns."""
    cond = [left[k].eqNullSafe(right[k]) for k in keys]
    extra = [right[c] for c in right.columns if c not in keys]
    return left.join(right, cond, how).select(left["*"], *extra)


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float],
                    group: Sequence[str] = (), names: Sequence[str] | None = None,
                    buckets: int = 256) -> DataFrame:
    """Exact linear-interpolated quantiles without holding a group in one task
    (``quantiles_of_counts`` of the values' counts); the input is read once."""
    return quantiles_of_counts(value_counts(df, col, group), probs, group, names, buckets)


def quantiles_of_counts(vc: DataFrame, probs: Sequence[float], group: Sequence[str] = (),
                        names: Sequence[str] | None = None, buckets: int = 256) -> DataFrame:
    """Exact linear-interpolated quantiles of a (group..., v, c) table.

    1. Values come reduced to (group, value, count) by a map-side combined
       aggregate.
    2. Each group's value line is cut into ``buckets`` ordered ranges at
       approximate quantiles of its distinct values (a bounded sketch per
       group); any cut points give the same exact answer, the sketch only
       balances the ranges.
    3. Counts per (group, range) and their running offsets are a table of at
       most ``buckets`` rows per group.
    4. The running count inside (group, range) is a window whose partitions
       hold about 1/``buckets`` of a group's distinct values, so a group with
       a third of all rows is still spread over many tasks.

    The value at rank r is then ``min(v) where cum > r``."""
    g = list(group)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    cuts = [i / buckets for i in range(1, buckets)]
    # naming the count keeps this reader's columns those of the others, so that they share one exchange
    bounds = vc.where(F.col("c") > 0).groupBy(*g).agg(F.percentile_approx("v", cuts, 10000).alias("_cuts"))
    if g:
        vb = _join_null_safe(vc, bounds, g)
    else:
        vb = attach(vc, bounds, g)
    vb = vb.withColumn("_b", F.size(F.filter("_cuts", lambda b: b < F.col("v")))).drop("_cuts")
    per_b = vb.groupBy(*g, "_b").agg(F.sum("c").alias("_bc"))
    before = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (per_b.withColumn("_off", F.coalesce(F.sum("_bc").over(before), F.lit(0)))
               .withColumn("n", F.sum("_bc").over(Window.partitionBy(*g))).drop("_bc"))
    vb = _join_null_safe(vb, offsets, g + ["_b"])
    inside = Window.partitionBy(*g, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    vc = vb.withColumn("cum", F.col("_off") + F.sum("c").over(inside))
    aggs = []
    for p, nm in zip(probs, names):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        vc = vc.withColumn(f"_lo_{nm}", F.when(F.col("cum") > lo, F.col("v"))) \
            .withColumn(f"_hi_{nm}", F.when(F.col("cum") > hi, F.col("v"))) \
            .withColumn(f"_f_{nm}", pos - lo)
        aggs += [F.min(f"_lo_{nm}").alias(f"_lo_{nm}"), F.min(f"_hi_{nm}").alias(f"_hi_{nm}"),
                 F.first(f"_f_{nm}").alias(f"_f_{nm}")]
    out = vc.groupBy(*g).agg(*aggs)
    return out.select(*g, *[(F.col(f"_lo_{nm}") + F.col(f"_f_{nm}")
                             * (F.col(f"_hi_{nm}") - F.col(f"_lo_{nm}"))).alias(nm)
                            for nm in names])
