"""Descriptive statistics from value counts, and mergeable sketches against exact ones."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from varieta.operators import metrics as M


def _scores(spark):
    rng = random.Random(11)
    rows = [("hot", float(rng.choice([0, 0, 0, 1, 2, rng.expovariate(0.01)]))) for _ in range(6000)]
    rows += [(None, rng.gauss(0, 1)) for _ in range(500)] + [("one", 4.0), ("none", None), ("none", None), ("hot", None)]
    return rows, spark.createDataFrame(rows, "g string, x double").repartition(6)


def test_statistics_equal_numpy_and_keep_empty_groups(spark):
    rows, df = _scores(spark)
    got = {r.g: r for r in M.score_stats(df, "x", ["g"], digits=9).collect()}
    assert set(got) == {"hot", None, "one", "none"}
    for g in ("hot", None):
        x = np.array([v for k, v in rows if k == g and v is not None])
        want = (x.mean(), x.std(ddof=1), x.min(), *np.quantile(x, (0.25, 0.5, 0.75)), x.max())
        assert got[g].n == len(x)
        assert np.allclose([got[g][c] for c in ("mean", "std", "min", "q25", "q50", "q75", "max")], want, atol=1e-7)
    assert (got["one"].n, got["one"].std, got["one"].q50) == (1, None, 4.0)
    assert (got["none"].n, got["none"].mean, got["none"].q50) == (0, None, None)


def test_box_by_hand(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100, 100]] + [(None,)], "x double")
    r = M.box_stats(df, "x").first()
    q1, med, q3 = np.quantile([1, 2, 3, 4, 5, 6, 7, 8, 100, 100], (0.25, 0.5, 0.75))
    assert (r.q1, r.med, r.q3, r.whisker_lo, r.whisker_hi, r.n_outliers) == (q1, med, q3, 1.0, 8.0, 2)


def test_readers_share_one_exchange(spark, tmp_path):
    _scores(spark)[1].write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out, scans in ((M.box_stats(df, "x", ["g"]), 1), (M.score_stats(df, "x", ["g"]), 2)):
            out.collect()
            plan = out._jdf.queryExecution().executedPlan().toString()
            final = plan.split("Initial Plan")[0]
            assert "ReusedExchange" in final and final.count("Scan parquet") == scans, final
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sketches_keep_the_stated_rank_error(spark):
    rows, df = _scores(spark)
    probs = (0.01, 0.25, 0.5, 0.9, 0.99)
    whole = M.score_sketch(df, "x", ["g"])
    halves = M.score_sketch(df.where("x < 1"), "x", ["g"]).unionByName(M.score_sketch(df.where("x >= 1 OR x IS NULL"), "x", ["g"]))
    for sketches in (whole, M.merge_sketches(halves, ["g"])):
        got = {r.g: r for r in M.sketch_quantiles(sketches, probs, ["g"]).collect()}
        assert set(got) == {"hot", None, "one", "none"}
        assert got["none"].n == 0 and got["none"].q50 is None and got["one"].q50 == 4.0
        for g in ("hot", None):
            x = np.sort([v for k, v in rows if k == g and v is not None])
            assert got[g].n == len(x) and math.isclose(got[g].mean, x.mean(), rel_tol=1e-9)
            for p in probs:
                v = got[g][f"q{int(round(p * 100))}"]
                low, high = np.searchsorted(x, v, "left") / len(x), np.searchsorted(x, v, "right") / len(x)
                slack = M.sketch_rank_error() + 1 / len(x)
                assert low - slack <= p <= high + slack
    assert M.sketch_rank_error(400) < M.sketch_rank_error() < 0.02
    assert M.sketch_quantiles(M.score_sketch(df.where(F.lit(False)), "x", ["g"]), probs, ["g"]).collect() == []
