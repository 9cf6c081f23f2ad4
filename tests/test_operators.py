"""Operator invariants and hand-computed goldens (metrics, splits, kNN,
code-mixing, sources)."""

import math
import tempfile
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varieta.functions import codemix as CM
from varieta.functions import rules as R
from varieta.operators import knn as KN
from varieta.operators import metrics as M
from varieta.operators import split as SP
from varieta.sources import files as FS


def test_report_label_union_and_zero_division(spark):
    # class 2 is only predicted (support 0); class 1 never predicted
    rows = [(0, 0), (0, 0), (1, 0), (1, 2), (0, 2)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    rep = {r["row"]: r for r in M.classification_report(df).collect()}
    assert set(rep) == {"0", "1", "2", "accuracy", "macro avg", "weighted avg"}
    assert rep["2"]["support"] == 0 and rep["2"]["precision"] == 0.0
    assert rep["1"]["precision"] == 0.0 and rep["1"]["recall"] == 0.0
    p0, r0 = 2 / 3, 2 / 3
    assert math.isclose(rep["0"]["f1_score"], 2 * p0 * r0 / (p0 + r0))
    assert math.isclose(rep["accuracy"]["f1_score"], 2 / 5)
    assert math.isclose(rep["macro avg"]["precision"], (2 / 3) / 3)


def test_macro_prf_matches_definition(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 1), rnd.randint(0, 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    got = M.macro_prf(df).first()
    ps, rs, fs = [], [], []
    for c in (0, 1):
        tp = sum(1 for y, p in rows if y == c and p == c)
        pp = sum(1 for _, p in rows if p == c)
        ap = sum(1 for y, _ in rows if y == c)
        ps.append(tp / pp if pp else 0.0)
        rs.append(tp / ap if ap else 0.0)
        fs.append(2 * tp / (pp + ap) if pp + ap else 0.0)
    assert math.isclose(got["precision"], sum(ps) / 2)
    assert math.isclose(got["recall"], sum(rs) / 2)
    assert math.isclose(got["f1_score"], sum(fs) / 2)


def test_cohen_kappa_golden(spark):
    a = [0, 0, 1, 1, 2, 2, 0, 1]
    b = [0, 1, 1, 1, 2, 0, 0, 2]
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    got = M.cohen_kappa(df, "a", "b").first()["kappa"]
    n = len(a)
    po = sum(x == y for x, y in zip(a, b)) / n
    pe = sum((a.count(v) / n) * (b.count(v) / n) for v in set(a) | set(b))
    assert math.isclose(got, (po - pe) / (1 - pe))


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(9)
    vals = [rnd.randint(0, 50) for _ in range(301)]
    df = spark.createDataFrame([(v % 3, v) for v in vals], "g int, x int")
    got = {r["g"]: r for r in M.exact_quantiles(df, "x", (0.25, 0.5, 0.9), ["g"]).collect()}
    for g in range(3):
        xs = np.array([v for v in vals if v % 3 == g], dtype=float)
        for p, nm in ((0.25, "q25"), (0.5, "q50"), (0.9, "q90")):
            assert math.isclose(got[g][nm], float(np.quantile(xs, p)), abs_tol=1e-9)


def test_exact_quantiles_bucketed_hot_group_and_global(spark):
    """A hot group (most rows), a null group key, heavy ties and continuous
    values; few buckets so ranks cross many range boundaries."""
    rnd = random.Random(11)
    rows = [("hot", float(rnd.choice([1, 2, 2, 2, 3]) if i % 4 else rnd.random() * 100)) for i in range(900)]
    rows += [(None, float(rnd.randint(0, 9))) for _ in range(57)] + [("one", 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    names = ("p0", "p25", "p50", "p75", "p90", "p100")
    for b in (3, 16, 256):
        got = {r["g"]: r for r in M.exact_quantiles(df, "x", probs, ["g"], names, buckets=b).collect()}
        for g in ("hot", None, "one"):
            xs = np.array([v for k, v in rows if k == g])
            for p, nm in zip(probs, names):
                assert math.isclose(got[g][nm], float(np.quantile(xs, p)), abs_tol=1e-9), (b, g, p)
        whole = M.exact_quantiles(df, "x", probs, (), names, buckets=b).first()
        xs = np.array([v for _, v in rows])
        for p, nm in zip(probs, names):
            assert math.isclose(whole[nm], float(np.quantile(xs, p)), abs_tol=1e-9), (b, p)


def test_split_invariants(spark):
    rows = [(i, "t", "v" if i % 3 else "w", "d", i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, task string, variety string, domain string, label int")
    a = SP.stratified_split3(df.repartition(1), ["task", "variety", "domain"]).select("id", "split")
    b = SP.stratified_split3(df.repartition(7), ["task", "variety", "domain"]).select("id", "split")
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.count() == 2000 and a.select("id").distinct().count() == 2000
    sizes = {(r["variety"], r["label"], r["split"]): r["count"] for r in
             SP.stratified_split3(df, ["task", "variety", "domain"]).groupBy("variety", "label", "split").count().collect()}
    for v in ("v", "w"):
        for lab in (0, 1):
            n = sum(1 for r in rows if r[2] == v and r[4] == lab)
            ntr = n * 7 // 10
            nva = (n - ntr) * 3 // 10
            assert sizes[(v, lab, "train")] == ntr
            assert sizes[(v, lab, "valid")] == nva
            assert sizes[(v, lab, "test")] == n - ntr - nva


def test_split_rejects_tiny_parts():
    with pytest.raises(ValueError):
        SP.validate_split_sizes(0.99, 0.5)


def test_knn_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(0)
    V = rng.integers(-2, 3, size=(60, 4)).astype(float)  # many exact ties
    labels = [0] * 57 + [1] * 3                           # class 1 smaller than K/2 for K=8
    df = spark.createDataFrame([(i, V[i].tolist(), labels[i]) for i in range(60)],
                               "id long, v array<double>, label int")
    got = KN.knn_topk(df, df, 5, q_id="id", q_vec="v", t_id="id", t_vec="v", t_rows=20, q_rows=30)
    got = {(r["qid"], r["rank"]): r["tid"] for r in got.collect()}
    S = V @ V.T
    for q in range(60):
        order = sorted(range(60), key=lambda t: (-S[q, t], t))[:5]
        assert [got[(q, k + 1)] for k in range(5)] == order
    con = KN.knn_contrastive(df, df, 8, q_id="id", q_vec="v", t_id="id", t_vec="v", t_label="label",
                             t_rows=30, q_rows=60)
    per = con.groupBy("qid", "tlabel").count().collect()
    assert {(r["tlabel"], r["count"]) for r in per} == {(0, 4), (1, 3)}
    with pytest.raises(ValueError):
        KN.knn_contrastive(df, df, 3, q_id="id", q_vec="v", t_id="id", t_vec="v", t_label="label")


# (text, share of flagged words, changes, score, tagged), worked out by hand:
# eligible words have four letters or more; seeds count, common words do not.
DETECTOR_CASES = [("plain english sentence here", 0.0, 0, 0.0, False), ("", 0.0, 0, 0.0, False), ("abc de", 0.0, 0, 0.0, False),
                  ("shopping chairs cheese", 0.0, 0, 0.0, False), ("matlab yaar", 1.0, 0, 0.7, True),
                  ("yaar plain yaar plain", 0.5, 3, 0.7 + 0.3 * 3 / 5, True), ("see https://x.y/yaar now", 0.0, 0, 0.0, False)]


def test_knn_leaves_unusable_vectors_out(spark):
    good = [(i, [float(i), 1.0], i % 2) for i in range(1, 6)]
    bad = [(10, None, 0), (11, [], 0), (12, [1.0], 0), (13, [None, 1.0], 1), (14, [float("nan"), 1.0], 1), (15, [float("inf"), 1.0], 0),
           (None, [9.0, 9.0], 1)]
    df = spark.createDataFrame(good + bad, "id long, v array<double>, label int")
    named = dict(q_id="id", q_vec="v", t_id="id", t_vec="v", t_label="label")
    got = KN.knn_topk(df, df, 2, **named).collect()
    assert {r.qid for r in got} == {r.tid for r in got} | {1, 2, 3} == {1, 2, 3, 4, 5}
    assert [r.tid for r in sorted(got, key=lambda r: (r.qid, r["rank"]))] == [5, 4] * 5
    assert KN.knn_topk(df, df.where("id IN (10, 11, 13, 14, 15)"), 2, **named).collect() == []


def test_detector_by_hand(spark):
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(DETECTOR_CASES)], "id long, text string")
    common = spark.createDataFrame([(w,) for w in ("shopping", "chairs", "cheese", "sentence", "plain", "english", "here")], "word string")
    got = {r["id"]: r for r in CM.detect_code_mixing(docs, common).collect()}
    for i, (text, ratio, changes, score, tagged) in enumerate(DETECTOR_CASES):
        r = got[i]
        assert (r["cm_ratio"], r["cm_switches"], r["is_cm"]) == (ratio, changes, tagged), text
        assert math.isclose(r["cm_score"], score), text


def test_split_sizes_are_exact(spark):
    df = spark.range(90).select("id", F.lit("t").alias("text"), F.lit(1).alias("label"), F.lit("x").alias("task"))
    sizes = {r["split"]: r["count"] for r in SP.stratified_split3(df, ["task"]).groupBy("split").count().collect()}
    assert sizes == {"train": 63, "valid": 8, "test": 19}
    halves = {r["split"]: r["count"] for r in SP.split_half(df.where("id < 7")).groupBy("split").count().collect()}
    assert halves == {"valid": 3, "test": 4}


def test_split_moves_no_text(spark):
    df = spark.range(50).select("id", F.concat(F.lit("text"), "id").alias("text"), (F.col("id") % 2).alias("label"), F.lit("x").alias("task"))
    df.write.mode("overwrite").parquet(path := tempfile.mkdtemp(prefix="split-"))
    plan = SP.stratified_split3(spark.read.parquet(path), ["task"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_knn_of_disjoint_folds(spark):
    from varieta.plans import q_retrieval as Q
    got = Q.closest(spark, "/root/testdata/sf0.001").collect()
    assert got and all(r["qid"] % 10 == 0 and r["tid"] % 10 != 0 for r in got)


def test_metrics_keep_null_groups(spark):
    from varieta.operators import metrics as M
    rows = [(g, a, b, float(i)) for g in (None, "x") for i, (a, b) in enumerate([(0, 0), (0, 1), (1, 1), (1, 1)])]
    df = spark.createDataFrame(rows, "g string, a int, b int, v double")

    def both(out, *cols):
        per = {}
        for r in out.collect():
            per.setdefault(r["g"], []).append(tuple(r[c] for c in cols))
        assert sorted(per[None]) == sorted(per["x"]) and len(per) == 2
        return sorted(per["x"])
    assert both(M.label_shares(df, "a", ["g"]), "a", "n", "pct") == [(0, 2, 50.0), (1, 2, 50.0)]
    assert both(M.class_weights(df, "b", ["g"]), "b", "weight") == [(0, 2.0), (1, 4 / 6)]
    assert both(M.confusion_matrix(df, "a", "b", ["g"]), "a", "b", "n") == [(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 2)]
    assert both(M.cohen_kappa(df, "a", "b", ["g"]), "kappa") == [(0.5,)]
    assert both(M.score_stats(df, "v", ["g"]), "n", "q25", "q50") == [(4, 0.75, 1.5)]
    assert sum(n for (n,) in both(M.histogram(df, "v", ["g"], 2), "n")) == 4
    assert both(M.box_stats(df, "v", ["g"]), "med", "n_outliers") == [(1.5, 0)]
    one = spark.createDataFrame([(2,)] * 3, "b int")
    assert M.class_weights(one, "b").first()["weight"] == 0.5  # 3 / (2 * 3)


def test_common_word_bound():
    assert CM.common_words_bound(3.5) == 316227


def test_binarize_rating_nan_and_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (3.0,), (2.0,)], "r double")
    assert [x[0] for x in df.select(R.binarize_rating("r")).collect()] == [0, 0, 1, 0]


def test_read_labeled_csv_fixture(spark, tmp_path):
    p = tmp_path / "split.csv"
    p.write_text('id,text,label\n1,"line one\nline two",1\n2,"say ""hi""",0\n3,"café",1\n'
                 '4,"",0\n5,"N/A",1\n6,"ok",\n7,"éè",0\n', encoding="utf-8")
    got = sorted(tuple(r) for r in FS.read_labeled(spark, str(p)).collect())
    assert got == [(1, "line one\nline two", 1), (2, 'say "hi"', 0), (3, "caf", 1)]
    p = tmp_path / "moved.csv"
    p.write_text('label, id,text\n1,7,"a"\nx,8,"b"\n', encoding="utf-8")
    assert [tuple(r) for r in FS.read_labeled(spark, str(p)).collect()] == [(7, "a", 1)]
    with pytest.raises(ValueError):
        FS.read_labeled(spark, str(tmp_path / "x.xlsx"))


def test_require_and_trim_headers(spark):
    df = spark.createDataFrame([(1, "a")], "` id ` int, `text ` string")
    t = R.trim_headers(df)
    assert t.columns == ["id", "text"]
    assert R.require_columns(t, ["id", "label"], strict=False) == ["label"]
    with pytest.raises(ValueError):
        R.require_columns(t, ["label"])


def test_add_row_id_dense(spark):
    df = spark.range(0, 500, 3).withColumnRenamed("id", "k").repartition(5)
    got = R.add_row_id(df, "k").orderBy("k").collect()
    assert [r["row_id"] for r in got] == list(range(len(got)))


def test_publish_replacing(spark, tmp_path):
    root = str(tmp_path / "pub")
    FS.publish_replacing(spark.range(3), root, "a")
    FS.publish_replacing(spark.range(5), root, "b")
    assert FS.read_current(spark, root).count() == 5
    assert os.path.isdir(os.path.join(root, "v-a"))


def test_two_writers_from_one_version(spark, tmp_path):
    root = str(tmp_path / "log")
    assert FS.current_version(spark, root) == 0
    FS.publish_replacing(spark.range(3), root)
    base = FS.current_version(spark, root)
    held = FS.read_current(spark, root)
    FS.publish_replacing(spark.range(4), root, base=base)
    with pytest.raises(FS.CommitConflict):
        FS.publish_replacing(spark.range(9), root, base=base)
    assert held.count() == 3 and FS.read_current(spark, root).count() == 4
    FS.publish_replacing(spark.range(9), root, base=FS.current_version(spark, root))
    assert [tuple(r) for r in FS.commits(spark, root).orderBy("version").select("version", "rows").collect()] == [(1, 3), (2, 4), (3, 9)]
    assert FS.read_current(spark, root, version=2).count() == 4
    with pytest.raises(FileNotFoundError):
        FS.read_current(spark, root, version=7)


def test_a_taken_commit_number_is_not_overwritten(spark, tmp_path):
    path = str(tmp_path / "c" / "1.json")
    assert FS._create_if_absent(spark, path, "first")
    assert not FS._create_if_absent(spark, path, "second")
    assert open(path).read() == "first"
    assert [f for f in os.listdir(tmp_path / "c") if not f.endswith(".crc")] == ["1.json"]


def test_rows_other_than_expected_are_not_published(spark, tmp_path):
    root = str(tmp_path / "short")
    with pytest.raises(RuntimeError):
        FS.publish_replacing(spark.range(3), root, expected=4)
    assert FS.current_version(spark, root) == 0


def test_training_after_a_publish(spark, tmp_path):
    """A publish leaves nothing behind in the session that later jobs ship."""
    from varieta.operators import ml as ML
    FS.publish_replacing(spark.range(3), str(tmp_path / "p"))
    rows = [(i, "good fine" if i % 2 else "bad poor", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    model = ML.train_text_classifier(df, "lr", max_iter=5, num_features=64)
    assert {r.prediction == r.label for r in ML.predict(model, df, "m", ["id", "label"]).collect()} == {True}


def test_newest_file_of_the_first_pattern_that_matches(spark, tmp_path):
    spark.range(1).coalesce(1).write.csv(str(tmp_path / "b"))
    got = FS.latest_file(spark, str(tmp_path / "a*/*.csv"), str(tmp_path / "b*/*.csv")).first()
    assert "/b/" in got.path
    assert FS.latest_file(spark, str(tmp_path / "x*")).first().path is None


# -- axes from the data, whole files, models per task ------------------------
def test_pivot_columns_come_from_the_data(spark):
    df = spark.createDataFrame([("s", "a", "xx", 0.5), ("s", "a", "yy", 0.25), ("s", "b", "xx", 1.0)],
                               "task string, trained string, variety string, f1 double")
    got = {r.trained: (r.xx, r.yy) for r in M.pivot_matrix(df, ["task", "trained"], "variety", "f1").collect()}
    assert got == {"a": (0.5, 0.25), "b": (1.0, None)}
    mean = M.pivot_mean(df, "task", "variety", "f1").first()
    assert (mean.xx, mean.yy) == (0.75, 0.25)


def test_published_version_is_read_and_earlier_one_stays(spark, tmp_path):
    root = str(tmp_path / "out")
    first = FS.publish_replacing(spark.range(3).toDF("id"), root, "1")
    second = FS.publish_replacing(spark.range(5).toDF("id"), root, "2")
    assert FS.read_current(spark, root).count() == 5 and os.path.isdir(first) and first != second


def test_newest_file_without_reading_contents(spark, tmp_path):
    for k, name in enumerate(("b.csv", "a.csv", "c.txt")):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    assert FS.latest_file(spark, str(tmp_path / "*.csv")).first().path.endswith("/a.csv")


def test_model_is_loaded_once_a_task(spark, tmp_path):
    import uuid
    from varieta.operators import ml as ML
    folder = str(tmp_path)

    def loader():
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return lambda texts: texts.str.len().astype("int32")
    df = spark.range(0, 40_000, 1, 2).selectExpr("cast(id as string) AS text")  # two tasks of two batches each
    out = ML.batch_infer(df, "text", loader, "m", "1").collect()
    assert len(out) == 40_000 and all(r.prediction == len(r.text) for r in out)
    assert len(list(tmp_path.iterdir())) == 2


def test_parameter_search_does_not_depend_on_layout(spark):
    from varieta.operators import ml as ML
    df = spark.createDataFrame([(i, ("good fine " if i % 2 else "bad poor ") + f"w{i % 7}", i % 2) for i in range(80)], "id long, text string, label int")
    a, b = ML.param_search(df.coalesce(1), regs=(0.0, 5.0)), ML.param_search(df.repartition(5), regs=(0.0, 5.0))
    assert [r for r, _ in a] == [0.0, 5.0] and a[0][1] == 1.0
    assert all(abs(x - y) < 1e-9 for (_, x), (_, y) in zip(a, b))
