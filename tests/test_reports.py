"""Reports as text files and back."""

import math

from pyspark.sql import functions as F

from varieta.operators import metrics as M
from varieta.operators import reports as RP

# the layout that result files have, with invented numbers
FILE = """              precision    recall  f1-score   support

           0       0.80      0.50      0.62        10
    macro avg       0.10      0.20      0.30         4
very good 2       0.00      0.00      0.00         0

    accuracy                           0.64        14
   macro avg       0.70      0.65      0.63        14
weighted avg        nan      0.64      0.62        14
"""


def test_round_trip_of_reports(spark, tmp_path):
    rows = [(g, i % 3, (i * 7 + len(g)) % 4) for g in ("closest_4_en-AU_Sarcasm_Reddit_few_shots_results", "plain run") for i in range(57)]
    df = spark.createDataFrame(rows, "run string, label int, prediction int")
    rep = M.classification_report(df, ["run"])
    root = RP.write_reports(RP.report_documents(rep, ["run"]), str(tmp_path / "r"))
    back = RP.parse_reports(RP.read_reports(spark, root))
    assert back.where("error IS NOT NULL").count() == 0

    def rounded(x):
        return None if x is None else float(f"{x:.2f}")
    want = sorted((r.run, r.row, rounded(r.precision), rounded(r.recall), rounded(r.f1_score), r.support) for r in rep.collect()
                  if r.run != "plain run")
    got = sorted((r.run, r.row, r.precision, r.recall, r.f1_score, r.support) for r in back.collect() if r.run.startswith("closest"))
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)
    runs = RP.compare_runs(back).collect()
    assert [(r.technique, r.k, r.variety, r.task, r.source) for r in runs] == [("closest", 4, "en-AU", "Sarcasm", "Reddit")]


def test_classes_named_like_summaries_and_null_classes(spark):
    rows = [("a", "macro avg", 0.5, 0.25, 0.3, 4, False), ("a", None, 1.0, 0.0, 0.0, 0, False), ("a", "accuracy", 0.1, 0.2, 0.3, 7, False),
            ("a", "10", 0.5, 0.5, 0.5, 12345678901, False), ("a", "9", 0.5, 0.5, 0.5, 1, False),
            ("a", "accuracy", None, None, 0.75, 12, True), ("a", "macro avg", 0.5, 0.5, 0.5, 12, True), ("a", "weighted avg", 0.4, 0.4, 0.4, 12, True)]
    rep = spark.createDataFrame(rows, "run string, row string, precision double, recall double, f1_score double, support long, _summary boolean")
    got = RP.parse_reports(RP.report_documents(rep, ["run"])).orderBy("line").collect()
    assert [(r.run, r.row, r.precision, r.recall, r.f1_score, r.support, r.summary) for r in got] == [
        rows[4], rows[3], rows[2], rows[0], rows[1], *rows[5:]]


def test_a_file_by_hand(spark, tmp_path):
    (tmp_path / "None_4_en-UK_Sentiment_Google_few_shots_results.txt").write_text(FILE)
    (tmp_path / "odd.txt").write_text("no report at all\r\n\r\n   x   1.0\n")
    (tmp_path / "empty.txt").write_text("")
    got = RP.parse_reports(RP.read_reports(spark, str(tmp_path / "*.txt")))
    rows = {(r.row, r.summary): r for r in got.where("run LIKE 'None%'").collect()}
    assert set(rows) == {("0", False), ("macro avg", False), ("very good 2", False), ("accuracy", True), ("macro avg", True), ("weighted avg", True)}
    assert rows["macro avg", False].support == 4 and rows["macro avg", True].f1_score == 0.63
    assert rows["accuracy", True].precision is None and rows["accuracy", True].f1_score == 0.64
    assert math.isnan(rows["weighted avg", True].precision)
    odd = got.where("run = 'odd'").orderBy("line").collect()
    assert [(r.row, r.error) for r in odd] == [(None, "no report at all"), (None, "   x   1.0")]
    one = RP.compare_runs(got).collect()
    assert [(r.technique, r.k, r.source, r.f1_score) for r in one] == [("None", 4, "Google", 0.63)]


def test_null_reports(spark):
    df = spark.createDataFrame([("a", None), ("b", "  \n ")], "run string, text string")
    assert RP.parse_reports(df).collect() == []
    assert RP.parse_reports(df.where(F.lit(False))).collect() == []
