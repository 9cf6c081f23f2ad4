"""Whole classification reports as text files, and back.

A report is one small text per run: a header, one line a class, a blank line
and the summary lines.  Writing groups the lines of a run (as many as it has
classes); reading takes whole files and cuts them into typed rows with native
string functions, so any number of result files is one job.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import report_text
from .prompts import parse_run_key

SUMMARIES = ("accuracy", "macro avg", "weighted avg")
_NUMBER = r"(\d+(?:\.\d+)?|nan|NaN)"
HEADER_LINE = r"^\s*precision\s+recall\s+f1-score\s+support\s*$"
FOUR_NUMBERS = rf"^\s*(.*?)\s+{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}\s+(\d+)\s*$"
TWO_NUMBERS = rf"^\s*(.*?)\s+{_NUMBER}\s+(\d+)\s*$"


def report_documents(report: DataFrame, group: Sequence[str], digits: int = 2) -> DataFrame:
    """One text per group from E8 rows: classes in order (numbers by value,
    then names, a null class last as a blank name), then the summaries.  A
    class that is called like a summary stands among the classes."""
    is_summary = F.col("row").isin(*SUMMARIES) & F.col("_summary")
    marked = report if "_summary" in report.columns else report.withColumn("_summary", F.col("row").isin(*SUMMARIES))
    lines = report_text(marked.withColumn("_order", F.struct(
        is_summary.alias("s"), F.when(is_summary, F.array_position(F.array(*map(F.lit, SUMMARIES)), F.col("row"))).alias("p"),
        F.col("row").isNull().alias("none"), F.col("row").try_cast("double").isNull().alias("text"),
        F.col("row").try_cast("double").alias("v"), F.col("row").alias("name")))
        .withColumn("row", F.coalesce("row", F.lit(""))), [*group, "_order"], digits)
    per = lines.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_order", "line"))).alias("_l"))
    header = F.format_string("%12s %9s %9s %9s %9s", F.lit(""), F.lit("precision"), F.lit("recall"), F.lit("f1-score"), F.lit("support"))

    def part(summary):
        return F.transform(F.filter("_l", lambda x: x["_order"]["s"] == F.lit(summary)), lambda x: x["line"])
    text = F.array_join(F.concat(F.array(header, F.lit("")), part(False), F.array(F.lit("")), part(True)), "\n")
    return per.select(*group, text.alias("text"))


def write_reports(documents: DataFrame, root: str, run: str = "run", text: str = "text") -> str:
    """A10 sink: the report of run ``k`` is a text file in ``<root>/run=k/``."""
    documents.select(F.col(run).alias("run"), F.col(text).alias("text")).write.partitionBy("run").text(root)
    return root


def read_reports(spark, *paths: str) -> DataFrame:
    """(run, text) of whole report files: the run is the folder ``run=...``, or
    the file's name without its ending."""
    got = spark.read.text(list(paths), wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_path"))
    folder = F.regexp_extract("_path", r"/run=([^/]+)/[^/]*$", 1)
    name = F.regexp_replace(F.regexp_extract("_path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return got.select(F.when(folder != "", folder).otherwise(name).alias("run"), "text")


def parse_reports(reports: DataFrame, keep: Sequence[str] = ("run",), text: str = "text") -> DataFrame:
    """The inverse of ``report_documents``: keep..., line, summary, row,
    precision, recall, f1_score, support, error; one row for each line but the
    header and blank ones.

    Lines below the last blank line are summaries, so a class may be called
    like one.  A blank class name is null; ``nan`` is NaN; the accuracy line
    has null precision and recall.  A line that is none of these keeps its
    text in ``error`` with null values; a null or empty report gives no rows.
    Class names may hold spaces and numbers, fields may be wider than their
    columns."""
    lines = F.split(F.regexp_replace(F.col(text), r"\s+$", ""), r"\r?\n")
    # two blank lines at least: one below the header, one above the summaries
    blank = F.filter(F.transform("_lines", lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
    cut = reports.select(*keep, lines.alias("_lines")).select("*", F.when(F.size(blank) > 1, F.array_max(blank)).alias("_cut"))
    at = cut.select(*keep, "_cut", F.posexplode("_lines").alias("line", "_line"))
    at = at.where((F.trim("_line") != "") & ~F.col("_line").rlike(HEADER_LINE))

    def got(pattern, k):
        return F.regexp_extract("_line", pattern, k)
    four, two = F.col("_line").rlike(FOUR_NUMBERS), F.col("_line").rlike(TWO_NUMBERS)

    def field(k4, k2, kind):
        value = F.when(four, got(FOUR_NUMBERS, k4))
        return (value if k2 is None else value.when(two, got(TWO_NUMBERS, k2))).try_cast(kind)
    name = F.when(four, got(FOUR_NUMBERS, 1)).when(two, got(TWO_NUMBERS, 1))
    return at.select(*keep, "line", F.coalesce(F.col("line") > F.col("_cut"), F.lit(False)).alias("summary"),
                     F.when(name != "", name).alias("row"), field(2, None, "double").alias("precision"),
                     field(3, None, "double").alias("recall"), field(4, 2, "double").alias("f1_score"), field(5, 3, "long").alias("support"),
                     F.when(~four & ~two, F.col("_line")).alias("error"))


def compare_runs(rows: DataFrame, row: str = "macro avg", value: str = "f1_score") -> DataFrame:
    """K5: the summary ``row`` of every run by the parts of its key:
    technique, k, variety, task, source, value.  Runs whose names are no keys
    are left out (``parse_run_key`` gives them empty parts)."""
    key = parse_run_key("run")
    return rows.where(F.col("summary") & (F.col("row") == row)).select(key.alias("_k"), value).where(F.col("_k.technique") != "") \
        .select("_k.technique", F.col("_k.k").cast("int").alias("k"), "_k.variety", "_k.task", "_k.source", value)
