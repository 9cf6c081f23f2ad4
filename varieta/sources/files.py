"""Readers and writers for labelled text files.

Explicit schemas everywhere (no inference); the directory layout
``<task>/<variety>/<domain>/<split>`` becomes partition columns, so later
filters prune directories instead of reading them.
"""

from __future__ import annotations

import json
import os
import uuid
from typing import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import NA_TOKENS
from ..functions.rules import require_columns, trim_headers
from ..functions.text import ascii_only
from ..session import checkpoint_dir

LABELED_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

SPLIT_LAYOUT = ("task", "variety", "domain", "split")
COMMITS = "commits"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a
    machine-local temp dir on a cluster)."""
    return os.path.join(checkpoint_dir(spark), "landing", f"{name}-{uuid.uuid4().hex[:12]}")


def na_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing-value tokens (pandas' default list) become null in string columns."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    toks = [F.lit(t) for t in NA_TOKENS]
    return df.select(*[F.when(F.col(c).isin(*toks), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def read_labeled(spark: SparkSession, path: str, schema: T.StructType = LABELED_SCHEMA,
                 fmt: str | None = None) -> DataFrame:
    """A1: csv / tsv / json / jsonl by extension (or ``fmt``); non-ASCII
    characters dropped, NA tokens -> null, rows with any null dropped."""
    ext = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if ext in ("csv", "tsv"):
        # columns are bound by header name, whatever their order in the file
        raw = trim_headers(spark.read.option("header", True).option("multiLine", True).option("escape", '"')
                           .option("sep", "\t" if ext == "tsv" else ",").csv(path))
        require_columns(raw, schema.fieldNames())
        df = raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])
    elif "json" in ext:
        df = spark.read.schema(schema).option("multiLine", ext == "json").json(path)
    else:
        raise ValueError(f"unsupported file type {ext!r}: use csv, tsv, json or jsonl")
    strings = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    df = df.select(*[ascii_only(c).alias(c) if c in strings else F.col(c) for c in df.columns])
    return na_to_null(df, strings).na.drop("any")


def write_labeled_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    (df.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_splits(df: DataFrame, path: str, layout: Sequence[str] = SPLIT_LAYOUT,
                 fmt: str = "parquet", ascii: bool = True, mode: str = "errorifexists") -> str:
    """One directory per (task, variety, domain, split)."""
    if ascii:
        df = df.withColumn("text", ascii_only("text"))
    # a rebalanced write: AQE splits the partitions of a hot (task, variety, domain, split)
    w = df.hint("rebalance", *layout).write.mode(mode).partitionBy(*layout)
    if fmt == "csv":
        (w.option("header", True).option("escape", '"').option("quoteAll", True)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.parquet(path)
    return path


def scan_splits(spark: SparkSession, path: str, fmt: str = "parquet",
                schema: T.StructType | None = None) -> DataFrame:
    """A2: the whole tree in one scan; layout parts come back as partition
    columns (filters on them prune directories)."""
    r = spark.read.option("basePath", path)
    if fmt == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", '"')
        if schema is not None:
            r = r.schema(schema)
        return r.csv(path)
    return r.parquet(path)


def path_columns(df: DataFrame, pattern: str, names: Sequence[str]) -> DataFrame:
    """Columns cut out of each row's source file path (``_metadata.file_path``)."""
    p = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(p, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def latest_file(spark: SparkSession, *globs: str) -> DataFrame:
    """Path of the newest file (by modification time, ties broken by path)
    of the first pattern that matches any file; no row values if none does.
    Only file names and times are read, no contents; Spark lists no empty
    files."""
    fs = spark._jvm.org.apache.hadoop.fs
    for glob in globs:
        path = fs.Path(glob)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
            files = spark.read.format("binaryFile").load(glob).select("path", F.col("modificationTime").alias("mtime"))
            return files.agg(F.max_by("path", F.struct("mtime", "path")).alias("path"), F.max("mtime").alias("mtime"))
    return spark.createDataFrame([(None, None)], "path string, mtime timestamp")


RESULT_LAYOUT = ("model", "task", "variety", "domain")
METRIC_SCHEMA = "precision double, recall double, f1_score double"


def write_results(predictions: DataFrame, root: str, metrics: DataFrame | None = None,
                  layout: Sequence[str] = RESULT_LAYOUT) -> str:
    """Predictions always, under ``<root>/prediction/<layout>``; the metric
    rows of labelled runs, if given, under ``<root>/metric/<layout>`` as CSV
    with the columns precision, recall, f1_score."""
    predictions.hint("rebalance", *layout).write.partitionBy(*layout).parquet(os.path.join(root, "prediction"))
    if metrics is not None:
        cols = [c.split()[0] for c in METRIC_SCHEMA.split(", ")]
        metrics.select(*layout, *cols).write.partitionBy(*layout).option("header", True).csv(os.path.join(root, "metric"))
    return root


def scan_results(spark: SparkSession, root: str, layout: Sequence[str] = RESULT_LAYOUT) -> DataFrame:
    """All metric files of a result tree in one scan, the layout as
    columns cut out of the paths."""
    got = spark.read.schema(METRIC_SCHEMA).option("header", True).csv(os.path.join(root, "metric", *["*"] * len(layout)))
    return path_columns(got, "/".join(f"{c}=([^/]+)" for c in layout) + "/", layout)


def combined_metrics(results: DataFrame, sizes: DataFrame) -> DataFrame:
    """The study's combined sheet: ``task`` becomes ``<domain>-<task>`` in
    lower case, train sizes (task, variety, domain, size) are attached, and the
    pair without data, google-sarcasm, is left out."""
    name = F.concat_ws("-", F.lower("domain"), F.lower("task"))
    keys = ["task", "variety", "domain"]
    return results.join(sizes, keys, "left").where(name != "google-sarcasm") \
        .select("precision", "recall", "f1_score", "model", F.col("variety").alias("locale"), "size", name.alias("task"))


class CommitConflict(RuntimeError):
    """Another writer published on top of the version this one started from."""


def _create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file under ``path`` unless one is there: written under a
    hidden name first, then renamed without overwriting, so that readers see
    either nothing or the whole file.  How exclusive that is between writers
    is the file system's rename (atomic on HDFS; stores without it need their
    own committer).  False: the name was taken."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    fs = jvm.org.apache.hadoop.fs
    target = fs.Path(path)
    hidden = fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    # relative and plain paths mean what Spark's readers take them for
    context = fs.FileContext.getFileContext(target.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(),
                                            spark._jsc.hadoopConfiguration())
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(hidden, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    kind = getattr(fs, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.NONE
    try:
        context.rename(hidden, target, how)
        return True
    except Py4JJavaError as e:
        if not e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise
        return False
    finally:
        if store.exists(hidden):
            store.delete(hidden, False)


COMMIT_SCHEMA = "version long, path string, rows long"


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The commit log of ``root``: (version, path, rows), one row a published
    version; no rows if nothing was published."""
    folder = os.path.join(root, COMMITS)
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    return spark.read.schema(COMMIT_SCHEMA).json(folder)


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the last published version, 0 if there is none."""
    return commits(spark, root).agg(F.max("version")).first()[0] or 0


def publish_replacing(df: DataFrame, root: str, version: str | None = None, base: int | None = None,
                      expected: int | None = None, tries: int = 20) -> str:
    """Write a new version next to the old ones, verify it, then commit
    it: the commit file of the next number is created only if it is absent.

    ``base`` is the version number that ``df`` was computed from.  If another
    writer has published since, ``CommitConflict`` is raised, the data folder
    stays unreferenced and the caller reads anew.  Without ``base`` the write
    replaces whatever is there, and takes the next free number.  The rows are
    counted from the written files; they must be ``expected`` if that is given.
    Earlier versions stay as they are, and readers hold a snapshot."""
    spark = df.sparkSession
    name = f"v-{version or uuid.uuid4().hex[:12]}"
    target = os.path.join(root, name)
    df.write.mode("errorifexists").parquet(target)
    rows = spark.read.schema(df.schema).parquet(target).count()
    if expected is not None and rows != expected:
        raise RuntimeError(f"wrote {rows} rows, expected {expected}: not published")
    for _ in range(tries):
        last = current_version(spark, root)
        if base is not None and last != base:
            raise CommitConflict(f"version {last} was published since version {base} was read")
        line = json.dumps({"version": last + 1, "path": name, "rows": rows})
        if _create_if_absent(spark, os.path.join(root, COMMITS, f"{last + 1:020d}.json"), line + "\n"):
            return target
    raise CommitConflict(f"no free version number in {tries} tries")


def read_current(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The last published version, or version number ``version``."""
    log = commits(spark, root)
    row = (log.where(F.col("version") == version) if version is not None else log) \
        .agg(F.max_by("path", "version")).first()
    if row[0] is None:
        raise FileNotFoundError(f"no published version {'' if version is None else version} under {root}")
    return spark.read.parquet(os.path.join(root, row[0]))
