"""Session construction and cluster-safe settings.

The library never hard-codes a machine-local folder: lineage is cut with
``DataFrame.checkpoint()`` into the shared folder named by
``spark.checkpoint.dir``.  A fallback is only installed when the setting is
absent (local tests).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is small), coalesces small shuffle
# partitions and splits skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "varieta",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A folder set on the context counts too.  Only on a local master that names
    none (tests, local runs) is ``fallback`` (or a fresh folder under the
    system temp dir) installed; a cluster without a shared folder is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if fallback is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile
            fallback = tempfile.mkdtemp(prefix="varieta-ckpt-")
        current = fallback
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint (never ``localCheckpoint``): survives executor loss."""
    spark = spark or df.sparkSession
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


# Text tables and their unique row keys: the key used to spread a short
# scan, so equal keys land together and later aggregates on them reuse it.
TEXT_KEYS = {"documents": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn")}


SPREAD = "spark.varieta.spread.partitions"


def spread(df: DataFrame, keys, parts: int) -> DataFrame:
    """Give CPU-heavy text work (regex chains, tokenising) ``parts`` tasks:
    the scan is hash-partitioned on its unique ``keys``.  Unique keys cannot
    be skewed, and a later aggregate or join on them reuses the partitioning.
    With 0 the scan stays as Spark splits it: nothing is shuffled.

    It pays where a table is one small file, which Spark reads in one task;
    tables of many files fill a cluster by themselves, so 0 is the default."""
    return df.repartition(parts, *keys) if parts else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; text tables are spread over as many tasks as the session
    setting ``spark.varieta.spread.partitions`` says (unset: as they are)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    keys = TEXT_KEYS.get(name)
    return spread(df, keys, int(spark.conf.get(SPREAD, "0"))) if keys else df
