"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# ``[^\x20\x09-\x0D]+`` in UTF-8 bytes is what ``bytes.split()`` returns, and
# ``bytes.lower()`` lower-cases A-Z alone.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
MAX_ID = 2**63 - 1
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read
    it back: lineage is cut, a lost executor costs nothing that was written.
    The shuffle files of the write are dropped when it ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def free_names(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores before it until no column has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def lowest_hashes(df: DataFrame, n: int) -> DataFrame:
    """At most ``n`` different rows of ``df``: those with the lowest hashes of
    all their columns, rows of one hash once.  About twice as many hashes are
    put in order, one number comes to the driver, and a row repeated many
    times is combined before it moves."""
    name, = free_names(df.columns, "hash")
    columns = [F.col(c) for c in df.columns]
    h = df.select(*columns, F.xxhash64(*columns, *(c.isNull() for c in columns)).alias(name))
    share = min(1.0, 2 * n / max(1, df.count()))
    low = h if share == 1 else h.where(F.col(name) <= int(-2**63 + share * 2**64))
    last = low.select(name).distinct().orderBy(name).limit(n).agg(F.max(name)).first()[0]
    if last is None:
        return df.limit(0)
    return low.where(F.col(name) <= last).dropDuplicates([name]).drop(name).repartition(min(32, max(1, n // 32)))


class Shared:
    """A broadcast object for tasks.  Only its plain attributes (arrays, lists,
    dicts) are broadcast; its class travels with the function that uses it, so
    workers need not have this package on their path."""

    def __init__(self, spark: SparkSession, obj):
        self.kind, self.state = type(obj), spark.sparkContext.broadcast(vars(obj))

    @property
    def value(self):
        obj = self.kind.__new__(self.kind)
        vars(obj).update(self.state.value)
        return obj


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def whole_groups(batches: Iterator, keys: list[str], least: int,
                 weight: str | None = None) -> Iterator:
    """Regroup Arrow batches sorted by ``keys`` into tables that hold whole
    key groups only, of about ``least`` rows (or bytes of column ``weight``)."""
    import pyarrow as pa
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(weight).nbytes if weight else batch.num_rows
        if size < least:
            continue
        t = pa.Table.from_batches(held)
        same = np.ones(t.num_rows, dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            same &= v == v[-1]
        cut = t.num_rows - int(same[::-1].argmin()) if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).combine_chunks().to_batches()
            size = sum(b.column(weight).nbytes if weight else b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held)


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``a[i]-b[i]`` reduced to (node, least node of its component among
    these links), by repeated label minima and pointer jumping."""
    if not len(a):
        return a, b
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component is the
    least node reachable.  Alternating large-star and small-star steps: each
    is one map-side combined minimum per node and one join back, so a hub is
    combined before it moves, and AQE splits its join partition.  Every round
    is checkpointed in the shared folder; only a row count and a checksum
    reach the driver."""
    def settle(df):
        return stage(df.distinct(), "links")

    def digest(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = settle(links.where(F.col("a") != F.col("b"))
               .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    last = digest(e)
    while last[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")) \
            .select("e.u", "e.v").where(F.col("u") != F.col("v"))
        e = settle(small)
        now = digest(e)
        if now == last:
            break
        last = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
