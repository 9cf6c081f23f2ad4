"""Embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, connected_components, spanning_links, stage, whole_groups

BLOCK_DIM = 16
CELL_ROWS = 16_384
TILE_ROWS = 32_768
SAMPLE_ROWS = 65_536
LEAF_SAMPLE = 4              # sampled vectors a cell is split down to: 16,384 cells at SAMPLE_ROWS
_SLACK = 1e-9


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """Seeded random orthogonal matrix: spreads a distance evenly over blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, block_dim: int = BLOCK_DIM) -> list[slice]:
    return [slice(a, min(dim, a + block_dim)) for a in range(0, dim, block_dim)]


def distance_budget(threshold: float, dim: int, block: slice) -> float:
    """The block's part of the squared distance of unit vectors at ``threshold``,
    proportional to its dimensions: a linked pair keeps it in some block."""
    return (2 - 2 * threshold) * (block.stop - block.start) / dim + _SLACK


def unit_rotated(raw: np.ndarray, q: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True)) @ q


def principal_axes(q: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """``q`` with the axes of every block turned to the sample's principal
    directions in that block: distances inside blocks stay, and splits meet
    the widest directions."""
    q = q.copy()
    if len(sample) > 1:
        x = unit_rotated(sample, q)
        for s in blocks(q.shape[1]):
            y = x[:, s] - x[:, s].mean(0)
            q[:, s] = q[:, s] @ np.linalg.eigh(y.T @ y)[1][:, ::-1]
    return q


class CellTree:
    """Median splits of one block of the rotated space along the direction of
    largest variance; the leaves are the cells."""

    def __init__(self, points: np.ndarray, cells: int):
        axis, at, left, right, cell = [], [], [], [], []
        self.cells = 0

        def grow(p, n) -> int:
            k = len(axis)
            for column, v in ((axis, 0), (at, 0.0), (left, -1), (right, -1), (cell, -1)):
                column.append(v)
            if n > 1 and len(p) >= 2 * LEAF_SAMPLE:
                d = int(np.argmax(p.var(0)))
                cut = float(np.median(p[:, d]))
                low = p[:, d] < cut
                if low.any() and not low.all():
                    axis[k], at[k] = d, cut
                    left[k] = grow(p[low], n // 2)
                    right[k] = grow(p[~low], n - n // 2)
                    return k
            cell[k] = self.cells
            self.cells += 1
            return k
        grow(points, cells)
        self.axis, self.at = np.array(axis), np.array(at)
        self.left, self.right, self.cell = np.array(left), np.array(right), np.array(cell)

    def reach(self, x: np.ndarray, radius2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cell per row, and (row, cell) for lower cells within the radius.

        Rows go down the tree level by level: always to their side of a split,
        to the other side while the squared gaps to it, one per direction, stay
        within the radius."""
        home = np.zeros(len(x), np.int64)
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        own, gap2, gaps = np.ones(len(x), bool), np.zeros(len(x)), np.zeros_like(x)
        rows, cells = [], []
        while len(row):
            leaf = self.left[node] < 0
            home[row[leaf & own]] = self.cell[node[leaf & own]]
            rows.append(row[leaf])
            cells.append(self.cell[node[leaf]])
            row, node, own, gap2, gaps = (v[~leaf] for v in (row, node, own, gap2, gaps))
            d = self.axis[node]
            off = x[row, d] - self.at[node]
            near = np.where(off >= 0, self.right[node], self.left[node])
            far = np.where(off >= 0, self.left[node], self.right[node])
            far2 = gap2 - gaps[np.arange(len(row)), d]**2 + off * off
            go = np.flatnonzero(far2 <= radius2 + _SLACK)
            over = gaps[go]
            over[np.arange(len(go)), d[go]] = np.abs(off[go])
            row, node = np.concatenate([row, row[go]]), np.concatenate([near, far[go]])
            own = np.concatenate([own, np.zeros(len(go), bool)])
            gap2, gaps = np.concatenate([gap2, far2[go]]), np.concatenate([gaps, over])
        rows, cells = np.concatenate(rows or [row]), np.concatenate(cells or [node])
        below = cells < home[rows]
        return home, rows[below], cells[below]


def _read(blob: list, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blob), np.float64).reshape(-1, dim)


def _pack(batches: Iterator) -> Iterator:
    """Rows with their vector as double bytes and its length; null where the
    vector is null, empty, zero or has null or non-finite components.  Vectors
    are scaled by a power of two, so that no square is too large or small."""
    import pyarrow as pa
    for b in batches:
        vec, dims = [], []
        for v in b.column(1).to_pylist():
            a = None
            if v and None not in v:
                a = np.array(v, np.float64)
                a = a if np.isfinite(a).all() and a.any() else None
                if a is not None:
                    a = np.ldexp(a, -np.frexp(np.abs(a).max())[1]) + 0.0    # -0.0 is 0.0
            vec.append(None if a is None else a.tobytes())
            dims.append(None if a is None else len(a))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vec, pa.binary()), pa.array(dims, pa.int32())],
                                         ["vec_id", "vec", "dim"])


def _deal(trees, q, dim, threshold):
    """Each distinct vector to its home cell and, as visitor, to lower cells in
    reach, in every block."""
    def run(batches):
        import pyarrow as pa
        parts = blocks(dim)
        grown = [t.value for t in trees]
        most = max(64, (1 << 19) // max(t.cells for t in grown))   # rows at a time: they may visit every cell
        for b in (b.slice(a, most) for b in batches for a in range(0, b.num_rows, most)):
            x = unit_rotated(_read(b.column("vec").to_pylist(), dim), q)
            for k, (s, tree) in enumerate(zip(parts, grown)):
                home, row, cell = tree.reach(x[:, s], distance_budget(threshold, dim, s))
                rows = pa.array(np.concatenate([np.arange(len(x)), row]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), k, np.int32)), pa.array(np.concatenate([home, cell]).astype(np.int32)),
                     pa.array(np.concatenate([np.ones(len(x), bool), np.zeros(len(row), bool)])),
                     b.column("node").take(rows), b.column("vec").take(rows), b.column("weight").take(rows)],
                    ["block", "cell", "home", "node", "vec", "weight"])
    return run


def cell_links(block: int, dim: int, q: np.ndarray, threshold: float, home: tuple, other: tuple,
               is_home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home row, other row) linked at ``threshold`` that this
    block owns: the first block within its budget.  Candidates come from the
    block's distances; each is verified by its cosine in double precision."""
    parts = blocks(dim)
    s = parts[block]
    limit = [distance_budget(threshold, dim, p) for p in parts]
    (na, a), (nb, b) = home, other
    ra, rb = unit_rotated(a, q), unit_rotated(b, q)
    la, lb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    # one product gives the block's squared distance less its limit
    fa, fb = ra[:, s].astype(np.float32), rb[:, s].astype(np.float32)
    ones = np.ones((max(len(a), len(b)), 1), np.float32)
    fa = np.hstack([-2 * fa, (fa * fa).sum(1, keepdims=True), ones[:len(a)]])
    fb = np.ascontiguousarray(np.hstack([fb, ones[:len(b)], (fb * fb).sum(1, keepdims=True) - np.float32(limit[block] + 1e-4)]).T)
    over = np.empty((512, 1024), np.float32)
    for i0 in range(0, len(a), 512):
        for j0 in range(0, len(b), 1024):
            left, right = fa[i0:i0 + 512], fb[:, j0:j0 + 1024]
            d = np.matmul(left, right, out=over[:len(left), :right.shape[1]]) if right.shape[1] == 1024 else left @ right
            i, j = np.nonzero(d <= 0)
            if not len(i):
                continue
            i, j = i + i0, j + j0
            ok = ~is_home[j] | (na[i] < nb[j])
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 1 << 15):
                x, y = i[at:at + (1 << 15)], j[at:at + (1 << 15)]
                diff = ra[x] - rb[y]
                diff *= diff
                own = np.ones(len(x), bool)
                for k in range(block):
                    own &= diff[:, parts[k]].sum(axis=1) > limit[k]
                own &= diff[:, s].sum(axis=1) <= limit[block]
                x, y = x[own], y[own]
                cos = (a[x] * b[y]).sum(axis=1) / (la[x] * lb[y])
                yield x[cos >= threshold], y[cos >= threshold]


def _join_cells(q, dim, threshold):
    """One cell (a home tile against a tile of homes and visitors) at a time."""
    def run(batches):
        import pyarrow as pa
        keys = ["block", "cell", "ht", "vt"]
        for t in whole_groups(batches, keys, 1):
            k = np.stack([t.column(c).to_numpy() for c in keys])
            starts = np.flatnonzero(np.r_[True, (k[:, 1:] != k[:, :-1]).any(axis=0)])
            for a, z in zip(starts, np.r_[starts[1:], k.shape[1]]):
                g = t.slice(a, z - a)
                left = g.column("left").to_numpy()
                home_b = g.column("home").to_numpy()
                node, w = g.column("node").to_numpy(), g.column("weight").to_numpy()
                x = _read(g.column("vec").to_pylist(), dim)
                nl, nr, xl, xr, wl, wr = node[left], node[~left], x[left], x[~left], w[left], w[~left]
                cl, cr = np.zeros(len(nl), np.int64), np.zeros(len(nr), np.int64)
                ea, eb = [], []
                for i, j in cell_links(int(k[0, a]), dim, q, threshold, (nl, xl), (nr, xr), home_b[~left]):
                    cl += np.bincount(i, wr[j], len(nl)).astype(np.int64)
                    cr += np.bincount(j, wl[i], len(nr)).astype(np.int64)
                    if len(i):
                        u, v = spanning_links(nl[i], nr[j])
                        ea.append(u)
                        eb.append(v)
                for n, c in ((nl, cl), (nr, cr)):
                    some = np.flatnonzero(c)
                    yield pa.RecordBatch.from_arrays([pa.array(n[some]), pa.nulls(len(some), pa.int64()), pa.array(c[some])], ["a", "b", "n"])
                if ea:
                    u, v = spanning_links(np.concatenate(ea), np.concatenate(eb))
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], ["a", "b", "n"])
    return run


def pigeonhole_links(distinct: DataFrame, dim: int, threshold: float, cell_rows: int = CELL_ROWS,
                     tile_rows: int = TILE_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """For distinct vectors (node, vec, weight) of one length: rows (a, b, null)
    that join linked nodes, and rows (a, null, n): n further links of node a.

    The split points and the axes of each block come from at most about
    ``sample_rows`` vectors; every vector is dealt.  A cell with more rows than ``tile_rows`` is cut in tiles
    and each home tile meets each tile, so a task's size is bounded.  A pair
    is counted in one block and one cell, and only sums leave the task."""
    spark = distinct.sparkSession
    n = distinct.count()
    q = rotation(dim)
    share = min(1.0, sample_rows / max(1, n))
    pick = distinct.where(F.pmod("node", F.lit(1 << 20)) < int(math.ceil(share * (1 << 20)))).select("vec")
    rows = [bytes(r.vec) for r in pick.toLocalIterator()]
    sample = _read(rows, dim)
    q = principal_axes(q, sample)
    x = unit_rotated(sample, q)
    cells = max(1, math.ceil(n / cell_rows))
    trees = [Shared(spark, CellTree(x[:, s], cells)) for s in blocks(dim)]
    dealt = distinct.mapInArrow(_deal(trees, q, dim, threshold),
                                "block int, cell int, home boolean, node long, vec binary, weight long")
    dealt = stage(dealt, "cells")
    sizes = dealt.groupBy("block", "cell").agg(F.count_if("home").alias("nh"), F.count("*").alias("nv")) \
        .select("block", "cell", F.ceil(F.col("nh") / tile_rows).cast("int").alias("hts"),
                F.ceil(F.col("nv") / tile_rows).cast("int").alias("vts"))
    d = dealt.join(sizes, ["block", "cell"])
    mix = F.xxhash64("node")
    left = d.where("home").select("*", F.pmod(mix, F.col("hts")).cast("int").alias("ht"),
                                  F.explode(F.sequence(F.lit(0), F.col("vts") - 1)).alias("vt"), F.lit(True).alias("left"))
    right = d.where("hts > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("hts") - 1)).alias("ht"),
                                      F.pmod(mix, F.col("vts")).cast("int").alias("vt"), F.lit(False).alias("left"))
    keys = ["block", "cell", "ht", "vt"]
    return left.unionByName(right).drop("hts", "vts").repartition(*keys).sortWithinPartitions(*keys) \
        .mapInArrow(_join_cells(q, dim, threshold), "a long, b long, n long")


def embedding_components(vectors: DataFrame, threshold: float = 0.9, **sizes) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: vec_id, n_links (other
    rows with cosine >= threshold), component_id (smallest vec_id reachable,
    itself included), kept (vec_id = component_id).

    Identical vectors are combined before the join and count with their number.
    A vector that is null, empty or zero or has null or non-finite components
    links with nothing, and vectors link only with vectors of their length.
    Null vec_ids keep their rows, name no component unless alone and are kept
    there; repeated rows are rows of their own; an empty table gives no rows;
    other columns are ignored."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    packed = vectors.select("vec_id", "embedding").mapInArrow(_pack, f"vec_id {id_type}, vec binary, dim int")
    packed = stage(packed.withColumn("node", F.xxhash64("vec", "dim")), "vectors")
    distinct = stage(packed.where(F.col("vec").isNotNull()).groupBy("node", "dim", "vec")
                     .agg(F.count("*").alias("weight"), F.min("vec_id").alias("least")), "distinct")
    links = None
    for r in distinct.select("dim").distinct().collect():  # one row per vector length
        one = pigeonhole_links(distinct.where(F.col("dim") == r.dim).select("node", "vec", "weight"), r.dim, threshold, **sizes)
        links = one if links is None else links.unionByName(one)
    if links is None:
        return packed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                             F.lit(True).alias("kept"))
    links = stage(links, "links")
    comp = connected_components(links.where(F.col("b").isNotNull()).select("a", "b"))
    counts = links.where(F.col("n").isNotNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    nodes = distinct.drop("vec", "dim").join(comp, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "root").join(counts, "node", "left") \
        .select("node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    # rows without a usable vector have no node row: they stay alone
    out = packed.select("vec_id", F.when(F.col("vec").isNotNull(), F.col("node")).alias("node")).join(nodes, "node", "left")
    alone = F.col("n_links").isNull()
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")) \
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


PIGEONHOLE_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, len(e) AS d,
        e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND list_sum(list_transform(e, lambda x: x * x)) > 0 AS ok FROM v),
n AS MATERIALIZED (SELECT vec_id, e, d, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len FROM u WHERE ok),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.d = b.d
      WHERE list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT v.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = v.vec_id) AS BIGINT) AS n_links,
       min(r.b) AS component_id, v.vec_id = min(r.b) AS kept
FROM v JOIN r ON r.a = v.vec_id GROUP BY v.vec_id
"""
