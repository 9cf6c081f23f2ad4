"""Exact nearest-neighbour retrieval.

Exact top-K by inner product between a query set and a train set, as a
blocked matrix product:

* queries get a block id ``qb`` and train rows a block id ``tb`` (hashes of
  the ids); the block counts follow from the row counts and a fixed row
  budget on both sides, so a cell never holds more rows when the data grow;
* each query row is sent to every train block and each train row to every
  query block, so the cell (qb, tb) meets exactly its share of pairs once;
* ``cogroup(...).applyInPandas`` scores a cell tile by tile with a running
  bound on the K-th best score and emits only the per-query top K of that
  cell (ties: higher score, then lower train id) — never all pairs;
* a ``row_number() <= K`` window per query (planned with a partial
  WindowGroupLimit before the shuffle) merges the cells.

Memory per task is bounded by the row budgets and the tile size, not by the
data; the replication factor is ``t_blocks`` for queries and ``q_blocks`` for
train.  There is no cartesian product in the plan and no collect to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one cell, and of one score tile inside it (2,048 x 4,096 doubles = 64 MB).
Q_ROWS, T_ROWS = 8_192, 65_536
Q_TILE, T_TILE = 2_048, 4_096


def _first_k(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, tids: np.ndarray, k: int):
    """Candidates cut to the k best per row (score desc, train id asc)."""
    order = np.lexsort((tids[cols], -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.empty(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    ok = place < k
    return rows[ok], cols[ok], scores[ok]


def tiled_top_k(Q: np.ndarray, T: np.ndarray, tids: np.ndarray, k: int):
    """(row, column, score) of the k best columns of ``Q @ T.T`` per row.

    Tiles of fixed size; a tile's k-th best score is a lower bound of the
    final k-th best, so later tiles contribute only scores that reach it."""
    out = []
    for q0 in range(0, len(Q), Q_TILE):
        q = Q[q0:q0 + Q_TILE]
        bound = np.full(len(q), -np.inf)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for t0 in range(0, len(T), T_TILE):
            s = q @ T[t0:t0 + T_TILE].T
            n = s.shape[1]
            if n >= k:
                bound = np.maximum(bound, np.partition(s, n - k, axis=1)[:, n - k])
            r, c = np.nonzero(s >= bound[:, None])
            best = _first_k(np.concatenate([best[0], r]), np.concatenate([best[1], c + t0]),
                            np.concatenate([best[2], s[r, c]]), tids, k)
        out.append((best[0] + q0, best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _cell_fn(k: int, per_label: bool):
    def fn(qdf: pd.DataFrame, tdf: pd.DataFrame) -> pd.DataFrame:
        cols = ["qid", "tid", "tlabel", "score"]
        if len(qdf) == 0 or len(tdf) == 0:
            return pd.DataFrame({c: pd.Series(dtype="int64" if c != "score" else "float64") for c in cols})
        Q = np.stack(qdf["qvec"].to_numpy()).astype(np.float64)
        T = np.stack(tdf["tvec"].to_numpy()).astype(np.float64)
        tids = tdf["tid"].to_numpy(dtype=np.int64)
        tl = tdf["tlabel"].to_numpy(dtype=np.int64)
        qids = qdf["qid"].to_numpy(dtype=np.int64)
        groups = [np.arange(len(tdf))] if not per_label else [np.nonzero(tl == v)[0] for v in np.unique(tl)]
        parts = []
        for g in groups:
            r, c, s = tiled_top_k(Q, T[g], tids[g], k)
            parts.append(pd.DataFrame({"qid": qids[r], "tid": tids[g[c]], "tlabel": tl[g[c]], "score": s}))
        return pd.concat(parts, ignore_index=True)
    return fn


def usable_vector(vec) -> Column:
    """The vector is there, not empty, and all its components are finite numbers."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def knn_topk(queries: DataFrame, train: DataFrame, k: int, *, q_id: str, q_vec: str,
             t_id: str, t_vec: str, t_label: str | None = None, per_label: bool = False,
             q_rows: int = Q_ROWS, t_rows: int = T_ROWS) -> DataFrame:
    """(qid, tid, tlabel, score, rank) for the K best train rows per query
    (per query and train label when ``per_label``).  Rank is 1-based.

    ``q_rows`` and ``t_rows`` are the expected rows of a cell on either side;
    the block counts follow from one count of each input.  Rows without id,
    and vectors that are null, empty, hold null or non-finite components or are not as
    long as most train vectors, are left out: such a query has no rows in the
    result and such a train row is nobody's neighbour."""
    train = train.where(F.col(t_id).isNotNull() & usable_vector(t_vec))
    size = train.agg(F.count("*").alias("n"), F.mode(F.size(t_vec), True).alias("width")).first()
    queries = queries.where(F.col(q_id).isNotNull() & usable_vector(q_vec) & (F.size(q_vec) == F.lit(size.width or 0)))
    train = train.where(F.size(t_vec) == F.lit(size.width or 0))
    q_blocks = max(1, math.ceil(queries.count() / q_rows))
    t_blocks = max(1, math.ceil(size.n / t_rows))
    label = F.col(t_label).cast("long") if t_label else F.lit(0).cast("long")
    q = (queries.select(F.col(q_id).cast("long").alias("qid"), F.col(q_vec).alias("qvec"))
         .withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(q_blocks)))
         .withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(t_blocks - 1)))))
    t = (train.select(F.col(t_id).cast("long").alias("tid"), F.col(t_vec).alias("tvec"),
                      label.alias("tlabel"))
         .withColumn("tb", F.pmod(F.xxhash64("tid"), F.lit(t_blocks)))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))
    schema = "qid long, tid long, tlabel long, score double"
    cells = (q.groupBy("qb", "tb").cogroup(t.groupBy("qb", "tb"))
             .applyInPandas(_cell_fn(k, per_label), schema))
    part = ["qid", "tlabel"] if per_label else ["qid"]
    w = Window.partitionBy(*part).orderBy(F.desc("score"), "tid")
    return cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_ranks(ranking: DataFrame, k: int) -> DataFrame:
    """The K best of a longer ranking: one product serves every K up to its own."""
    return ranking.where(F.col("rank") <= k)


def seeded_order(key_cols, seed) -> Column:
    """A reproducible permutation key, independent of partitioning."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed))))


def knn_contrastive(queries: DataFrame, train: DataFrame, k: int, *, q_id: str, q_vec: str,
                    t_id: str, t_vec: str, t_label: str, seed=42, **kw) -> DataFrame:
    """K/2 nearest of each binary label, then a seeded shuffle; K must
    be even.  A class with fewer than K/2 rows contributes what it has."""
    if k % 2:
        raise ValueError("K needs to be even")
    nn = knn_topk(queries, train, k // 2, q_id=q_id, q_vec=q_vec, t_id=t_id, t_vec=t_vec,
                  t_label=t_label, per_label=True, **kw)
    w = Window.partitionBy("qid").orderBy(seeded_order(["qid", "tid"], seed))
    return nn.withColumn("position", F.row_number().over(w))


def dot(a, b) -> Column:
    """M7 inner product of two numeric arrays (as double)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_normalize(v) -> Column:
    """M7 unit vector (a zero vector is returned unchanged).  The norm is
    computed once per row and paired with each element (``array_repeat``):
    an outer expression inside a lambda is re-evaluated per element, which
    would make the normalisation quadratic in the dimension."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.array_repeat(F.sqrt(dot(v, v)), F.size(v))
    return F.zip_with(v, norm, lambda x, nm: F.when(nm == 0, x.cast("double")).otherwise(x.cast("double") / nm))
