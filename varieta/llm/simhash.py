"""SimHash near-duplicates through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, free_names, lower_words, spanning_links, stage, whole_groups

SHINGLE, DISTANCE = 4, 4
GROUP_LIMIT = 200_000
LEAF, FAN = 64, 16


def simhash(words: list[bytes], shingle: int = SHINGLE) -> int:
    """64-bit fingerprint: a bit is set if it is set in over half the XXH64
    (seed 42) of the shingles, repeats included.  No words: zero."""
    from xxhash import xxh64_intdigest
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: n - shingle + 1].tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    h = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long; and the
    long columns ``keep``."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            fp = [simhash(lower_words(t.as_py()), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64)), *b.columns[2:]],
                                             ["doc_id", "fp", *keep])
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *keep).mapInArrow(run, ", ".join([f"doc_id {doc_type}", "fp long", *(f"{k} long" for k in keep)]))


def masks(distance: int = DISTANCE, spare: int = 2, bits: range = range(64)) -> list[int]:
    """Masks such that two fingerprints within ``distance`` agree on all bits
    of at least one: ``distance + spare`` blocks, ``spare`` of them whole."""
    parts = np.array_split(np.array(bits), distance + spare)
    one = [sum(1 << int(i) for i in p) for p in parts]
    return [sum(c) for c in combinations(one, spare)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of a bit pattern in the reflected Gray code."""
    r = fp.copy()
    for k in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(k)
    return r


def _nodes(mask: np.ndarray, low: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Parent nodes over ``size`` children each: the bits on which all
    children agree, and their common values."""
    at = np.arange(0, len(low), size)
    both, any_ = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(low, at)
    agree = np.bitwise_and.reduceat(mask, at)
    return agree & ~(both ^ any_), both


class GrayIndex:
    """Fingerprints of one group in Gray order under two levels of nodes.

    Neighbours in Gray order share most bits, so a node can carry the bits on
    which its whole subtree agrees.  A query adds up differences from the top:
    a child only counts the bits that its parent has not counted, and a node
    whose sum exceeds the distance is pruned with all below it."""

    def __init__(self, fp: np.ndarray):
        self.fp = fp
        full = np.full(len(fp), np.uint64(2**64 - 1))
        self.mask1, self.low1 = _nodes(full, fp, LEAF)
        self.mask2, self.low2 = _nodes(self.mask1, self.low1, FAN)
        self.live1 = np.add.reduceat(np.ones(len(fp), np.int64), np.arange(0, len(fp), LEAF))
        self.alive = np.ones(len(fp), bool)

    def take_near(self, q: np.uint64, distance: int) -> np.ndarray:
        """Rows not yet taken within ``distance`` of ``q``; they are taken."""
        top = np.bitwise_count((self.low2 ^ q) & self.mask2)
        up = np.flatnonzero(top <= distance)
        kids = (up[:, None] * FAN + np.arange(FAN)).ravel()
        parent, acc = np.repeat(up, FAN), np.repeat(top[up], FAN)
        ok = kids < len(self.mask1)
        kids, parent, acc = kids[ok], parent[ok], acc[ok]
        acc = acc + np.bitwise_count((self.low1[kids] ^ q) & self.mask1[kids] & ~self.mask2[parent])
        ok = (acc <= distance) & (self.live1[kids] > 0)
        kids, acc = kids[ok], acc[ok]
        rows = (kids[:, None] * LEAF + np.arange(LEAF)).ravel()
        leaf, acc = np.repeat(kids, LEAF), np.repeat(acc, LEAF)
        ok = rows < len(self.fp)
        rows, leaf, acc = rows[ok], leaf[ok], acc[ok]
        near = self.alive[rows] & (acc + np.bitwise_count((self.fp[rows] ^ q) & ~self.mask1[leaf]) <= distance)
        got = rows[near]
        self.alive[got] = False
        np.subtract.at(self.live1, got // LEAF, 1)
        return got


def group_links(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups that join every pair within ``distance`` (directly
    or through others).  Rows are sorted by (group, Gray rank).

    Groups of at most LEAF rows are one leaf and are compared directly; larger
    ones are walked through their index: every row leaves the index when it is
    reached, so a dense cluster costs a few queries, not all its pairs."""
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    sizes = np.diff(edges)
    a, b = [], []
    small = np.repeat(sizes <= LEAF, sizes)
    for k in range(1, min(LEAF, int(sizes.max(initial=1)))):
        i = np.flatnonzero(small[:-k] & (group[:-k] == group[k:]))
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= distance]
        a.append(fp[i])
        b.append(fp[i + k])
    for at, n in zip(edges[:-1][sizes > LEAF], sizes[sizes > LEAF]):
        index = GrayIndex(fp[at:at + n])
        for first in range(n):
            if not index.alive[first]:
                continue
            index.alive[first] = False
            index.live1[first // LEAF] -= 1
            queue = [first]
            while queue:
                i = queue.pop()
                got = index.take_near(index.fp[i], distance)
                if len(got):
                    a.append(np.full(len(got), index.fp[i]))
                    b.append(index.fp[got])
                    queue.extend(got.tolist())
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(a), np.concatenate(b)


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b) links between the distinct fingerprints ``distinct(fp)`` whose
    components are those of all pairs within ``distance`` bits.

    Every fingerprint goes to the upper nodes of which it shares the masked
    pattern (``masks``); near pairs agree on at least one.  A group above
    ``group_limit`` is dealt again under masks that also fix a part of its
    free bits, which loses no near pair."""
    first = masks(distance)

    def keyed(df, table, tag):
        nodes = F.array(*[F.struct(F.lit(f"{tag}{i}").alias("node"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("pattern"))
                          for i, m in enumerate(table)])
        return df.select("fp", F.explode(nodes).alias("n")).select("fp", "n.node", "n.pattern")

    keys = keyed(distinct, first, "a")
    big = stage(keys.groupBy("node", "pattern").count().where(F.col("count") > group_limit), "big-nodes")
    if not big.isEmpty():
        again = [x["node"] for x in big.select("node").distinct().collect()]  # at most len(first) names
        rest = keys.join(big, ["node", "pattern"], "left_anti")
        for name in again:
            m = first[int(name[1:])]
            free = [i for i in range(64) if not m >> i & 1]
            finer = [m | sum(1 << int(i) for i in p) for p in np.array_split(np.array(free), distance + 1)]
            part = keys.where(F.col("node") == name).join(big, ["node", "pattern"], "left_semi").select("fp")
            rest = rest.unionByName(keyed(part, finer, f"{name}."))
        keys = rest

    def run(batches):
        import pyarrow as pa
        for t in whole_groups(batches, ["node", "pattern"], 200_000):
            fp = t.column("fp").to_numpy().view(np.uint64)
            node = np.unique(t.column("node").to_numpy(zero_copy_only=False), return_inverse=True)[1]
            pattern = t.column("pattern").to_numpy()
            order = np.lexsort((gray_rank(fp), pattern, node))
            fp, node, pattern = fp[order], node[order], pattern[order]
            group = np.cumsum(np.r_[0, (node[1:] != node[:-1]) | (pattern[1:] != pattern[:-1])])
            a, b = spanning_links(*group_links(group, fp, distance))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
    return keys.repartition("node", "pattern").sortWithinPartitions("node", "pattern").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
                       group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id
    (smallest doc_id reachable through links of at most ``distance`` bits).

    Copies share a fingerprint and are combined before anything is compared;
    index, links and components work on distinct fingerprints.  Null and empty
    texts have fingerprint zero and are linked like any other; a null doc_id
    keeps its row and never names a component unless it is alone there;
    repeated rows keep their number; an empty table gives no rows; other
    columns are ignored."""
    fps = stage(fingerprints(docs, shingle), "fingerprints")
    reps = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    comp = connected_components(fingerprint_links(reps.select("fp"), distance, group_limit))
    named = reps.join(comp, reps["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "root").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _first_of_task(batches: Iterator) -> Iterator:
    """Rows without most of those that repeat an earlier row of the task, so
    that a row repeated many times does not move as a group."""
    import pyarrow as pa
    seen: set[tuple[int, int]] = set()
    for b in batches:
        ok = np.ones(b.num_rows, bool)
        for i, key in enumerate(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())):
            ok[i] = key not in seen
            if len(seen) >= 100_000:
                seen.clear()
            seen.add(key)
        yield b.filter(pa.array(ok))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``docs`` with one row of every near-duplicate group: the one with the
    least doc_id, of several with this doc_id the one with the least hash of
    the row; rows without doc_id come last, rows equal in all columns count as
    one.  Rows are told apart by two 64-bit hashes of their columns (maps
    aside)."""
    columns = docs.columns
    plain = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    plain += [c.isNull() for c in plain]          # a hash passes over nulls
    key, many = free_names(columns, "_row", "_row2"), "_many"
    rows = docs.withColumn(key[0], F.xxhash64(*plain)).withColumn(key[1], F.xxhash64(F.lit(1), *plain))
    fps = stage(fingerprints(rows, shingle, tuple(key)), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *key)
    reps = stage(fps.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    comp = connected_components(fingerprint_links(reps.select("fp"), distance, group_limit))
    named = reps.join(comp, reps["fp"] == comp["node"], "left").select("first", F.coalesce("component", "fp").alias("root"))
    keep = named.groupBy("root").agg(F.min("first").alias("first")).select(*(f"first.{k}" for k in key))
    repeated = fps.groupBy(*key).count().where("count > 1").select(*key)
    keep = stage(keep.join(repeated.withColumn(many, F.lit(True)), key, "left"), "kept")
    out = rows.join(keep.select(*key), key, "left_semi")
    if not keep.where(many).isEmpty():
        again = rows.mapInArrow(_first_of_task, rows.schema).join(keep.where(many).select(*key), key, "left_semi").dropDuplicates(key)
        out = rows.join(keep.where(F.col(many).isNull()).select(*key), key, "left_semi").unionByName(again)
    return out.select(*columns)
