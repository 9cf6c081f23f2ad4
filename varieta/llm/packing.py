"""Best-fit packing of tokenised documents with dominance reduction.

Only piece lengths matter for packing, and there are at most ``capacity`` of
them: the number of pieces of each length is one small table however many
documents there are.  The reduction and the best fit work on that table in
whole multiples; documents then take their places by their rank among the
pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, stage
from .tokens import ByteTokenizer, cut_units, gather, text_chunks, vocabulary_path

CAPACITY = 2048
END_ID = 0


class Sizes:
    """Multiset of sizes as counts, with the distinct sizes in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, count: int) -> None:
        self.n[size] -= count
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect_left(self.order, size))

    def put(self, size: int, count: int) -> None:
        if size not in self.n:
            insort(self.order, size)
            self.n[size] = 0
        self.n[size] += count

    def smallest(self, k: int) -> list[int]:
        """The ``k`` smallest items, repeats included (fewer if there are)."""
        out = []
        for s in self.order:
            out += [s] * min(self.n[s], k - len(out))
            if len(out) == k:
                break
        return out

    def largest_up_to(self, room: int) -> int | None:
        at = bisect_left(self.order, room + 1)
        return self.order[at - 1] if at else None

    def above(self, size: int, k: int) -> list[int]:
        """The ``k`` smallest items above ``size``, repeats included."""
        out = []
        for s in self.order[bisect_left(self.order, size + 1):]:
            out += [s] * min(self.n[s], k - len(out))
            if len(out) == k:
                break
        return out


def _best_pair(rest: Sizes, room: int) -> tuple[int, int] | None:
    """Two items (a >= b) with the largest sum up to ``room``; the largest a
    among equals."""
    best, lo, hi = None, 0, len(rest.order) - 1
    order = rest.order
    while lo <= hi:
        a, b = order[hi], order[lo]
        if a + b > room:
            hi -= 1
        else:
            if a != b or rest.n[a] > 1:
                if best is None or (a + b, a) > (best[0] + best[1], best[0]):
                    best = (a, b)
            lo += 1
    return best


def dominating_set(size: int, rest: Sizes, capacity: int) -> tuple[int, ...] | None:
    """Items that may share a bin with ``size`` for good: a set of at most two
    others which dominates every other feasible set, or None if this rule
    proves none.  ``rest`` holds the other items."""
    room = capacity - size
    small = rest.smallest(3)
    k = 0
    while k < len(small) and sum(small[: k + 1]) <= room:
        k += 1
    if k == 0:
        return ()
    first = rest.largest_up_to(room)
    if first == room or k == 1:
        return (first,)
    if k > 2:
        return None
    a, b = _best_pair(rest, room)
    if first >= a + b:
        return (first,)
    if a == first:
        # every other pair is dominated unless two items above b, other than a, still fit together
        rest.take(a, 1)
        over = rest.above(b, 2)
        rest.put(a, 1)
        if len(over) < 2 or sum(over) > room:
            return (a, b)
    return None


def reduce_sizes(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Dominance reduction: bins fixed for good as (sizes, how many such bins)
    and the counts that are left.  Passes repeat until one fixes nothing,
    since a smaller instance may prove more.  Equal items are fixed together:
    fixing a set only takes items away, so the proof holds for its repeats
    while all its sizes last."""
    left, fixed, again = Sizes(counts), [], True
    while again and left.order:
        again, at = False, capacity
        while (size := left.largest_up_to(at)) is not None:
            left.take(size, 1)
            others = dominating_set(size, left, capacity)
            left.put(size, 1)
            if others is None:
                at = size - 1
                continue
            bin_ = (size, *others)
            need = {s: bin_.count(s) for s in set(bin_)}
            times = min(left.n[s] // c for s, c in need.items())
            for s, c in need.items():
                left.take(s, times * c)
            fixed.append((bin_, times))
            again = True
    return fixed, dict(left.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: each size goes to the open bins with
    the least room that holds it, bins of equal content at once."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {capacity: []}
    rooms = [capacity]

    def add(room, bin_, times):
        if not times:
            return
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append((bin_, times))

    for size in sorted(counts, reverse=True):
        m = counts[size]
        while m:
            at = bisect_left(rooms, size)
            while at < len(rooms) and not open_[rooms[at]]:
                if rooms[at] == capacity:
                    break
                del open_[rooms[at]]
                rooms.pop(at)
            room = rooms[at]
            bin_, times = open_[room].pop() if open_[room] else ((), m)
            each = room // size
            whole = min(times, m // each)
            part = m - whole * each if whole < times and m - whole * each < each else 0
            add(room - size * each, bin_ + (size,) * each, whole)
            if part:
                add(room - size * part, bin_ + (size,) * part, 1)
            if bin_:
                add(room, bin_, times - whole - (1 if part else 0))
            m -= whole * each + part
    return [b for bins in open_.values() for b in bins if b[0]]


def pack_sizes(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (sizes in order, how many such bins): the reduction first, then
    best fit on the rest."""
    fixed, rest = reduce_sizes(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Places:
    """For each size, ranges of ranks and the bin places they take."""

    def __init__(self, bins: list[tuple[tuple[int, ...], int]]):
        seen: dict[int, int] = {}
        rows, base = [], 0
        for bin_, times in bins:
            at = 0
            for size in dict.fromkeys(bin_):
                each = bin_.count(size)
                rows.append((size, seen.get(size, 0), base, at, each))
                seen[size] = seen.get(size, 0) + times * each
                at += size * each
            base += times
        rows.sort()
        cols = np.array(rows, np.int64).reshape(-1, 5).T
        self.size, self.first, self.base, self.at, self.each = cols

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin number, offset in the bin) of the item with this size and rank."""
        out = np.empty((2, len(size)), np.int64)
        for s in np.unique(size):
            lo, hi = np.searchsorted(self.size, [s, s + 1])
            mine = np.flatnonzero(size == s)
            row = lo + np.searchsorted(self.first[lo:hi], rank[mine], side="right") - 1
            step = rank[mine] - self.first[row]
            out[0, mine] = self.base[row] + step // self.each[row]
            out[1, mine] = self.at[row] + step % self.each[row] * s
        return out[0], out[1]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        tokenizer = ByteTokenizer(path, plain=False)
        seen = np.zeros(capacity + 1, np.int64)
        for t in text_chunks(batches, 1):
            codes, first, units = cut_units(t.column(1))
            ptr, ids = tokenizer.encode(units)
            place, size = gather(ptr, codes)
            # ids of all documents one after the other, each with its end
            n_tokens = np.diff(np.concatenate([[0], np.cumsum(size)])[first])
            ends = np.cumsum(n_tokens + 1)
            buffer = np.full(int(ends[-1]), end_id, "<u4")
            keep = np.ones(len(buffer), bool)
            keep[ends - 1] = False
            buffer[keep] = ids[place]
            n_ids = n_tokens + 1
            pieces = -(-n_ids // capacity)
            doc = np.repeat(np.arange(len(n_ids)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = n_ids - (pieces - 1) * capacity   # the first piece takes what is over
            start = np.where(piece > 0, head[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, head[doc])
            begin = (ends - n_ids)[doc] + start
            view = memoryview(buffer).cast("B")
            crc = [zlib.crc32(view[4 * b: 4 * e]) for b, e in zip(begin.tolist(), (begin + length).tolist())]
            # rank among the task's pieces of this length
            order = np.argsort(length, kind="stable")
            runs = length[order]
            new = np.flatnonzero(np.diff(runs, prepend=-1))
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(runs)) - np.repeat(new, np.diff(np.append(new, len(runs))))
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [t.column(0).combine_chunks().take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                 pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int64)), pa.array(rank)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"])
    return run


def _placed(places):
    def run(batches):
        import pyarrow as pa
        where = places.value
        for b in batches:
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            seq, at = where.find(size, rank)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(seq), pa.array(at)],
                                             [*names, "sequence_id", "offset"])
    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pack whole documents (``doc_id``, ``text``) into sequences of at most
    ``capacity`` ids.  A document is its ids and one ``end_id``; only longer
    ones are cut, into pieces of ``capacity`` with the shorter piece first.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one
    row per piece.  Texts are read and encoded once and never shuffled; the
    number of pieces per length (at most ``capacity`` rows) is all the driver
    sees, and the places that are broadcast grow with ``capacity`` alone.

    Null and empty texts are the end alone; a long text is cut as above;
    repeated rows, ties of length and null doc_ids get places of their own; an
    empty table gives no rows; other columns are ignored."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, piece int, start long, length long, ids_crc32 long"
    pieces = stage(docs.mapInArrow(_pieces(path or vocabulary_path("byte_bpe_50k.json"), capacity, end_id),
                                   schema + ", _part long, _rank long"), "pieces")
    per_part = pieces.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    places = Shared(spark, Places(pack_sizes(counts, capacity)))
    ranked = pieces.join(offsets, ["length", "_part"]).select(
        *[f.split()[0] for f in schema.split(", ")], (F.col("_rank") + F.col("_before")).alias("_rank"))
    return ranked.mapInArrow(_placed(places), schema + ", sequence_id long, offset long")
