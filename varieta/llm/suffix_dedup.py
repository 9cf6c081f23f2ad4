"""Repeated passages by a run-length index over anchored contexts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_ID, free_names, stage, whole_groups

GRAM = 32                    # anchor length; the doubling below fixes it
CHUNK_BYTES = 1 << 20        # some hundred bytes of arrays for each of its bytes
INDEX_BYTES = 1 << 19
HOT_CONTEXTS = 20_000
WINDOW_BYTES = 8 << 20       # windows of hot anchors combined before they move
_U = np.uint64
_BYTE = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
_STEP = [_U(x | 1) for x in np.random.default_rng(12).integers(0, 2**63, 8).tolist()]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _double(h: np.ndarray, width: int, level: int) -> np.ndarray:
    """Hashes of strings of twice ``width`` bytes at every position."""
    if len(h) <= width:
        return h[:0]
    return _mix(h[:-width] * _STEP[level] + h[width:])


def _window_min(v: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` neighbours."""
    width = 1
    m = v
    while 2 * width <= n:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(v) - n + 1], m[n - width:]) if n > width else m


def contexts(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Cut the windows of ``length`` bytes of a buffer of documents (``ends``:
    where each ends) by their least GRAM-byte string, leftmost on ties.

    Neighbouring windows with the same least string (the anchor) make one
    context.  Equal windows have equal anchors at equal places, so two equal
    windows always lie in contexts with the same anchor.  Returns per context:
    first byte, bytes, anchor hash, content hash."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = _BYTE[data]
    for level in range(5):
        h = _double(h, 1 << level, level)
    h64 = _double(h, GRAM, 5)
    bits = _U(32)   # a fixed share for the place: equal windows choose alike in chunks of any size
    at = np.arange(len(h), dtype=np.uint64)
    least = _window_min((h >> bits << bits) | at, length - GRAM + 1)
    anchor = (least & ((_U(1) << bits) - _U(1))).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    usable = np.zeros(n + 1, np.int32)
    long_enough = ends - starts >= length
    np.add.at(usable, starts[long_enough], 1)
    np.add.at(usable, ends[long_enough] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(usable[: n - length + 1]) > 0)
    if not len(s):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    a = anchor[s]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)])
    first = s[new]
    size = s[np.r_[new[1:], len(s)] - 1] - first + length
    # three 64-byte strings cover a context of up to 192 bytes
    content = _mix(_mix(h64[first] * _STEP[6] + h64[first + size // 2 - 32]) * _STEP[7] + h64[first + size - 64]) + size.astype(np.uint64)
    return first, size, h[a[new]], _mix(content)


def _read_chunks(batches: Iterator, chunk: int, length: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, tie marks, offsets, buffer, ends) of about ``chunk`` bytes; a
    longer document comes in pieces that overlap by ``length - 1`` bytes."""
    docs, ties, offs, bufs, size = [], [], [], [], 0

    def out():
        return (np.array(docs, np.int64), np.array(ties, np.int64), np.array(offs, np.int64),
                np.frombuffer(b"".join(bufs), np.uint8), np.cumsum([len(b) for b in bufs]))
    for b in batches:
        for doc, tie, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for at in range(0, max(1, len(data) - length + 1), chunk):
                piece = data[at:at + chunk + length - 1]
                if len(piece) < length:
                    continue
                docs.append(doc)
                ties.append(tie)
                offs.append(at)
                bufs.append(piece)
                size += len(piece)
                if size >= chunk:
                    yield out()
                    docs, ties, offs, bufs, size = [], [], [], [], 0
    if docs:
        yield out()


_MARK = ["anchor", "content", "doc", "tie", "span"]


def _by_content(content: np.ndarray, docs: np.ndarray, ties: np.ndarray, offs: np.ndarray, k: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Order of contexts by (content, doc, tie, begin).  Contexts come piece by
    piece in their order, so ranking the chunk's pieces leaves one sort by
    content; only where a row stands twice in the chunk are begins compared."""
    by = np.lexsort((offs, ties, docs))
    a, z = by[:-1], by[1:]
    if ((docs[a] == docs[z]) & (ties[a] == ties[z]) & (offs[a] == offs[z])).any():
        return np.lexsort((begin, ties[k], docs[k], content))
    rank = np.empty(len(by), np.uint16 if len(by) < 1 << 16 else np.int64)
    rank[by] = np.arange(len(by))
    first = np.argsort(rank[k], kind="stable")
    return first[np.argsort(content[first], kind="stable")]


def _map_contexts(chunk: int, length: int):
    """Contexts of all documents; those that repeat an earlier one of the same
    chunk are decided here (negative span), so copies do not move as a group."""
    def run(batches):
        import pyarrow as pa
        for docs, ties, offs, data, ends in _read_chunks(batches, chunk, length):
            first, size, anchor, content = contexts(data, ends, length)
            if not len(first):
                continue
            k = np.searchsorted(ends, first, side="right")
            begin = first - np.concatenate([[0], ends[:-1]])[k] + offs[k]
            doc, tie = docs[k], ties[k]
            span = begin << 8 | size
            order = _by_content(content, docs, ties, offs, k, begin)
            a, z = order[:-1], order[1:]
            again, twice = np.zeros(len(order), bool), np.zeros(len(order), bool)
            again[z] = (content[z] == content[a]) & (anchor[z] == anchor[a])
            twice[z] = again[z] & (doc[z] == doc[a]) & (tie[z] == tie[a]) & (begin[z] == begin[a])
            # decided rows are dealt by document, the others by anchor
            anchor = np.where(again, _mix(doc.astype(np.uint64)), anchor)
            cols = (anchor.view(np.int64), content.view(np.int64), doc, tie, np.where(again, -span, span))
            yield pa.RecordBatch.from_arrays([pa.array(c[~twice]) for c in cols], _MARK)  # a repeated row is no other place
    return run


def _reduce_contexts(batches: Iterator) -> Iterator:
    """Rows sorted by (anchor, content, doc, tie, span).  A context equal to an
    earlier one is repeated as a whole (kind 0).  Of contexts that share an
    anchor but differ, the first of each content goes to the index (kind 1).
    Streams: only the last rows' keys and one open context are held."""
    import pyarrow as pa
    last = None                   # the row before
    open_row, open_many = None, False

    def rows(kind, cols):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *(pa.array(c) for c in cols)],
                                          ["kind", "anchor", "doc", "tie", "span"])
    for b in batches:
        c = [b.column(i).to_numpy() for i in range(5)]
        done = c[4] < 0
        if done.any():
            yield rows(0, [c[0][done], c[2][done], c[3][done], -c[4][done]])
            c = [x[~done] for x in c]
        if not len(c[0]):
            continue
        same = np.ones(len(c[0]), bool)
        for k, x in enumerate(c):
            same &= np.r_[last is not None and x[0] == last[k], x[1:] == x[:-1]]
            if k == 1:
                equal = same.copy()
        twice, same = same, equal
        last = tuple(x[-1] for x in c)
        same, c = same[~twice], [x[~twice] for x in c]
        if not len(same):
            continue
        anchor, content, doc, tie, span = c
        if same.any():
            yield rows(0, [anchor[same], doc[same], tie[same], span[same]])
        a, d, t, s = anchor[~same], doc[~same], tie[~same], span[~same]
        if not len(a):
            continue
        if open_row is not None:
            a, d, t, s = (np.r_[x, y] for x, y in zip(open_row, (a, d, t, s)))
            lead = 1
        else:
            lead = 0
        many = np.zeros(len(a), bool)
        eq = a[1:] == a[:-1]
        many[1:] |= eq
        many[:-1] |= eq
        if lead and open_many:
            # the open context was already sent: its anchor's new contexts follow it
            many[a == a[0]] = True
        send = many.copy()
        if lead and open_many:
            send[0] = False
        tail_many = bool(many[-1])
        if not tail_many:
            send[-1] = False
        if send.any():
            yield rows(1, [x[send] for x in (a, d, t, s)])
        open_row, open_many = tuple(x[-1:] for x in (a, d, t, s)), tail_many
    return


_DECIDED, _WINDOW, _CONTEXT = range(3)
_CUT = ["kind", "key", "data", "doc", "tie", "start"]


def _cut_contexts(length: int, window_bytes: int):
    """Bytes of the contexts that go to the index, cut from their documents.
    Contexts of a hot anchor are cut in single windows, each under its own
    key.  Of equal windows of one chunk only the first place moves; the others
    are decided here (``start`` is then the packed span)."""
    def run(batches):
        from xxhash import xxh64_intdigest
        seen: set[tuple[int, int]] = set()
        out: tuple[list, ...] = ([], [], [], [], [], [])
        first: dict[bytes, tuple[int, int, int]] = {}
        again: list[tuple[int, int, int]] = []
        size = wide = 0

        def put(*row):
            for o, v in zip(out, row):
                o.append(v)

        def combined():
            for w, place in first.items():
                put(_WINDOW, xxh64_intdigest(w, 3) - 2**63, w, *place)
            if again:
                doc, tie, span = _runs(*np.array(again, np.int64).T, length)
                for key, d, t, x in zip(_mix(doc.astype(np.uint64)).view(np.int64).tolist(), doc.tolist(), tie.tolist(), span.tolist()):
                    put(_DECIDED, key, b"", d, t, x)
            first.clear()
            again.clear()
        for b in batches:
            for doc, tie, text, todo in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (doc, tie) in seen:        # a repeated row is no other place
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add((doc, tie))
                data = (text or "").encode("utf-8", "surrogatepass")
                for x in todo:
                    at, n = x["span"] >> 8, x["span"] & 255
                    if not x["hot"]:
                        put(_CONTEXT, x["anchor"], data[at:at + n], doc, tie, at)
                        size += n
                        continue
                    for i in range(at, at + n - length + 1):
                        w, place = data[i:i + length], (doc, tie, i)
                        old = first.setdefault(w, place)
                        if old is place:
                            wide += length
                        elif old != place:
                            first[w] = min(old, place)
                            again.append(max(old, place))
                            wide += 24
                    if wide >= window_bytes:
                        combined()
                        wide, size = 0, size + wide
                if size > 8 << 20:
                    yield _cut_batch(out)
                    out, size = ([], [], [], [], [], []), 0
        combined()
        if out[0]:
            yield _cut_batch(out)
    return run


def _cut_batch(out):
    import pyarrow as pa
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], _CUT)


def _runs(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as packed spans: neighbours in one document are joined as far
    as a span's size allows."""
    by = np.lexsort((start, tie, doc))
    doc, tie, start = doc[by], tie[by], start[by]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] > start[:-1] + 1)]
    head = start[np.flatnonzero(new)][np.cumsum(new) - 1]
    block = (start - head) // (256 - length)
    new |= np.r_[False, block[1:] != block[:-1]]
    at = np.flatnonzero(new)
    size = start[np.r_[at[1:], len(start)] - 1] - start[at] + length
    return doc[at], tie[at], start[at] << 8 | size


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a set of strings, sorted by
    their first ``depth`` symbols.

    Kept are the runs of the transform (first row, symbol, rows of the symbol
    before it), the first row of every symbol and, for every maximal run of
    rows that share ``depth`` symbols, its ends and one sample: the occurrence
    that comes first in the order of ``value``."""

    def __init__(self, data: np.ndarray, value: np.ndarray, depth: int):
        # data: symbols, 0 ends a string; value: order of a position
        n = len(data)
        self.n, self.depth = n, depth
        rank, width = data.astype(np.uint64), 1
        rows = None
        shift = _U(max(1, int(n).bit_length()))
        low = (_U(1) << shift) - _U(1)
        at = np.arange(n, dtype=np.uint64)
        base = np.zeros(n + depth, np.uint64)
        base[:n] = rank
        rank = np.zeros(n, np.uint64)
        width = min(4, depth)
        for k in range(width):                    # 9 bits a symbol
            rank = (rank << _U(9)) | base[k:k + n]
        while True:
            key = np.sort(rank << shift | at)
            rows = (key & low).astype(np.int64)
            key >>= shift
            new = np.r_[False, key[1:] != key[:-1]]
            dense = np.empty(n, np.uint64)
            dense[rows] = np.cumsum(new).astype(np.uint64)
            if width >= depth:
                break
            reach = min(2 * width, depth)
            nxt = np.zeros(n, np.uint64)
            nxt[: n - (reach - width)] = dense[reach - width:] + _U(1)
            top = int(dense.max()) + 2
            rank, width = dense * _U(top) + nxt, reach
            if top * top >= 1 << (64 - int(shift)):
                # too many ranks for one packed key: make the pairs dense first
                rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        bwt = data[rows - 1]                       # position 0 follows the last end
        heads = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        symbol = bwt[heads].astype(np.int64)
        length = np.diff(np.r_[heads, n])
        order = np.argsort(symbol, kind="stable")
        total = np.cumsum(length[order]) - length[order]
        begin = np.searchsorted(symbol[order], np.arange(258))
        self.symbol_row = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=257))])[:257]
        per = np.r_[total, 0][np.minimum(begin, len(total))]
        self.run_key = symbol[order] * (n + 1) + heads[order]
        self.run_before = total - per[symbol[order]]
        self.run_length = length[order]
        self.symbol_run = begin
        starts = np.flatnonzero(np.r_[True, new[1:]])
        self.class_start = np.r_[starts, n]
        self.sample = np.minimum.reduceat(value[rows], starts)

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often the symbols stand in the transform before the rows."""
        i = np.searchsorted(self.run_key, symbol * (self.n + 1) + row, side="left") - 1
        ok = i >= self.symbol_run[symbol]
        i = np.maximum(i, 0)
        inside = row - (self.run_key[i] - symbol * (self.n + 1))
        return np.where(ok, self.run_before[i] + np.minimum(inside, self.run_length[i]), 0)

    def extend(self, symbol, low, high):
        """Rows of the matches extended by a symbol to the left."""
        base = self.symbol_row[symbol]
        return base + self.rank(symbol, low), base + self.rank(symbol, high)

    def at_depth(self, row):
        """The run of rows that share ``depth`` symbols with a row."""
        c = np.searchsorted(self.class_start, row, side="right") - 1
        return self.class_start[c], self.class_start[c + 1], self.sample[c]


def repeated_windows(strings: list[bytes], order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every window of ``length`` bytes that occurs earlier.

    ``order[j]`` ranks the strings' places in the corpus.  All strings stream
    through the index right to left, side by side: the matching length grows
    to ``length`` and stays there, the row range then is that of the window,
    and its sample tells whether an earlier place holds it."""
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    data = np.zeros(int(ends[-1]), np.int16)
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    data[:] = raw
    data += 1
    data[ends - 1] = 0
    place = np.arange(len(data)) - np.repeat(begins, sizes + 1)
    value = np.repeat(order.astype(np.int64), sizes + 1) * 512 + place
    index = RunLengthIndex(data, value, length)
    # longest first, so the strings still streaming are a prefix
    by_size = np.argsort(-sizes, kind="stable")
    low, high = np.zeros(len(strings), np.int64), np.full(len(strings), index.n, np.int64)
    live = np.searchsorted(-sizes[by_size], -np.arange(1, sizes.max() + 1), side="right")
    found_s, found_o = [], []
    for step, m in enumerate(live.tolist(), 1):
        j = by_size[:m]
        pos = begins[j] + sizes[j] - step
        low, high = index.extend(data[pos].astype(np.int64), low[:m], high[:m])
        if step >= length:
            low, high, sample = index.at_depth(low)
            again = sample < value[pos]
            found_s.append(j[again])
            found_o.append((sizes[j] - step)[again])
    if not found_s:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_s), np.concatenate(found_o)


def _once(batches: Iterator, keys: list[str]) -> Iterator:
    """Batches sorted by ``keys`` without the rows that equal the row before
    in all of them.  Streams: only the last row's keys are held."""
    import pyarrow as pa
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        c = [b.column(k).to_numpy() for k in keys]
        same = np.ones(b.num_rows, bool)
        for k, x in enumerate(c):
            same &= np.r_[last is not None and x[0] == last[k], x[1:] == x[:-1]]
        last = tuple(x[-1] for x in c)
        yield b.filter(pa.array(~same)) if same.any() else b


def _found(doc, tie, span):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tie), pa.array(span)], ["doc", "tie", "span"])


def _repeated_single_windows(length: int):
    """Windows sorted by (data, doc, tie, start) under each key: all but the
    first place of each are repeated.  Streams: only the last row is held."""
    last = last_place = None

    def run(b):
        nonlocal last, last_place
        data = np.frombuffer(b"".join(b.column("data").to_pylist()), np.uint8).reshape(-1, length)
        place = np.stack([b.column(c).to_numpy() for c in ("doc", "tie", "start")], axis=1)
        before = np.concatenate([data[:1] if last is None else last, data[:-1]])
        before_place = np.concatenate([place[:1] if last is None else last_place, place[:-1]])
        again = (data == before).all(axis=1) & (place != before_place).any(axis=1)
        last, last_place = data[-1:], place[-1:]
        return _runs(*place[again].T, length) if again.any() else None
    return run


def _index_contexts(length: int, index_bytes: int):
    """Rows sorted by _CUT: decided spans, single windows, then contexts.  Rows
    that repeat a document give its contexts again, which are no other places."""
    def run(batches):
        import pyarrow as pa
        batches, windows = iter(batches), _repeated_single_windows(length)
        rest: Iterator = iter(())
        for b in batches:
            kind = b.column(0).to_numpy()
            done, single, other = (b.filter(pa.array(kind == k)) for k in (_DECIDED, _WINDOW, _CONTEXT))
            if done.num_rows:
                yield _found(*(done.column(c).to_numpy() for c in ("doc", "tie", "start")))
            if single.num_rows and (got := windows(single)) is not None:
                yield _found(*got)
            if other.num_rows:                 # the last kind
                rest = chain([other], batches)
                break
        for t in whole_groups(_once(rest, ["key", "doc", "tie", "start"]), ["key"], index_bytes, "data"):
            doc, tie, start = (t.column(c).to_numpy() for c in ("doc", "tie", "start"))
            order = np.empty(len(doc), np.int64)
            order[np.lexsort((start, tie, doc))] = np.arange(len(doc))
            s, o = repeated_windows(t.column("data").to_pylist(), order, length)
            if not len(s):
                continue
            by = np.lexsort((o, s))
            s, o = s[by], o[by]
            new = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1)])
            stop = np.r_[new[1:], len(s)] - 1
            at = start[s[new]] + o[new]
            size = o[stop] - o[new] + length
            yield _found(doc[s[new]], tie[s[new]], at << 8 | size)
    return run


def repeated_spans(docs: DataFrame, length: int = 100, chunk_bytes: int = CHUNK_BYTES, index_bytes: int = INDEX_BYTES,
                   hot_contexts: int = HOT_CONTEXTS, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """(doc, tie, span) over ``docs(doc, tie, text)``: spans (start << 8 | bytes)
    whose bytes lie in a window of ``length`` bytes that starts earlier.

    1. Every document is cut in contexts by anchors; equal contexts are
       combined, per chunk before the shuffle and then per anchor.
    2. Different contexts with one anchor go, by anchor, through a run-length
       index that finds the windows they share.  Those of an anchor with more
       than ``hot_contexts`` go as single windows: equal ones are combined per
       chunk before the shuffle, the others compared with the row before.
    A context or window is compared by two 64-bit hashes in step 1, by its
    bytes in step 2."""
    if not 2 * GRAM <= length <= 112:
        raise ValueError("length must be between 64 and 112 bytes")
    marks = docs.select("doc", "tie", "text").mapInArrow(
        _map_contexts(chunk_bytes, length), "anchor long, content long, doc long, tie long, span long")
    found = stage(marks.repartition("anchor").sortWithinPartitions(*_MARK).mapInArrow(
        _reduce_contexts, "kind int, anchor long, doc long, tie long, span long"), "contexts")
    todo = found.where("kind = 1")
    hot = todo.groupBy("anchor").count().where(F.col("count") > hot_contexts).select("anchor", F.lit(True).alias("hot"))
    todo = todo.join(hot, "anchor", "left").groupBy("doc", "tie").agg(
        F.collect_list(F.struct("anchor", "span", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("todo"))
    cut = docs.select("doc", "tie", "text").join(todo, ["doc", "tie"]).select("doc", "tie", "text", "todo").mapInArrow(
        _cut_contexts(length, window_bytes), "kind int, key long, data binary, doc long, tie long, start long")
    shared = stage(cut.repartition("key").sortWithinPartitions(*_CUT).mapInArrow(
        _index_contexts(length, index_bytes), "doc long, tie long, span long"), "windows")
    return found.where("kind = 0").select("doc", "tie", "span").unionByName(shared)


def merge_spans(spans: list[int]) -> list[tuple[int, int]]:
    """Sorted, disjoint (start, end) of packed spans."""
    out: list[tuple[int, int]] = []
    for a, n in sorted((s >> 8, s & 255) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], a + n))
        else:
            out.append((a, a + n))
    return out


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, z in spans:
        parts.append(data[at:a])
        at = z
    parts.append(data[at:])
    return b"".join(parts)


def _whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the characters of which they hold only a part."""
    out = []
    for a, z in spans:
        while a < z and data[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(data) and data[z] & 0xC0 == 0x80:
            z -= 1
        if a < z:
            out.append((a, z))
    return out


def _with_spans(docs: DataFrame, length: int, options: dict) -> DataFrame:
    """``docs`` and, as last column, the packed spans, null where nothing is repeated."""
    doc, tie, packed = free_names(docs.columns, "_doc", "_tie", "_spans")
    keyed = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID))) \
        .withColumn(tie, F.coalesce(F.xxhash64("text"), F.lit(0)))
    spans = repeated_spans(keyed.select(F.col(doc).alias("doc"), F.col(tie).alias("tie"), "text"), length, **options)
    per = spans.groupBy(F.col("doc").alias(doc), F.col("tie").alias(tie)).agg(F.collect_list("span").alias(packed))
    return keyed.join(per, [doc, tie], "left").select(*docs.columns, packed)


def dedup_passages(docs: DataFrame, length: int = 100, **options) -> DataFrame:
    """One row per document of ``docs(doc_id, text)``: doc_id, n_bytes,
    n_removed, n_spans, kept_sha256.  A byte is removed if a window of
    ``length`` bytes over it also starts earlier: in a smaller doc_id, or in
    the same document at an earlier byte.  Windows are judged on the input and
    may overlap.

    Null and empty texts have no bytes; null doc_ids come after all others,
    rows with one doc_id in the order of their texts' hashes; rows that repeat
    doc_id and text are one document with one result, given for each row; an
    empty table gives no rows; other columns are ignored."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            rows = []
            for text, packed in zip(b.column(1), b.column(2)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                spans = merge_spans(packed.as_py() or [])
                left = _kept(data, spans)
                rows.append((len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(docs.select("doc_id", "text"), length, options).mapInArrow(
        run, f"doc_id {doc_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_passages(docs: DataFrame, length: int = 100, **options) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``; ``n_chars``,
    where there, follows.  A character of which only some bytes are repeated
    stays whole.  Rows are kept, even if nothing is left of their text."""
    columns, schema = docs.columns, docs.schema
    at = columns.index("text")
    chars = columns.index("n_chars") if "n_chars" in columns else None
    spans_at = len(columns)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            cols = list(b.columns)[:len(columns)]
            texts = cols[at].to_pylist()
            sizes = cols[chars].to_pylist() if chars is not None else None
            for k, packed in enumerate(b.column(spans_at).to_pylist()):
                if not packed:
                    continue
                data = texts[k].encode("utf-8", "surrogatepass")
                texts[k] = _kept(data, _whole_characters(data, merge_spans(packed))).decode("utf-8", "surrogatepass")
                if sizes is not None:
                    sizes[k] = len(texts[k])
            cols[at] = pa.array(texts, cols[at].type)
            if sizes is not None:
                cols[chars] = pa.array(sizes, cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, columns)
    return _with_spans(docs, length, options).mapInArrow(run, schema)
