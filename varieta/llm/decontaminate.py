"""Benchmark decontamination with a generalised suffix automaton of the items."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, free_names, stage

WINDOW = 10
BLOCK_WORDS = 50_000
# A-Z to a-z; every other ASCII sign that is no letter or digit to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RESULT = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "coverage double, kept_text string")


def item_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over the word sequences of items.

    ``step`` arrays are kept as plain lists: ``next[s]`` maps a word to a
    state, ``link[s]`` is the longest proper suffix in another class and
    ``length[s]`` the longest string of the class.  ``window_of[s]`` is the
    state of the last ``window`` words of a match ending in ``s``;
    ``shorts[s]`` lists the whole items of fewer words that end there."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _clone(self, p: int, word, q: int) -> int:
        """Split off the strings of class ``q`` that end a step after ``p``."""
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, word) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return new

    def build(self, items: list[tuple[str, int, list]]) -> SuffixAutomaton:
        """``items``: (name, words of the whole item, words of this piece)."""
        for _, _, words in items:
            s = 0
            for w in words:
                s = self._extend(s, w)
        n = len(self.next)
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.window_of = [-1] * n
        for s in order:
            if self.length[s] >= self.window:
                self.window_of[s] = s if self.length[self.link[s]] < self.window else self.window_of[self.link[s]]
        own: dict[int, set] = {}
        self.items: dict[int, set] = {}
        for name, whole, words in items:
            s = 0
            for i, w in enumerate(words):
                s = self.next[s][w]
                if whole >= self.window and i >= self.window - 1:
                    self.items.setdefault(self.window_of[s], set()).add(name)
            if 0 < whole < self.window:
                own.setdefault(s, set()).add((whole, name))
        none: tuple = ()
        self.shorts = [none] * n
        for s in order:
            above = self.shorts[self.link[s]]
            self.shorts[s] = (*sorted(own[s], reverse=True), *above) if s in own else above
        return self

    def hits(self, words: list) -> tuple[bytearray | None, set]:
        """Stream ``words``; a mask of hit words (None: no hit) and the items."""
        nxt, link, length, window, shorts = self.next, self.link, self.length, self.window, self.shorts
        window_of = self.window_of
        mask, found = None, set()
        s = n = 0
        i = -1
        for w in words:
            i += 1
            t = nxt[s].get(w)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = nxt[s].get(w)
            if t is None:
                n = 0
                continue
            s = t
            n += 1
            if n >= window:
                if mask is None:
                    mask = bytearray(len(words))
                mask[i + 1 - window:i + 1] = b"\x01" * window
                found |= self.items.get(window_of[s], found)
            if shorts[s]:
                for k, name in shorts[s]:
                    if k <= n:
                        if mask is None:
                            mask = bytearray(len(words))
                        mask[i + 1 - k:i + 1] = b"\x01" * k
                        found.add(name)
        return mask, found


def _pieces(batches: Iterator, longest: int, window: int) -> Iterator:
    """Items cut in pieces of at most ``longest`` words that overlap by
    ``window - 1``, so that every window lies in one piece."""
    import pyarrow as pa
    for b in batches:
        names, wholes, parts = [], [], []
        for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = item_words(text)
            for at in range(0, max(1, len(words) - window + 1), longest - window + 1):
                piece = words[at:at + longest]
                if piece:
                    names.append(name)
                    wholes.append(len(words))
                    parts.append(b" ".join(piece))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(wholes, pa.int64()), pa.array(parts, pa.binary())],
                                         ["item", "whole", "piece"])


def _runs(mask: bytearray) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(b"\x01+", bytes(mask))]


def _without(text: str, mask: bytearray) -> str:
    """``text`` without the characters from the first to the last word of every hit run."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in _runs(mask):
        out.append(text[at:spans[a][0]])
        at = spans[b - 1][1]
    out.append(text[at:])
    return "".join(out)


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator:
    """Broadcast automata over blocks of about half ``block_words`` words (one
    block if all fit); each block is fetched by itself when it is built."""
    longest = max(2 * window, block_words // 8)
    spark = benchmark.sparkSession
    items = benchmark.where(F.col("text").isNotNull()) \
        .select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    # rows that repeat an item and its text say nothing new, and would meet in one block
    p = stage(items.mapInArrow(lambda it: _pieces(it, longest, window), "item string, whole long, piece binary").distinct(), "items")
    total = p.agg(F.coalesce(F.sum(F.size(F.split(F.col("piece").cast("string"), " "))), F.lit(0))).first()[0]
    n = max(1, math.ceil(2 * total / block_words)) if total > block_words else 1
    p = p.withColumn("_block", F.pmod(F.xxhash64("item", "piece"), F.lit(n)))
    for k in range(n):
        rows = p.where(F.col("_block") == k).select("item", "whole", "piece").collect()
        yield Shared(spark, SuffixAutomaton(window).build(
            [(r.item, r.whole, bytes(r.piece).split(b" ")) for r in rows]))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of ``docs`` and, last, hit masks (one per automaton with hits,
    over words) and the items whose windows occur, under names that are free.

    The items are dealt in blocks of at most ``block_words`` words, a fixed
    bound on every broadcast automaton; documents are read once per block and
    nothing is shuffled.  A benchmark of one block takes one pass."""
    from pyspark.sql import types as T
    names = free_names(docs.columns, "_masks", "_items")
    out = docs.withColumn(names[0], F.array().cast("array<binary>")).withColumn(names[1], F.array().cast("array<string>"))
    first = True
    for auto in _blocks(benchmark, window, block_words):
        schema = T.StructType(out.schema.fields)
        out = (out if first else stage(out, "hits")).mapInArrow(_marker(auto, out.columns), schema)
        first = False
    return out


def _marker(auto, columns):
    at = [columns.index("text"), len(columns) - 2, len(columns) - 1]

    def run(batches):
        import pyarrow as pa
        find = auto.value.hits
        for b in batches:
            masks, items = b.column(at[1]).to_pylist(), b.column(at[2]).to_pylist()
            for k, text in enumerate(b.column(at[0])):
                mask, found = find(item_words(text.as_py()))
                if mask is not None:
                    masks[k].append(bytes(mask))
                    items[k] = sorted({*items[k], *found})
            cols = list(b.columns)
            cols[at[1]], cols[at[2]] = pa.array(masks, pa.list_(pa.binary())), pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, columns)
    return run


def _merged(masks: list[bytes]) -> bytearray:
    out = bytearray(masks[0])
    for m in masks[1:]:
        out = bytearray((int.from_bytes(out, "big") | int.from_bytes(m, "big")).to_bytes(len(out), "big"))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, coverage (hit share) and kept_text (the text without the hit
    spans; null for a null text).

    A window is ``window`` consecutive words of an item, or the whole item if
    it has fewer; words inside any occurrence are hit.  Matching lengths come
    from streaming the whole text through the automaton.

    Null or empty texts have no words; items without words have no window;
    null item_ids count as the empty name; repeated items and repeated rows
    give one result each; an empty table on either side gives no hits; other
    columns are ignored."""
    found = find_hits(docs.select("doc_id", "text"), benchmark, window, block_words)

    def finish(batches):
        import pyarrow as pa
        empty = hashlib.sha256(b"").hexdigest()
        for b in batches:
            rows = []
            for text, masks, items in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                n = len(item_words(text))
                if not masks:
                    rows.append((n, 0, 0, empty, False, 0.0, text))
                    continue
                mask = _merged(masks)
                n_hit = sum(mask)
                rows.append((n, n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), True, n_hit / n,
                             _without(text, mask)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             ["doc_id", *(f.split()[0] for f in RESULT.split(", "))])
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(finish, f"doc_id {doc_type}, {RESULT}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, window: int = WINDOW,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with every hit span cut out of ``text``; documents with more
    than ``max_coverage`` of their words hit are left out.  Columns, other
    rows and texts without a hit stay as they are; ``n_chars``, where there,
    follows the new text.  Nulls and empty texts pass."""
    columns = docs.columns
    schema = docs.schema
    found = find_hits(docs, benchmark, window, block_words)
    at = columns.index("text")
    chars = columns.index("n_chars") if "n_chars" in columns else None

    def cut(batches):
        import pyarrow as pa
        for b in batches:
            texts = b.column(at).to_pylist()
            masks = b.column(len(columns)).to_pylist()
            hit = [k for k, m in enumerate(masks) if m]
            if not hit:
                yield pa.RecordBatch.from_arrays(list(b.columns)[:len(columns)], columns)
                continue
            keep = [True] * len(texts)
            sizes = b.column(chars).to_pylist() if chars is not None else None
            for k in hit:
                mask = _merged(masks[k])
                if sum(mask) > max_coverage * len(mask):
                    keep[k] = False
                texts[k] = _without(texts[k], mask)
                if sizes is not None:
                    sizes[k] = len(texts[k])
            cols = list(b.columns)[:len(columns)]
            cols[at] = pa.array(texts, cols[at].type)
            if sizes is not None:
                cols[chars] = pa.array(sizes, cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, columns).filter(pa.array(keep))
    return found.mapInArrow(cut, schema)


# The same result for DuckDB: positions joined with the windows of each length.
DECONTAMINATION_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r,
              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(ws)) AS k, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS t
        FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS p FROM iw WHERE len(ws) > 0)),
pos AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM dw),
occ AS (SELECT pos.r, pos.p, win.k, win.item
        FROM (SELECT r, p, k, array_to_string(ws[p:p + k - 1], ' ') AS t FROM pos, (SELECT DISTINCT k FROM win) WHERE p + k - 1 <= len(ws)) pos
        JOIN win ON win.k = pos.k AND win.t = pos.t),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
        FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
