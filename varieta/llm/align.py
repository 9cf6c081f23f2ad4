"""Alignment of two tokenizers' tokens by sparse incidence matrices.

For a chunk of texts each distinct unit (see ``tokens``) is aligned once.  Its
byte places are the columns of two incidence matrices, one row a token; the
product of the first with the transpose of the second links tokens whose byte
ranges overlap.  Places where tokens of both sides end cut the tokens into
groups; the product of the token-by-group matrices links tokens of one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .tokens import ByteTokenizer, PieceTokenizer, cut_units, gather, text_chunks, vocabulary_path

CHUNK_BYTES = 5_000_000      # text aligned at a time: some fifty bytes of arrays for each of its bytes
BLOCK_PRODUCTS = 2_000_000   # multiplications of a sparse product held at a time


class Csr:
    """Compressed sparse rows of ones: columns of row i at ptr[i]:ptr[i + 1]."""

    def __init__(self, ptr: np.ndarray, cols: np.ndarray, n_cols: int):
        self.ptr, self.cols, self.n_cols = ptr, cols, n_cols

    @classmethod
    def of_lengths(cls, lengths: np.ndarray) -> Csr:
        """Row i holds the next ``lengths[i]`` columns: tokens over bytes."""
        ptr = np.concatenate([[0], np.cumsum(lengths)])
        return cls(ptr, np.arange(int(ptr[-1])), int(ptr[-1]))

    @classmethod
    def of_column(cls, column: np.ndarray, n_cols: int) -> Csr:
        """One column a row: tokens over groups."""
        return cls(np.arange(len(column) + 1), column, n_cols)

    def transpose(self) -> Csr:
        rows = np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))
        order = np.argsort(self.cols, kind="stable")
        ptr = np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=self.n_cols))])
        return Csr(ptr, rows[order], len(self.ptr) - 1)


def row_products(a: Csr, b: Csr, block: int = BLOCK_PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gustavson's product a.b row by row: row i of the result is the sum of
    the rows of b that row i of a names.  Yields (row, column, value) of whole
    rows, about ``block`` multiplications at a time."""
    work = np.concatenate([[0], np.cumsum(np.diff(b.ptr)[a.cols])])[a.ptr]   # multiplications before each row
    n, at = len(a.ptr) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(work, work[at] + block, side="right")) - 1)
        named = a.cols[a.ptr[at]: a.ptr[to]]
        place, size = gather(b.ptr, named)
        row = np.repeat(np.repeat(np.arange(at, to), np.diff(a.ptr[at: to + 1])), size)
        key, value = np.unique(row * b.n_cols + b.cols[place], return_counts=True)
        yield key // max(b.n_cols, 1), key % max(b.n_cols, 1), value
        at = to


class Alignment:
    """Tokens, groups and links of distinct units under both tokenizers."""

    def __init__(self, units: list[bytes], first: ByteTokenizer, second: PieceTokenizer):
        self.a_ptr, self.a_ids = first.encode(units)
        self.b_ptr, self.b_ids = second.encode(units)
        size = np.array([len(u) for u in units], np.int64)
        self.valid = np.ones(len(units), bool)
        for ptr, ids, lengths in ((self.a_ptr, self.a_ids, first.lengths), (self.b_ptr, self.b_ids, second.lengths)):
            self.valid &= np.diff(np.concatenate([[0], np.cumsum(lengths[ids])])[ptr]) == size
        # units whose bytes do not come back have no tokens
        self.a_ptr, self.a_ids = self._keep(self.a_ptr, self.a_ids)
        self.b_ptr, self.b_ids = self._keep(self.b_ptr, self.b_ids)
        self.a = Csr.of_lengths(first.lengths[self.a_ids])
        self.b = Csr.of_lengths(second.lengths[self.b_ids])
        ends = np.intersect1d(self.a.ptr[1:], self.b.ptr[1:], assume_unique=True)
        self.a_group = np.searchsorted(ends, self.a.ptr[1:])
        self.b_group = np.searchsorted(ends, self.b.ptr[1:])
        self.n_groups = len(ends)
        self.a_unit = np.repeat(np.arange(len(units)), np.diff(self.a_ptr))

    def _keep(self, ptr, ids):
        size = np.diff(ptr)
        kept = ids[np.repeat(self.valid, size)]
        return np.concatenate([[0], np.cumsum(np.where(self.valid, size, 0))]), kept

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, shared bytes) of all links of overlapping ranges."""
        return row_products(self.a, self.b.transpose())

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, 1) of all pairs that stand in one group."""
        a = Csr.of_column(self.a_group, self.n_groups)
        return row_products(a, Csr.of_column(self.b_group, self.n_groups).transpose())

    def group_link_counts(self) -> np.ndarray:
        """Entries of each A token's row in that product, without forming it."""
        return np.bincount(self.b_group, minlength=self.n_groups)[self.a_group]

    def per_unit(self, per_token: np.ndarray) -> np.ndarray:
        return np.bincount(self.a_unit, per_token, minlength=len(self.valid)).astype(np.int64)

    def groups_of_units(self) -> np.ndarray:
        """Groups of each unit: a unit's end is an end of both sides."""
        new = np.diff(self.a_group, prepend=-1) > 0
        return self.per_unit(new)

    def group_texts(self) -> list[str]:
        """Each unit's groups as ``a1,a2|b1;a3|b2``."""
        def per_group(group, ids):
            words = self.digits(ids)
            cut = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(words))
            out = words[cut[:-1]]
            for g in np.flatnonzero(np.diff(cut) > 1).tolist():
                out[g] = ",".join(words[cut[g]: cut[g + 1]])
            return out.tolist()
        both = [f"{x}|{y}" for x, y in zip(per_group(self.a_group, self.a_ids), per_group(self.b_group, self.b_ids))]
        at = np.concatenate([[0], np.cumsum(self.groups_of_units())]).tolist()
        return [";".join(both[s:e]) for s, e in zip(at[:-1], at[1:])]

    @staticmethod
    def digits(ids: np.ndarray) -> np.ndarray:
        known, which = np.unique(ids, return_inverse=True)
        return np.array([str(i) for i in known.tolist()] or [""], object)[which]


def _tokenizers(paths):
    return ByteTokenizer(paths[0], plain=True), PieceTokenizer(paths[1])


def _doc_sums(first, codes, per_unit):
    return np.diff(np.concatenate([[0], np.cumsum(per_unit[codes])])[first])


def _aligned(paths, chunk_bytes: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, tools = TaskContext.get().partitionId() << 32, _tokenizers(paths)
        for k, t in enumerate(text_chunks(batches, 1, chunk_bytes)):
            codes, first, units = cut_units(t.column(1), lead=True)
            al = Alignment(units, *tools)
            n = t.num_rows
            doc = np.repeat(np.arange(n), np.diff(first))
            lost = np.bincount(doc, ~al.valid[codes], minlength=n) > 0
            codes, doc = codes[~lost[doc]], doc[~lost[doc]]
            first = np.searchsorted(doc, np.arange(n + 1))
            times = np.bincount(codes, minlength=len(units))
            # links by unit and id pair, pairs numbered inside the chunk
            links = [(al.a_unit[i], al.a_ids[i] << 32 | al.b_ids[j]) for i, j, _ in al.overlaps()]
            unit, pair = (np.concatenate([x[c] for x in links]) if links else np.zeros(0, np.int64) for c in (0, 1))
            seen = times[unit] > 0
            unit, pair = unit[seen], pair[seen]
            pairs, local = np.unique(pair, return_inverse=True)
            total = np.bincount(local, times[unit], minlength=len(pairs)).astype(np.int64)
            n_links = np.bincount(unit, minlength=len(units))
            del links, pair
            text_of = np.array([*al.group_texts(), None], object)[:-1]
            digests = ["" if s == e else hashlib.sha256(";".join(text_of[codes[s:e]]).encode()).hexdigest()
                       for s, e in zip(first[:-1].tolist(), first[1:].tolist())]
            del text_of
            # each document's distinct units, for the second pass
            key, mult = np.unique(doc * max(len(units), 1) + codes, return_counts=True)
            u_doc, u_code = key // max(len(units), 1), key % max(len(units), 1)
            u_ptr = np.searchsorted(u_doc, np.arange(n + 1)).astype(np.int32)
            ids = t.column(0).combine_chunks()
            chunk = pa.array(np.full(n, part + k, np.int64))
            counts = [_doc_sums(first, codes, x) for x in (np.diff(al.a_ptr), np.diff(al.b_ptr), al.groups_of_units(), n_links,
                                                           al.per_unit(al.group_link_counts()))]
            lists = [pa.ListArray.from_arrays(pa.array(u_ptr), pa.array(x.astype(np.int32))) for x in (u_code, mult)]
            none = pa.nulls(n, pa.list_(pa.int64()))
            names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "units", "times", "pairs", "counts",
                     "link_unit", "link_pair"]
            none_i = pa.nulls(n, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([chunk, ids, *map(pa.array, counts), pa.array(digests, pa.string()), *lists, none, none,
                                              none_i, none_i], names)

            def whole(x, kind):
                return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays(
                [chunk.slice(0, 1), pa.nulls(1, ids.type), *[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.string()),
                 pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), whole(pairs, pa.int64()), whole(total, pa.int64()),
                 whole(unit.astype(np.int32), pa.int32()), whole(local.astype(np.int32), pa.int32())], names)
    return run


def _summed(left, right):
    """Sums of a chunk's documents from its units, links and corpus counts."""
    import pyarrow as pa
    is_chunk = left.column("link_unit").is_valid().to_numpy(zero_copy_only=False)
    docs = left.filter(pa.array(~is_chunk))
    head = left.filter(pa.array(is_chunk))
    unit, pair = (head.column(c).combine_chunks().flatten().to_numpy() for c in ("link_unit", "link_pair"))
    n = int(head.column("n_pairs")[0].as_py()) if head.num_rows else 0
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = right.column("at").to_numpy()
    count[at] = right.column("count").to_numpy()
    best[at] = right.column("best").to_numpy()
    n_units = int(unit.max()) + 1 if len(unit) else 0
    # whole numbers throughout: sums beyond 2^53 stay exact
    sums = np.zeros((2, n_units), np.int64)
    np.add.at(sums[0], unit, best[pair])
    np.add.at(sums[1], unit, count[pair])
    lists = docs.column("units").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    code, times = (docs.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("units", "times"))
    before = np.concatenate([[0], np.cumsum(sizes)])
    out = [np.diff(np.concatenate([[0], np.cumsum(s[code] * times)])[before]) for s in sums]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([*(docs.column(c) for c in names), pa.array(out[0]), pa.array(out[1]), docs.column("groups_sha256"), docs.column("n_shared")],
                    names=[*names, "n_best", "count_sum", "groups_sha256", "n_shared"])


def default_paths() -> tuple[str, str]:
    return vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")


def alignment_counts(docs: DataFrame, paths: tuple[str, str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Align both tokenizers on every document (``doc_id``, ``text``).

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256 and n_shared (pairs of tokens in one group): one row per
    input row.  A link's count is how many links of all documents hold its id
    pair; ``n_best`` counts the links whose count is the highest of their B id.

    Texts are read and encoded once, in chunks of ``chunk_bytes``.  A chunk
    sends each of its distinct id pairs once to be summed, and gets each once
    back; its documents meet them as lists of unit numbers, so neither texts
    nor links move.  The pair table is never broadcast or collected.

    Null and empty texts, and texts whose bytes a tokenizer does not give
    back, have no tokens: zeros and an empty digest.  A text above
    ``chunk_bytes`` is a chunk with what came before it; repeated rows count
    and stay as often as they stand there, null doc_ids too; an empty table
    gives no rows; other columns are ignored."""
    docs = docs.select("doc_id", "text")
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    numbers = "n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string"
    table = stage(docs.mapInArrow(_aligned(paths or default_paths(), chunk_bytes),
                                  f"chunk long, doc_id {doc_type}, {numbers}, units array<int>, times array<int>, pairs array<long>, "
                                  "counts array<long>, link_unit array<int>, link_pair array<int>"), "aligned")
    held = table.select("chunk", F.posexplode_outer(F.arrays_zip("pairs", "counts")).alias("at", "x")) \
        .select("chunk", "at", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n")).where(F.col("pair").isNotNull())
    counts = stage(held.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    top = F.max("count").over(Window.partitionBy(b))
    known = counts.select("pair", "count", (F.col("count") == top).cast("long").alias("best"))
    back = held.join(known, "pair").select(F.col("chunk").alias("of"), "at", "count", "best")
    left = table.select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "units", "times",
                        "link_unit", "link_pair", F.size("pairs").alias("n_pairs"))
    return left.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(
        _summed, f"doc_id {doc_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
                 "groups_sha256 string, n_shared long")


def token_links(docs: DataFrame, kind: str = "overlap", paths: tuple[str, str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All links of every document, one row a link: doc_id, a_index and
    b_index (places of the tokens in their document), a_id, b_id and value
    (shared bytes for ``overlap``; 1 for ``group``, tokens of one group).

    Rows without tokens give no links; repeated rows give theirs each time; an
    empty table gives none; other columns are ignored."""
    if kind not in ("overlap", "group"):
        raise ValueError(f"unknown kind of link {kind!r}: use overlap or group")
    docs = docs.select("doc_id", "text")
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    paths = paths or default_paths()

    def run(batches):
        import pyarrow as pa
        tools = _tokenizers(paths)
        for t in text_chunks(batches, 1, chunk_bytes):
            codes, first, units = cut_units(t.column(1), lead=True)
            al = Alignment(units, *tools)
            doc = np.repeat(np.arange(t.num_rows), np.diff(first))
            lost = np.bincount(doc, ~al.valid[codes], minlength=t.num_rows) > 0
            ids = t.column(0).combine_chunks()
            # each unit occurrence with its document and the tokens before it there
            shift = []
            for ptr in (al.a_ptr, al.b_ptr):
                size = np.diff(ptr)[codes]
                run_ = np.cumsum(size) - size
                start = np.concatenate([run_, [size.sum()]])[first[:-1]]
                shift.append(run_ - start[doc] if len(doc) else run_)
            by_unit = np.argsort(codes, kind="stable")
            occ_ptr = np.searchsorted(codes[by_unit], np.arange(len(units) + 1))
            for i, j, value in (al.overlaps() if kind == "overlap" else al.group_links()):
                unit = al.a_unit[i]
                for s in range(0, len(i), 1 << 16):
                    e = s + (1 << 16)
                    place, times = gather(occ_ptr, unit[s:e])
                    occ = by_unit[place]
                    li, lj, lv = (np.repeat(x[s:e], times) for x in (i, j, value))
                    lu = np.repeat(unit[s:e], times)
                    ok = ~lost[doc[occ]]
                    occ, li, lj, lv, lu = occ[ok], li[ok], lj[ok], lv[ok], lu[ok]
                    for p in range(0, len(occ), 1 << 18):
                        q = slice(p, p + (1 << 18))
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(doc[occ[q]])), pa.array(shift[0][occ[q]] + li[q] - al.a_ptr[lu[q]]),
                             pa.array(shift[1][occ[q]] + lj[q] - al.b_ptr[lu[q]]), pa.array(al.a_ids[li[q]]), pa.array(al.b_ids[lj[q]]),
                             pa.array(lv[q])], ["doc_id", "a_index", "b_index", "a_id", "b_id", "value"])
    return docs.mapInArrow(run, f"doc_id {doc_type}, a_index long, b_index long, a_id long, b_id long, value long")
