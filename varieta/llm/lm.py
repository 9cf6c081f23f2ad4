"""Language-model scoring with a log-frequency Bloom filter."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, lower_words, stage, whole_groups

CHUNK_TOKENS = 200_000        # scored at a time
COUNT_TOKENS = 500_000        # combined before they move
SHARD_BYTES = 176_000_000
BITS_PER_ENTRY, PROBES = 8, 4
LEVEL_BASE = 1.2
SMOOTHING = 20.0
END = b"\n"  # no word holds white space
PART_BYTES = 32_000_000
TOP = 2**32 - 1               # word counts from here on stand in a list of their own
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(_mix(first) + second * _U(0x9E3779B97F4A7C15))


def part_of(word: np.ndarray, parts: int) -> np.ndarray:
    """Part of a word hash: equal ranges of its upper 32 bits, in order."""
    return ((word >> _U(32)) * _U(parts)) >> _U(32)


def _thresholds(base: float, top: int = 2**50) -> np.ndarray:
    """Least count of each level: one by one first, then by the factor ``base``."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * base)))
    return np.array(out)


THRESHOLDS = _thresholds(LEVEL_BASE)


def level_of(count: np.ndarray) -> np.ndarray:
    """Quantised count: the number of thresholds up to it."""
    return np.searchsorted(THRESHOLDS, count, side="right")


def level_count(level: np.ndarray) -> np.ndarray:
    """Count that a level stands for, never above the true one; level 0 is 0."""
    return np.where(level > 0, THRESHOLDS[np.minimum(np.maximum(level, 1), len(THRESHOLDS)) - 1], 0).astype(float)


def _salt(level: int) -> np.uint64:
    return _U(level * 0xD1B54A32D192ED03 % 2**64)


def _positions(x: np.ndarray, level: int, bits: np.ndarray) -> Iterator[np.ndarray]:
    """Bit positions of (n-gram, level), one probe after the other."""
    h = _mix(x + _salt(level))
    step = (h >> _U(32)) | _U(1)
    for i in range(PROBES):
        yield (h + _U(i) * step) % bits


def build_filter(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bit array (bytes) that holds (n-gram, j) for j = 1 .. level of its count."""
    level = level_of(count)
    n = max(64, int(level.sum()) * BITS_PER_ENTRY)
    n = -(-n // 8) * 8
    bits = np.zeros(n, dtype=bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        x, level = x[level >= j], level[level >= j]
        for at in range(0, len(x), 1 << 20):
            for p in _positions(x[at:at + (1 << 20)], j, _U(n)):
                bits[p] = True
    return np.packbits(bits, bitorder="little")


class _Ids(dict):
    """Word -> number in order of first use."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def chunk_tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as one token sequence, an end after each: numbers of the distinct
    words, hashes by number, tokens per text."""
    from xxhash import xxh64_intdigest
    ids = _Ids()
    get = ids.__getitem__
    end = get(END)
    out, sizes = [], np.empty(len(texts), np.int64)
    for k, t in enumerate(texts):
        words = lower_words(t)
        out.append(np.fromiter(map(get, words), np.int32, len(words)))
        out.append(np.array([end], np.int32))
        sizes[k] = len(words) + 1
    hashes = np.fromiter(map(xxh64_intdigest, ids), np.uint64, len(ids))
    return np.concatenate(out) if out else np.empty(0, np.int32), hashes, sizes


def _previous(seq: np.ndarray) -> np.ndarray:
    """Each token's predecessor; a text begins after an end (number 0)."""
    return np.concatenate([np.zeros(1, seq.dtype), seq[:-1]])


def held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def _counts(batches: Iterator, parts: int) -> Iterator:
    """Sorted distinct n-gram hashes and counts of about COUNT_TOKENS training
    tokens, cut in one row per part: counts are combined before they move."""
    import pyarrow as pa

    def flush(texts):
        seq, hashes, _ = chunk_tokens(texts)
        uni = np.bincount(seq, minlength=len(hashes))
        order = np.argsort(hashes)
        words, uni = hashes[order], uni[order]
        cur = hashes[seq]
        x = pair_hash(hashes[_previous(seq)], cur)
        # pairs ordered by the part of their word: the part stands in the upper bits
        at = part_of(cur, parts)
        cuts_w = np.searchsorted(part_of(words, parts), np.arange(parts + 1))
        order = np.argsort(at.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
        x, cuts = x[order], np.searchsorted(at[order], np.arange(parts + 1))
        rows = ([], [], [], [], [])
        for p in range(parts):
            w = slice(cuts_w[p], cuts_w[p + 1])
            pairs, n = np.unique(x[cuts[p]:cuts[p + 1]], return_counts=True)
            if w.start == w.stop:
                continue
            for out, v in zip(rows, (p, words[w].tobytes(), uni[w].astype(np.int64).tobytes(), pairs.tobytes(),
                                     n.astype(np.int32).tobytes())):
                out.append(v)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[1:])],
            ["part", "words", "word_n", "pairs", "pair_n"])

    texts, size = [], 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if held_out(doc_id):
                continue
            texts.append(text)
            size += len(text or "") // 6 + 1
            if size >= COUNT_TOKENS:
                yield flush(texts)
                texts, size = [], 0
    if texts:
        yield flush(texts)


def _sum_by_hash(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(x)
    x, n = x[order], n[order]
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
    return x[at], np.add.reduceat(n, at) if len(x) else n


def _model_parts(batches: Iterator) -> Iterator:
    """Parts summed up: exact word counts and the filter of the pair counts."""
    import pyarrow as pa
    for t in whole_groups(batches, ["part"], 1, None):
        part = t.column("part").to_numpy()
        for p in np.unique(part):
            g = t.filter(pa.array(part == p))

            def col(name, kind):
                return np.frombuffer(b"".join(g.column(name).to_pylist()), kind)
            words, n = _sum_by_hash(col("words", np.uint64), col("word_n", np.int64))
            pairs, m = _sum_by_hash(col("pairs", np.uint64), col("pair_n", np.int32).astype(np.int64))
            bits = build_filter(pairs, m)
            big = n >= TOP
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(p)]), pa.array([int(n.sum())]), pa.array([len(words)]), pa.array([12 * len(words) + 16 * int(big.sum()) + len(bits)]),
                 pa.array([words.tobytes()], pa.binary()), pa.array([np.minimum(n, TOP).astype(np.uint32).tobytes()], pa.binary()),
                 pa.array([words[big].tobytes()], pa.binary()), pa.array([n[big].tobytes()], pa.binary()),
                 pa.array([bits.tobytes()], pa.binary())],
                ["part", "tokens", "types", "bytes", "words", "word_n", "big_words", "big_n", "bits"])


def train(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The model's parts, staged: exact counts of the training words and one
    log-frequency Bloom filter of the word pairs per part (32 bits a count;
    counts that do not fit stand beside them in 64).  A part is a range
    of word hashes; their number follows the size of the texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(64, math.ceil(size / part_bytes))
    counts = docs.select("doc_id", "text").mapInArrow(
        lambda it: _counts(it, parts), "part long, words binary, word_n binary, pairs binary, pair_n binary")
    model = counts.repartition("part").sortWithinPartitions("part").mapInArrow(
        _model_parts, "part long, tokens long, types long, bytes long, words binary, word_n binary, big_words binary, big_n binary, bits binary")
    return stage(model, "model").withColumn("parts", F.lit(parts))


class Shard:
    """Neighbouring parts of the model as arrays, for broadcasting."""

    def __init__(self, rows: list, parts: int, tokens: int, types: int):
        self.parts, self.tokens, self.types = parts, tokens, types
        self.first, self.last = rows[0]["part"], rows[-1]["part"]
        self.words = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows])
        self.word_n = np.concatenate([np.frombuffer(r["word_n"], np.uint32) for r in rows])
        self.big_words = np.concatenate([np.frombuffer(r.get("big_words", b""), np.uint64) for r in rows])
        self.big_n = np.concatenate([np.frombuffer(r.get("big_n", b""), np.int64) for r in rows])
        sizes = np.zeros(self.last - self.first + 1, np.uint64)
        for r in rows:
            sizes[r["part"] - self.first] = len(r["bits"])
        self.size = sizes * _U(8)
        self.offset = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.size)[:-1]])
        self.bits = np.concatenate([np.frombuffer(r["bits"], np.uint8) for r in rows])

    def owns(self, word: np.ndarray) -> np.ndarray:
        p = part_of(word, self.parts)
        return (p >= _U(self.first)) & (p <= _U(self.last))

    def count(self, word: np.ndarray) -> np.ndarray:
        """Exact training counts of word hashes."""
        at = np.minimum(np.searchsorted(self.words, word), max(0, len(self.words) - 1))
        if not len(self.words):
            return np.zeros(len(word), np.int64)
        n = np.where(self.words[at] == word, self.word_n[at], 0).astype(np.int64)
        if len(self.big_words):
            at = np.minimum(np.searchsorted(self.big_words, word), len(self.big_words) - 1)
            n = np.where(self.big_words[at] == word, self.big_n[at], n)
        return n

    def level(self, x: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Quantised pair counts: probe levels 1, 2, ... until one is missing."""
        out = np.zeros(len(x), np.int64)
        part = (part_of(word, self.parts) - _U(self.first)).astype(np.int64)
        size, offset = self.size[part], self.offset[part]
        left = np.flatnonzero(size > 0)
        j = 0
        while len(left):
            j += 1
            h = _mix(x[left] + _salt(j))
            step = (h >> _U(32)) | _U(1)
            for i in range(PROBES):
                p = (h + _U(i) * step) % size[left] + offset[left]
                ok = (self.bits[p >> _U(3)] >> (p & _U(7)).astype(np.uint8)) & 1 == 1
                left, h, step = left[ok], h[ok], step[ok]
            out[left] = j
        return out


def score_chunk(shard: Shard, texts: list, smoothing: float) -> tuple[np.ndarray, ...]:
    """Per text: tokens, known tokens, base score and model score, as far as
    this shard's words go.

    The model is a bigram model smoothed towards the base distribution,
    p(w | v) = (c(v,w) + m p(w)) / (c(v) + m).  Its logarithm is a sum of a
    term of w's shard and a term of v's shard, so shards add up."""
    seq, hashes, sizes = chunk_tokens(texts)
    own = shard.owns(hashes)
    c = np.zeros(len(hashes), np.int64)
    c[own] = shard.count(hashes[own])
    p = (c + 0.1) / (shard.tokens + 0.1 * (shard.types + 1))
    base = np.where(own, np.log10(p), 0.0)
    below = np.where(own, np.log10(c + smoothing), 0.0)
    prev = _previous(seq)
    at = np.flatnonzero(own[seq])
    cur = hashes[seq[at]]
    level = shard.level(pair_hash(hashes[prev[at]], cur), cur)
    top = np.zeros(len(seq))
    top[at] = np.log10(level_count(level) + smoothing * p[seq[at]])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return (sizes, np.add.reduceat((c > 0)[seq].astype(np.int64), starts), np.add.reduceat(base[seq], starts),
            np.add.reduceat(top - below[prev], starts))


def _score(shard, smoothing: float, doc_type: str):
    def run(batches):
        import pyarrow as pa
        for b in batches:
            texts = b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and size < CHUNK_TOKENS:
                    size += len(texts[to] or "") // 6 + 1
                    to += 1
                n, known, base, score = score_chunk(shard.value, texts[at:to], smoothing)
                ids = b.column(0).slice(at, to - at)
                cols = [ids, pa.array([held_out(i) for i in ids.to_pylist()]), pa.array(n), pa.array(known),
                        pa.array([shard.value.tokens] * (to - at), pa.int64()), pa.array(base), pa.array(score)]
                names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                if b.num_columns > 2:
                    cols.append(b.column(2).slice(at, to - at))
                    names.append("_text")
                yield pa.RecordBatch.from_arrays(cols, names)
                at = to
    return run


def lm_scores(docs: DataFrame, smoothing: float = SMOOTHING, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Train on the documents that are not held out, score all documents.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score: one row per input row.  The model is broadcast in shards of at most
    ``shard_bytes``; each shard takes one pass over the texts and the passes
    are added up.  A model that fits one shard needs no shuffle to score.

    Null and empty texts are the end token alone; a null doc_id is held out;
    repeated rows train and are scored as often as they stand there; an empty
    table gives no rows; without training tokens every count is 0; other
    columns are ignored."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    model = train(docs)
    parts = model.select("part", "bytes", "tokens", "types", "parts").orderBy("part").collect()  # one row per part
    tokens, types = sum(r.tokens for r in parts), sum(r.types for r in parts)
    groups, size = [[]], 0
    for r in parts:
        if groups[-1] and size + r.bytes > shard_bytes:
            groups.append([])
            size = 0
        groups[-1].append(r.part)
        size += r.bytes
    n_parts = parts[0].parts if parts else 1
    # the ranges of the groups cover all parts, those without training words too
    bounds = [0, *(g[0] for g in groups[1:]), n_parts]
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    many = len(groups) > 1
    if many:
        docs = docs.withColumn("_text", F.xxhash64("text"))
    passes = None
    for k in range(len(groups)):
        rows = [r.asDict() for r in model.where(F.col("part").between(bounds[k], bounds[k + 1] - 1))
                .select("part", "words", "word_n", "big_words", "big_n", "bits").toLocalIterator()]
        empty = {"words": b"", "word_n": b"", "bits": b""}
        rows = sorted([*rows, *({"part": p, **empty} for p in {bounds[k], bounds[k + 1] - 1} - {r["part"] for r in rows})],
                      key=lambda r: r["part"])
        shard = Shared(spark, Shard(rows, n_parts, tokens, types))
        del rows
        out = docs.mapInArrow(_score(shard, smoothing, doc_type), schema + (", _text long" if many else ""))
        out = stage(out, "scores") if many else out
        passes = out if passes is None else passes.unionByName(out)
    if not many:
        return passes
    n = len(groups)
    copies = F.col("_rows") / n
    total = passes.groupBy("doc_id", "_text", "held_out", "n_tokens", "train_tokens") \
        .agg(F.count("*").alias("_rows"), *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")])
    return total.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))) \
        .select("doc_id", "held_out", "n_tokens", (F.col("n_known") / copies).cast("long").alias("n_known"), "train_tokens",
                (F.col("base_score") / copies).alias("base_score"), (F.col("score") / copies).alias("score"))
