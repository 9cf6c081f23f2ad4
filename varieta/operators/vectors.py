"""Word and document vectors trained in Spark.

Vocabularies are bounded by a parameter (``max_words``), so tables of one row
or one vector a word are small whatever the corpus is; those are broadcast.
Everything that grows with the corpus (texts, word pairs) stays distributed.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

TOKEN = r"[^\p{L}\p{N}_]+"
MAX_WORDS = 50_000
# Skip-gram training: words a block of word pairs, and blocks asked for at most.
PART_WORDS, MAX_PARTS = 1_000_000, 96
# Word pairs of a block at most, were they dealt evenly.
BLOCK_PAIRS = 4_000_000
# Scores of one tile of a block of words against all others: they fit a cache.
TILE = 1 << 17


def words_of(text_col: str = "text"):
    """Lower-cased words of a text; null has none."""
    parts = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), TOKEN)
    return F.filter(parts, lambda t: t != "")


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of every word.  A batch of texts sends each word once."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            found = batch.column(0).flatten().value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])
    return docs.select(words_of(text_col).alias("_w")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _ranked(counts: DataFrame, min_count: int, max_words: int) -> DataFrame:
    top = counts.where(F.col("n") >= min_count).orderBy(F.desc("n"), "word").limit(max_words) \
        .select(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "word"))).alias("_w"))
    # at most ``max_words`` short rows in one array
    return top.select(F.posexplode("_w").alias("id", "x")).select("x.word", (-F.col("x.less")).alias("n"), "id")


def vocabulary(docs: DataFrame, text_col: str = "text", min_count: int = 2, max_words: int = MAX_WORDS) -> DataFrame:
    """(word, n, id): the at most ``max_words`` commonest words that stand at
    least ``min_count`` times (ties by the word), numbered by rank."""
    return _ranked(word_counts(docs, text_col), min_count, max_words)


# -- texts as word numbers ----------------------------------------------------------
def _known(column, table: dict) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of a column of word lists, one after the other without the
    words outside ``table``, and how many each list has."""
    words = column.flatten().dictionary_encode()
    number = np.array([table.get(w, -1) for w in words.dictionary.to_pylist()], np.int32)
    ids = number[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
    there = ids >= 0
    return ids[there], np.bincount(owner[there], minlength=len(column))


def _list_array(values, lengths: np.ndarray):
    import pyarrow as pa
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), values)


def _kept_schema(kept: DataFrame, out: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [out])


def word_ids(docs: DataFrame, words: Sequence[str], keep: Sequence[str] = (), text_col: str = "text", out: str = "_ids") -> DataFrame:
    """``keep`` columns and the places of a text's words in ``words`` as
    ARRAY<INT>; other words are left out.  ``words`` is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(words)})
    kept = docs.select(*keep, words_of(text_col).alias("_words"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            ids, lengths = _known(batch.column(batch.num_columns - 1), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _list_array(pa.array(ids), lengths)], [*batch.schema.names[:-1], out])
    return kept.mapInArrow(run, _kept_schema(kept, f"`{out}` array<int>"))


# -- word pairs ------------------------------------------------------------------
def _pairs_of(ids: np.ndarray, doc: np.ndarray, window: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unordered pairs (low, high) of word numbers below ``base`` at most
    ``window`` places apart in one document, with the sums of 1 / distance and
    of the share of windows of 1 to ``window`` places that reach so far."""
    keys = [np.zeros(0, np.int64)]
    for d in range(1, window + 1):
        same = doc[:-d] == doc[d:]
        a, b = ids[:-d][same], ids[d:][same]
        keys.append((np.minimum(a, b) * base + np.maximum(a, b)) * window + (d - 1))
    key = np.sort(np.concatenate(keys))
    at = np.flatnonzero(np.diff(key, prepend=-1))
    key, n = key[at], np.diff(at, append=len(key))
    pair, d = key // window, key % window + 1
    at = np.flatnonzero(np.diff(pair, prepend=-1))
    pair = pair[at]
    x, y = (np.add.reduceat(n * w, at) if len(at) else np.zeros(0) for w in (1.0 / d, (window + 1 - d) / window))
    return pair // base, pair % base, x, y


def word_pairs(docs: DataFrame, n_words: int, ids_col: str = "_ids", window: int = 5, chunk_words: int = 500_000) -> DataFrame:
    """(a, b, x, y) of both orders of each pair of word numbers at most
    ``window`` places apart: x sums 1 / distance, y is how often skip-gram
    windows of an even random width would pair them.  Pairs are combined per
    chunk, in one order, before they move; no table of words times words exists."""
    def run(batches):
        import pyarrow as pa

        def combined(found, lengths):
            ids, n = np.concatenate(found).astype(np.int64), np.concatenate(lengths)
            return pa.RecordBatch.from_arrays([pa.array(v) for v in _pairs_of(ids, np.repeat(np.arange(len(n)), n), window, n_words)],
                                              ["a", "b", "x", "y"])
        found, lengths, size = [], [], 0
        for batch in batches:
            column = batch.column(0)
            flat, n = column.flatten().to_numpy(), column.value_lengths().to_numpy()
            ends = np.cumsum(n)
            at, start = 0, 0
            while at < len(n):   # a text is never cut
                to = min(len(n), int(np.searchsorted(ends, start + chunk_words - size)) + 1)
                stop = int(ends[to - 1])
                found.append(flat[start:stop])
                lengths.append(n[at:to])
                size += stop - start
                at, start = to, stop
                if size >= chunk_words:
                    yield combined(found, lengths)
                    found, lengths, size = [], [], 0
        if size:
            yield combined(found, lengths)
    one = docs.select(F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("_i")).mapInArrow(run, "a long, b long, x double, y double") \
        .groupBy("a", "b").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    twice = F.when(F.col("a") == F.col("b"), 2.0).otherwise(1.0)
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return one.select(F.explode_outer(ways).alias("_p"), (F.col("x") * twice).alias("x"), (F.col("y") * twice).alias("y")).select("_p.a", "_p.b", "x", "y")


def cooccurrence(docs: DataFrame, vocab: DataFrame, text_col: str = "text", window: int = 5, chunk_words: int = 500_000) -> DataFrame:
    """(a, b, x): weighted counts of vocabulary words that stand at most
    ``window`` places apart, nearer pairs weighing more.  Words outside the
    vocabulary are left out before places are counted."""
    named = {r.id: r.word for r in vocab.select("word", "id").toLocalIterator()}
    words = [named.get(k) for k in range(max(named, default=-1) + 1)]
    return word_pairs(word_ids(docs, words, (), text_col), len(words), window=window, chunk_words=chunk_words).select("a", "b", "x")


def _packed(table):
    """A block's pairs by their first word, as one row of four arrays."""
    import pyarrow as pa
    a, b, x, y = (table.column(c).to_numpy() for c in ("a", "b", "x", "y"))
    order = np.argsort(a, kind="stable")
    values = (a[order].astype(np.int32), b[order].astype(np.int32), x[order], y[order])
    return pa.table([_list_array(pa.array(v), np.array([len(a)])) for v in values], names=["a", "b", "x", "y"])


class Corpus:
    """The ``words`` of a set of texts by rank, how often each stands
    (``counts``) and all words do (``seen``), and the texts as word numbers in
    ``ids_col`` of ``docs``.  Both kinds of vectors learn from it."""

    def __init__(self, words: list[str], counts: np.ndarray, seen: int):
        self.words, self.counts, self.seen = words, counts, seen
        self._pairs: dict[int, DataFrame] = {}

    def over(self, docs: DataFrame, ids_col: str = "_ids") -> Corpus:
        self.docs, self.ids_col = docs, ids_col
        return self

    def pairs(self, window: int, blocks: int | None = None) -> DataFrame:
        """All pairs of a word in one block, a row of arrays each; written
        once, in ``blocks`` or as many as ``BLOCK_PAIRS`` asks for.  A word has
        at most as many pairs as there are words."""
        if window not in self._pairs:
            n = len(self.words)
            most = min(n * n, 2 * window * int(self.counts.sum()))
            blocks = max(blocks or int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // BLOCK_PAIRS))
            pairs = word_pairs(self.docs, n, self.ids_col, window).withColumn("_block", F.col("a") % blocks)
            self._pairs[window] = cut_lineage(pairs.groupBy("_block").applyInArrow(_packed, "a array<int>, b array<int>, x array<double>, y array<double>"))
        return self._pairs[window]


def read_words(docs: DataFrame, text_col: str = "text", min_count: int = 2, max_words: int = MAX_WORDS) -> Corpus:
    """A corpus with the words of ``vocabulary``, its texts still to be given
    (``over``).  Texts are read once."""
    counts = cut_lineage(word_counts(docs, text_col))
    top = _ranked(counts, min_count, max_words).orderBy("id").toArrow()   # at most max_words
    seen = counts.agg(F.sum("n")).first()[0]
    return Corpus(top.column("word").to_pylist(), top.column("n").to_numpy(), int(seen or 0))


def _corpus(docs: DataFrame, text_col: str, min_count: int, max_words: int) -> Corpus:
    corpus = read_words(docs, text_col, min_count, max_words)
    return corpus.over(word_ids(docs, corpus.words, (), text_col))


class GloveModel:
    """Word vectors and biases; ``losses`` has the objective before the first
    and after each round."""

    def __init__(self, words: list[str], vectors: np.ndarray, losses: list[float]):
        self.words, self.vectors, self.losses = words, vectors, losses


def _half_round(pairs: DataFrame, solve, weight: str, n: int, width: int) -> tuple[np.ndarray, float]:
    """Row k of the result is what ``solve`` (words, starts, ends, other words,
    weights) -> (rows, loss) gives for word k, zeros without pairs; and the
    sum of the losses.  One job; every block is solved where it lies."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, w = (batch.column(c).slice(k, 1).flatten().to_numpy() for c in range(3))
                cut = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))
                word = a[cut[:-1]]
                rows, loss = solve(word, cut[:-1], cut[1:], b, w)
                yield pa.RecordBatch.from_arrays([_list_array(pa.array(word), np.array([len(word)])),
                                                  _list_array(pa.array(rows.ravel()), np.array([rows.size])), pa.array([float(loss)])], ["a", "v", "loss"])
    found = pairs.select("a", "b", weight).mapInArrow(run, "a array<int>, v array<double>, loss double").toArrow()   # one vector a word
    out = np.zeros((n, width))
    for a, v in zip(found.column("a").chunks, found.column("v").chunks):
        out[a.flatten().to_numpy()] = v.flatten().to_numpy().reshape(-1, width)
    return out, float(np.sum(found.column("loss").to_numpy()))


# -- weighted factorisation of co-occurrence --------------------------------------
def _fit_counts(side, dim: int, ridge: float, x_max: float, power: float):
    """For each word of a block: the vector and bias that fit its log counts
    best (weighted least squares with a ridge) given the other side's."""
    def solve(word, starts, ends, b, x):
        other, bias = side.value
        weight, logs = np.minimum(x / x_max, 1.0) ** power, np.log(x)
        out, loss = np.empty((len(word), dim + 1)), 0.0
        for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
            at, f = b[s:e], weight[s:e]
            m = np.empty((e - s, dim + 1))
            m[:, :dim], m[:, dim] = other[at], 1.0
            y, mf = logs[s:e] - bias[at], m * f[:, None]
            out[k] = w = np.linalg.solve(mf.T @ m + ridge * np.eye(dim + 1), mf.T @ y)
            loss += float(f @ (m @ w - y) ** 2) + ridge * float(w @ w)
        return out, loss
    return solve


def train_glove(docs: DataFrame, text_col: str = "text", dim: int = 32, window: int = 5, rounds: int = 5, min_count: int = 2,
                max_words: int = MAX_WORDS, x_max: float = 100.0, power: float = 0.75, ridge: float = 0.1, seed: int = 7,
                blocks: int | None = None, corpus: Corpus | None = None) -> GloveModel:
    """Weighted factorisation of log co-occurrence counts, sum f(x_ab)
    (u_a v_b + p_a + q_b - log x_ab)^2 plus a ridge, by alternating exact
    least squares: with one side fixed each word's vector is a small system of
    its own, so a half round is one job over the pair table, which is dealt by
    word and packed once, and the objective never rises.  Only the factors
    (``max_words`` x ``dim``) reach the driver and are broadcast.

    A word's vector is the sum of both sides' vectors.  Texts without
    vocabulary words add nothing; an empty table gives a model without words.
    A ``corpus`` that was read before is used instead of ``docs``."""
    spark = docs.sparkSession
    corpus = corpus or _corpus(docs, text_col, min_count, max_words)
    n = len(corpus.words)
    if not n:
        return GloveModel([], np.zeros((0, dim)), [])
    pairs = corpus.pairs(window, blocks)
    rng = np.random.default_rng(seed)
    sides = [(rng.normal(0, 0.1, (n, dim)), np.zeros(n)) for _ in range(2)]

    def objective_of_fixed(v):
        return ridge * float((v[0] ** 2).sum() + (v[1] ** 2).sum())
    losses = []
    for k in range(2 * rounds):
        fixed = sides[1 - k % 2]
        given = spark.sparkContext.broadcast(fixed)
        found, loss = _half_round(pairs, _fit_counts(given, dim, ridge, x_max, power), "x", n, dim + 1)
        sides[k % 2] = (found[:, :dim], found[:, dim])
        losses.append(loss + objective_of_fixed(fixed))
        given.unpersist()
    return GloveModel(corpus.words, sides[0][0] + sides[1][0], losses)


# -- skip-gram ---------------------------------------------------------------------
def _fit_windows(given, dim: int, ridge: float):
    """For each word of a block: one step up the skip-gram objective from its
    vector, given the other side's.  A pair's likelihood is bounded from below
    by a parabola of curvature 1/4 that touches it, so the step is a small
    linear system and the objective never falls.  Every other word is a
    negative with its expected count: row scale times the other's weight."""
    def solve(word, starts, ends, b, y):
        mine, other, scale, weighed, spread = given.value
        u, r = mine[word], scale[word]
        # the logistic function s is (1 + tanh(x / 2)) / 2; negatives are summed in single precision, tile by tile
        half, small = (0.5 * u).astype(np.float32), other.astype(np.float32)
        drawn = np.zeros((len(word), dim))
        drawn += weighed.sum(axis=0, dtype=float)
        for i in range(0, len(word), 128):
            for j in range(0, len(small), TILE // 128):
                t = half[i:i + 128] @ small[j:j + TILE // 128].T
                drawn[i:i + 128] += np.tanh(t, out=t) @ weighed[j:j + TILE // 128]
        drawn *= 0.5
        out, eye = np.empty((len(word), dim)), ridge * np.eye(dim)
        for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
            m, n = other[b[s:e]], y[s:e]
            up = m.T @ (n * (0.5 - 0.5 * np.tanh(m @ (0.5 * u[k])))) - r[k] * drawn[k] - ridge * u[k]
            out[k] = u[k] + np.linalg.solve(0.25 * ((m * n[:, None]).T @ m + r[k] * spread) + eye, up)
        return out, 0.0
    return solve


def _count_windows(word, starts, ends, b, y):
    return np.add.reduceat(y, starts)[:, None], 0.0


class Word2Vec:
    """Skip-gram with negative sampling (parameters named as Spark ML's) over
    counted pairs: sum over pairs y_ab log s(u_a v_b) + ``negative`` y_a p_b
    log s(-u_a v_b), p by counts to the power 3/4, and a ridge.  Pairs and
    negatives stand with their expected counts for all places of all texts, so
    nothing is drawn and the vectors do not depend on how the texts lie.

    ``maxIter`` rounds over both sides; a half round is one job over the pair
    table, dealt by word in ``numPartitions`` blocks at least.  Its work is
    that of the different pairs, and of all words with all words."""

    def __init__(self, vectorSize: int = 32, windowSize: int = 5, maxIter: int = 3, seed: int = 7, numPartitions: int = 1,
                 negative: float = 5.0, ridge: float = 0.1):
        self.dim, self.window, self.rounds, self.seed = vectorSize, windowSize, maxIter, seed
        self.blocks, self.negative, self.ridge = numPartitions, negative, ridge

    def fit(self, corpus: Corpus) -> GloveModel:
        spark, n, dim = corpus.docs.sparkSession, len(corpus.words), self.dim
        pairs = corpus.pairs(self.window, self.blocks)
        y = _half_round(pairs, _count_windows, "y", n, 1)[0][:, 0]
        noise = y ** 0.75 / max((y ** 0.75).sum(), 1e-300)
        rng = np.random.default_rng(self.seed)
        words, contexts = rng.normal(0, dim ** -0.5, (n, dim)), np.zeros((n, dim))
        for _ in range(self.rounds):
            contexts = self._step(spark, pairs, contexts, words, self.negative * noise, y)
            words = self._step(spark, pairs, words, contexts, self.negative * y, noise)
        return GloveModel(corpus.words, words, [])

    def _step(self, spark, pairs, mine, other, scale, weight):
        weighed = other * weight[:, None]
        given = spark.sparkContext.broadcast((mine, other, scale, weighed.astype(np.float32), weighed.T @ other))
        out, _ = _half_round(pairs, _fit_windows(given, self.dim, self.ridge), "y", len(mine), self.dim)
        given.unpersist()
        return out


def train_word2vec(docs: DataFrame, text_col: str = "text", dim: int = 32, window: int = 5, min_count: int = 2,
                   max_words: int = MAX_WORDS, rounds: int = 3, seed: int = 7, partitions: int | None = None,
                   corpus: Corpus | None = None) -> GloveModel:
    """Skip-gram vectors of the words of ``vocabulary``.  ``partitions`` is
    the number of blocks the word pairs are dealt to at least; by default one
    for every ``PART_WORDS`` words, at most ``MAX_PARTS``.  Texts without such
    words add nothing; without any the model has no words.  A ``corpus`` that
    was read before is used instead of ``docs``."""
    corpus = corpus or _corpus(docs, text_col, min_count, max_words)
    if not corpus.words:
        return GloveModel([], np.zeros((0, dim)), [])
    partitions = partitions or min(MAX_PARTS, -(-corpus.seen // PART_WORDS))
    return Word2Vec(vectorSize=dim, windowSize=window, maxIter=rounds, seed=seed, numPartitions=partitions).fit(corpus)


def nearest_words(model: GloveModel, word: str, k: int = 10) -> list[tuple[str, float]]:
    """The ``k`` words of the model with the largest cosine to ``word``."""
    v = model.vectors / np.maximum(np.linalg.norm(model.vectors, axis=1, keepdims=True), 1e-12)
    me = model.words.index(word)
    score = v @ v[me]
    return [(model.words[i], float(score[i])) for i in np.argsort(-score) if i != me][:k]


# -- documents ---------------------------------------------------------------------
def _slabs(lengths: np.ndarray, size: int = 1 << 16):
    """(first list, list after the last, first value, value after the last) of
    runs of whole lists with about ``size`` values."""
    ends, at, start = np.cumsum(lengths), 0, 0
    while at < len(lengths):
        to = min(len(lengths), int(np.searchsorted(ends, start + size)) + 1)
        yield at, to, start, int(ends[to - 1])
        at, start = to, int(ends[to - 1])


def _sums(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of ``lengths`` rows; zeros for an empty run."""
    out, some = np.zeros((len(lengths), rows.shape[1])), lengths > 0
    if some.any():
        out[some] = np.add.reduceat(rows, (np.cumsum(lengths) - lengths)[some], axis=0)
    return out


def _unit_rows(rows: np.ndarray):
    import pyarrow as pa
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))


def document_vectors(docs: DataFrame, model: GloveModel, keep: Sequence[str], text_col: str = "text", out: str = "embedding",
                     ids_col: str | None = None) -> DataFrame:
    """Mean of a document's word vectors, scaled to length 1 (all zeros where
    no word is known): ``keep`` columns and ``out`` as ARRAY<DOUBLE>.  The
    bounded model is broadcast; rows stay where they are.  ``ids_col``: places
    of the texts' words in the model's (``word_ids``), read instead of texts."""
    spark = docs.sparkSession
    table = {} if ids_col else dict(zip(model.words, range(len(model.words))))
    shared = spark.sparkContext.broadcast((table, model.vectors))
    width = model.vectors.shape[1]
    kept = docs.select(*keep, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("_i") if ids_col else words_of(text_col).alias("_words"))

    def run(batches):
        import pyarrow as pa
        table, vectors = shared.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            ids, lengths = (column.flatten().to_numpy(), column.value_lengths().to_numpy()) if ids_col else _known(column, table)
            rows = np.zeros((batch.num_rows, width))
            for i, j, s, e in _slabs(lengths):
                rows[i:j] = _sums(vectors[ids[s:e]], lengths[i:j]) / np.maximum(lengths[i:j], 1)[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _unit_rows(rows)], [*batch.schema.names[:-1], out])
    return kept.mapInArrow(run, _kept_schema(kept, f"`{out}` array<double>"))


def projected_vectors(docs: DataFrame, keep: Sequence[str], text_col: str = "text", dim: int = 64, buckets: int = 1 << 14,
                      seed: int = 7, out: str = "embedding", idf: np.ndarray | None = None) -> DataFrame:
    """Hashed word counts (weighted by ``idf`` if given) reduced to
    ``dim`` dense features by a seeded random projection, scaled to length 1:
    inner products of the sparse vectors are kept in expectation."""
    kept = docs.select(*keep, F.transform(words_of(text_col), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")).alias("_h"))

    def run(batches):
        import pyarrow as pa
        basis = np.random.default_rng(seed).normal(0, dim ** -0.5, (buckets, dim))
        if idf is not None:
            basis *= idf[:, None]
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            hashes, lengths = column.flatten().to_numpy(), column.value_lengths().to_numpy()
            rows = np.zeros((batch.num_rows, dim))
            for i, j, s, e in _slabs(lengths):
                rows[i:j] = _sums(basis[hashes[s:e]], lengths[i:j])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _unit_rows(rows)], [*batch.schema.names[:-1], out])
    return kept.mapInArrow(run, _kept_schema(kept, f"`{out}` array<double>"))


def hashed_idf(docs: DataFrame, text_col: str = "text", buckets: int = 1 << 14) -> np.ndarray:
    """log((n + 1) / (df + 1)) of every hash bucket (``buckets`` numbers)."""
    h = F.array_distinct(F.transform(words_of(text_col), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))
    df = docs.select(F.explode(h).alias("h")).groupBy("h").count().collect()   # at most ``buckets`` rows
    n = docs.count()
    seen = np.zeros(buckets)
    for r in df:
        seen[r.h] = r["count"]
    return np.log((n + 1) / (seen + 1))
