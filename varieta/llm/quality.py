"""Quality classifier: weak labels by expectation-maximisation, hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, lowest_hashes, stage

DIMS = 1 << 18
SAMPLE_ROWS = 6_000
LABELLERS = ("marks", "capitals", "signs", "repeats", "plain", "fresh", "variety")
_CLOSERS = b".,;:?!"
_KINDS = 32
_STATS = np.arange(2 * _KINDS + 1)


def word_shape(word: bytes) -> int:
    """Shape of a raw word: letter case (none, lower, title, upper, mixed) and
    ending (letter, one closing mark, repeated marks, other sign)."""
    text = word.decode("utf-8", "replace")
    core = text.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    tail = len(text) - len(core)
    letters = [c for c in core if c.isalpha()]
    if not letters or len(letters) < len(core):
        case = 4 if core else 0
    elif core.islower() or not any(c.isupper() for c in letters):
        case = 1
    elif core.isupper() and len(core) > 1:
        case = 3
    else:
        case = 2 if core[0].isupper() else 4
    end = 0 if not tail else 1 if tail == 1 and text[-1].encode() in _CLOSERS else 2 if tail >= 2 else 3
    return case * 4 + end


class WordTable(dict):
    """Raw word -> hashed column * 32 + shape; emptied when it grows large."""

    def __missing__(self, word):
        from xxhash import xxh64_intdigest
        if len(self) > 200_000:
            self.clear()
        self[word] = v = (xxh64_intdigest(word.lower(), 1) % (DIMS - 4 * _KINDS) + 4 * _KINDS) << 5 | word_shape(word)
        return v


def describe(words: list[bytes], table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Hashed columns per word, and the statistics of the text: the share of
    each word shape, of adjacent equal words and of distinct words, log size."""
    n = len(words)
    stats = np.zeros(_KINDS)
    if not n:
        return np.empty(0, np.int64), stats
    codes = np.fromiter(map(table.__getitem__, words), np.int64, n)
    columns = codes >> 5
    stats[:20] = np.bincount(codes & 31, minlength=20) / n
    stats[20] = np.count_nonzero(columns[1:] == columns[:-1]) / n
    # distinct words within stretches of 200, as a share of all words
    spots = np.sort(np.arange(n) // 200 * DIMS + columns)
    stats[21] = (1 + np.count_nonzero(spots[1:] != spots[:-1])) / n
    stats[22] = min(1.0, np.log1p(n) / 10)
    return columns, stats


def votes(stats: np.ndarray, n: int) -> list[int]:
    """One vote per labeller: 1 clean, 2 junk, 0 no opinion.

    The first four know one kind of junk each; ``plain`` (words in ordinary
    case and ending) overlaps with three of them, ``fresh`` (plain words that
    differ from the word before) with all, ``variety`` with repeats."""
    if not n:
        return [0, 0, 0, 0, 2, 2, 0]

    def above(share, junk):
        return 2 if share >= junk else 0

    def between(share, junk, clean):
        return 2 if share <= junk else 1 if share >= clean else 0
    marks = stats[[2, 6, 10, 14, 18]].sum()          # words with repeated marks at the end
    capitals = stats[12:16].sum()
    signs = stats[0:4].sum()                         # no letter or digit
    plain = stats[[4, 5, 8, 9, 16, 17, 19]].sum()    # lower, title or mixed (digits), at most one mark
    return [above(marks, 0.2), above(capitals, 0.3), above(signs, 0.2), above(stats[20], 0.2),
            between(plain, 0.6, 0.85), between(plain - stats[20], 0.55, 0.8), above(1 - stats[21], 0.65) if n >= 30 else 0]


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of votes, each with
    its number of documents): the share of clean documents and, per class,
    labeller and vote, its probability.  Starts from the vote majority; some
    votes in advance (2 % of the documents) say that a labeller errs less
    often than not, which fixes which class is which."""
    k = patterns.shape[1] if patterns.size else len(LABELLERS)
    table = np.full((2, k, 3), 1 / 3)
    if not counts.sum():
        return 0.5, table
    clean = ((patterns == 1).sum(1) + 1.0) / ((patterns > 0).sum(1) + 2.0)
    post = np.where((patterns == 2).sum(1) > (patterns == 1).sum(1), np.minimum(clean, 0.3), np.maximum(clean, 0.7))
    prior, advance = 0.5, 0.02 * counts.sum() + 1
    for _ in range(rounds):
        for c, w in ((1, post * counts), (0, (1 - post) * counts)):
            for j in range(k):
                right = np.array([0.5, 0.4, 0.1] if c else [0.5, 0.1, 0.4])
                table[c, j] = (np.bincount(patterns[:, j], w, 3) + advance * right) / (w.sum() + advance)
        prior = float((post @ counts + 1) / (counts.sum() + 2))
        new = posterior(patterns, prior, table)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return prior, table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """Probability of the clean class for each vote pattern."""
    j = np.arange(patterns.shape[1])
    a = np.log(prior) + np.log(table[1][j, patterns]).sum(1)
    b = np.log1p(-prior) + np.log(table[0][j, patterns]).sum(1)
    return 1 / (1 + np.exp(np.clip(b - a, -500, 500)))


def sparse_row(columns: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed columns and values: unit-length word presence, scaled statistics
    and their squares."""
    u = np.sort(columns)
    u = u[np.flatnonzero(np.diff(u, prepend=-1))]
    return (np.concatenate([u, _STATS]),
            np.concatenate([np.full(len(u), 1 / np.sqrt(max(1, len(u)))), 3 * stats, 3 * stats * stats, [1.0]]))


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 120, step: float = 0.5,
               ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels; adaptive full-gradient steps."""
    w = np.zeros(DIMS)
    if not rows:
        return w
    columns = np.concatenate([r[0] for r in rows])
    values = np.concatenate([r[1] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    # both classes weigh the same
    weight = np.where(target > 0.5, 0.5 / max(1, (target > 0.5).sum()), 0.5 / max(1, (target <= 0.5).sum()))
    used, columns = np.unique(columns, return_inverse=True)
    v, seen = np.zeros(len(used)), np.full(len(used), 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, v[columns] * values, len(rows)), -30, 30)))
        g = np.bincount(columns, values * ((p - target) * weight)[doc], len(used)) + ridge * v
        seen += g * g
        v -= step * g / np.sqrt(seen)
    w[used] = v
    return w


def _vote_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa
    table = WordTable()
    for b in batches:
        out = []
        for t in b.column(1):
            words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
            out.append(int("".join(map(str, votes(describe(words, table)[1], len(words)))), 3))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int32())], ["doc_id", "pattern"])


def _digits(pattern: np.ndarray) -> np.ndarray:
    k = len(LABELLERS)
    return pattern[:, None] // 3 ** np.arange(k - 1, -1, -1) % 3


class QualityModel:
    def __init__(self, prior: float, table: np.ndarray, weights: np.ndarray):
        self.prior, self.table, self.weights = prior, table, weights

    def score(self, texts: list, table: WordTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: scorer's probability of clean, label model's posterior, votes."""
        z, vs = np.zeros(len(texts)), []
        for k, t in enumerate(texts):
            words = (t or "").encode("utf-8", "surrogatepass").split()
            columns, stats = describe(words, table)
            at, values = sparse_row(columns, stats)
            z[k] = self.weights[at] @ values
            vs.append(votes(stats, len(words)))
        vs = np.array(vs, np.int64).reshape(-1, len(LABELLERS))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500))), posterior(vs, self.prior, self.table), (vs > 0).sum(1)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Labeller statistics come from all documents, as counts of at most 3^7
    vote patterns; the scorer is fitted on at most ``sample_rows`` different
    documents, those with the lowest hashes of id and text, labelled by the
    posterior."""
    docs = docs.select("doc_id", "text")
    voted = stage(docs.mapInArrow(_vote_rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pattern int"), "votes")
    rows = voted.groupBy("pattern").count().collect()
    patterns = _digits(np.array([r["pattern"] for r in rows], np.int64))
    counts = np.array([r["count"] for r in rows], np.float64)
    prior, table = fit_label_model(patterns, counts)

    def features(batches):
        import pyarrow as pa
        words_of = WordTable()
        for b in batches:
            at, values, pattern = [], [], []
            for t in b.column(1):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                columns, stats = describe(words, words_of)
                i, v = sparse_row(columns, stats)
                at.append(i.astype(np.int32).tobytes())
                values.append(v.astype(np.float32).tobytes())
                pattern.append(votes(stats, len(words)))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(values, pa.binary()),
                                              pa.array(pattern, pa.list_(pa.int32()))], ["at", "value", "votes"])
    sample = lowest_hashes(docs, sample_rows).mapInArrow(features, "at binary, value binary, votes array<int>").collect()
    xs = [(np.frombuffer(r.at, np.int32).astype(np.int64), np.frombuffer(r.value, np.float32).astype(np.float64)) for r in sample]
    target = posterior(np.array([r.votes for r in sample], np.int64).reshape(-1, len(LABELLERS)), prior, table)
    return QualityModel(prior, table, fit_linear(xs, target))


def quality_scores(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5,
                   keep_columns: bool = False) -> DataFrame:
    """One row per document: doc_id, quality (scorer's probability of clean),
    posterior (label model), n_votes, keep (quality >= threshold).  With
    ``keep_columns`` the rows of ``docs`` that are kept, with their columns.

    Null and empty texts get the vote junk of two labellers and are scored like
    any other; null and repeated doc_ids and repeated rows keep their rows; an
    empty table gives no rows; extra columns are ignored (or kept)."""
    bc = Shared(docs.sparkSession, train(docs, sample_rows))
    if keep_columns:
        at = docs.columns.index("text")

        def select(batches):
            import pyarrow as pa
            words = WordTable()
            for b in batches:
                q, _, _ = bc.value.score(b.column(at).to_pylist(), words)
                yield b.filter(pa.array(q >= threshold))
        return docs.mapInArrow(select, docs.schema)

    def run(batches):
        import pyarrow as pa
        words = WordTable()
        for b in batches:
            q, p, n = bc.value.score(b.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(q), pa.array(p), pa.array(n.astype(np.int32)), pa.array(q >= threshold)],
                                             ["doc_id", "quality", "posterior", "n_votes", "keep"])
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {doc_type}, quality double, posterior double, n_votes int, keep boolean")
