"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, stage

BUCKETS = 1 << 20
SAMPLE_ROWS = 20_000
GRADES = 4
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: itself and its first 4, 5 and 6 characters."""
    from xxhash import xxh64_intdigest
    core = word.decode("utf-8", "replace").strip(MARKS).lower()
    if not core:
        return ()
    keys = {core + "$", *(core[:k] for k in (4, 5, 6) if len(core) >= k)}
    return tuple(sorted(xxh64_intdigest(k.encode("utf-8", "replace"), 2) % BUCKETS for k in keys))


class _Features(dict):
    """Word -> its features (those in ``columns`` as column numbers, if given)."""

    def __init__(self, columns: dict | None = None):
        super().__init__()
        self.columns = columns

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        f = word_features(word)
        if self.columns is not None:
            f = tuple(self.columns[x] for x in f if x in self.columns)
        self[word] = f
        return f


def _words(text) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def choose_features(df_toxic: np.ndarray, df_clean: np.ndarray, n_toxic: int, n_clean: int, least: int = 3,
                    chance: float = 1e-4) -> np.ndarray:
    """Features in so many toxic documents, of all that hold them, as would
    happen with less than ``chance`` if toxic documents were like others
    (Chernoff bound of the binomial tail)."""
    total = df_toxic + df_clean
    share = max(n_toxic, 1) / max(n_toxic + n_clean, 2)
    got = np.divide(df_toxic, total, out=np.zeros(len(total)), where=total > 0)
    far = np.clip(got, 1e-12, 1 - 1e-12)
    divergence = far * np.log(far / share) + (1 - far) * np.log((1 - far) / max(1 - share, 1e-12))
    return np.flatnonzero((df_toxic >= least) & (got > share) & (total * divergence > -np.log(chance)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class OrdinalModel:
    """P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all
    thresholds, which stay ordered as theta_1 plus positive gaps."""

    def __init__(self, columns: dict, n: int, grades: int = GRADES):
        self.columns, self.grades = columns, grades
        self.w = np.zeros(n)
        self.first, self.gaps = 3.0, np.zeros(grades - 2)

    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])

    def above(self, s: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0 .. grades - 2, a column each."""
        return _sigmoid(s[:, None] - self.thresholds()[None, :])

    def fit(self, doc: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, rounds: int = 400,
            step: float = 0.2, ridge: float = 1e-4) -> OrdinalModel:
        """Adaptive gradient ascent of the mean log-likelihood."""
        n = len(grade)
        if not n:
            return self
        seen = [np.full(len(self.w), 1e-8), 1e-8, np.full(len(self.gaps), 1e-8)]
        share = np.bincount(grade, minlength=self.grades)
        weight = (n / (share + 1.0) / self.grades)[grade] ** 0.5 / n
        for _ in range(rounds):
            s = np.bincount(doc, self.w[column] * value, n)
            t = np.concatenate([[-np.inf], self.thresholds(), [np.inf]])
            hi, lo = _sigmoid(t[grade + 1] - s), _sigmoid(t[grade] - s)
            mass = np.maximum(hi - lo, 1e-12)
            g_s = (hi + lo - 1) * weight
            g_t = np.bincount(grade + 1, hi * (1 - hi) / mass * weight, self.grades + 1) \
                - np.bincount(grade, lo * (1 - lo) / mass * weight, self.grades + 1)
            g_t = g_t[1:-1]
            after = g_t[::-1].cumsum()[::-1]
            grads = [np.bincount(column, value * g_s[doc], len(self.w)) - ridge * self.w, after[0], after[1:] * np.exp(self.gaps)]
            seen = [a + g * g for a, g in zip(seen, grads)]
            self.w += step * grads[0] / np.sqrt(seen[0])
            self.first += step * grads[1] / np.sqrt(seen[1])
            self.gaps = np.clip(self.gaps + step * grads[2] / np.sqrt(seen[2]), -5, 5)
        return self

    def rows(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows of texts: (doc, column, value) and indicative words per text."""
        table = _Features(self.columns)
        doc, column, hits = [], [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            found = [f for f in map(table.__getitem__, _words(t)) if f]
            hits[k] = len(found)
            for f in found:
                doc.extend([k] * len(f))
                column.extend(f)
        key, n = np.unique(np.array(doc, np.int64) * max(1, len(self.w)) + np.array(column, np.int64), return_counts=True)
        return key // max(1, len(self.w)), key % max(1, len(self.w)), np.log1p(n), hits

    def score(self, texts: list) -> np.ndarray:
        doc, column, value, _ = self.rows(texts)
        return self.above(np.bincount(doc, self.w[column] * value, len(texts)) if len(self.w) else np.zeros(len(texts)))


def severity(toxic: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Grade of a labelled row: 0 for clean, else 1, 2 (3 or more indicative
    words) or 3 (6 or more)."""
    return np.where(toxic > 0, 1 + (hits >= 3) + (hits >= 6), 0)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on about ``sample_rows`` labelled documents with the lowest hashes.

    The sample is written once, in the shared folder, so all documents are
    scanned once for it.  A first pass over it, combined by Spark, chooses the
    features: a toxic document counts once for each new word before the
    feature, so a passage that many toxic documents share counts once.  The
    labels grade a document by its indicative words; then the regression is
    fitted."""
    lab = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    n = lab.count()
    share = min(1.0, sample_rows / max(1, n))
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < int(np.ceil(share * (1 << 24)))
    lab = lab.where(pick).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # about sample_rows ids: small enough to broadcast
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").select("toxic", "text"), "toxic-sample")
    n_doc = sample.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(~(F.col("toxic") > 0)).alias("clean")).first()

    def count(batches: Iterator) -> Iterator:
        """(toxic, key, n) of a part: a feature's clean documents, and the
        distinct (feature, word before) pairs of toxic ones."""
        import pyarrow as pa
        from xxhash import xxh32_intdigest
        table, clean = _Features(), np.zeros(BUCKETS, np.int64)
        for b in batches:
            pairs: set = set()
            for toxic, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = _words(t.as_py())
                if toxic > 0:
                    pairs.update(x << 32 | xxh32_intdigest(before) for before, w in zip([b"", *words], words) for x in table[w])
                else:
                    f = {x for w in set(words) for x in table[w]}
                    clean[np.fromiter(f, np.int64, len(f))] += 1
            key = np.fromiter(pairs, np.int64, len(pairs))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(key), bool)), pa.array(key), pa.array(np.ones(len(key), np.int64))],
                                             ["toxic", "key", "n"])
        key = np.flatnonzero(clean)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(key), bool)), pa.array(key), pa.array(clean[key])], ["toxic", "key", "n"])
    once = sample.mapInArrow(count, "toxic boolean, key long, n long").groupBy("toxic", "key").agg(F.sum("n").alias("n"))
    feature = F.when(F.col("toxic"), F.shiftright("key", 32)).otherwise(F.col("key"))
    df = once.groupBy(feature.alias("feature")).agg(F.count_if("toxic").alias("toxic"), F.sum(F.when(~F.col("toxic"), F.col("n")).otherwise(0)).alias("clean")) \
        .where(F.col("toxic") > 0).orderBy("feature").toPandas()  # at most BUCKETS rows
    chosen = df["feature"].to_numpy()[choose_features(df["toxic"].to_numpy(float), df["clean"].to_numpy(float), n_doc.toxic, n_doc.clean)]
    model = OrdinalModel({int(f): i for i, f in enumerate(chosen)}, len(chosen))

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            texts = b.column(1).to_pylist()
            doc, column, value, hits = model.rows(texts)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int32()), pa.array(hits.astype(np.int32)),
                 pa.array([column[a:z].astype(np.int32).tobytes() for a, z in zip(cut, cut[1:])], pa.binary()),
                 pa.array([value[a:z].astype(np.float32).tobytes() for a, z in zip(cut, cut[1:])], pa.binary())],
                ["toxic", "hits", "at", "value"])
    got = sample.mapInArrow(rows, "toxic int, hits int, at binary, value binary").collect()  # chosen features only
    at = [np.frombuffer(r.at, np.int32) for r in got]
    doc = np.repeat(np.arange(len(got)), [len(a) for a in at])
    grade = severity(np.array([r.toxic for r in got], np.int64), np.array([r.hits for r in got], np.int64))
    if not len(doc):
        return model
    return model.fit(doc, np.concatenate(at).astype(np.int64),
                     np.concatenate([np.frombuffer(r.value, np.float32) for r in got]).astype(float), grade)


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, severity (expected grade), grade (most
    likely), p_toxic (P(grade > 0)), toxic (p_toxic >= 0.5).

    Null and empty texts have no features; null labels and labels of unknown
    documents are not used; of repeated labels the highest counts; without
    labels nothing is toxic; null doc_ids and repeated rows keep their rows;
    an empty table gives no rows; other columns are ignored."""
    bc = Shared(docs.sparkSession, train(docs, labels, sample_rows))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            above = bc.value.score(b.column(1).to_pylist())
            mass = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(above.sum(1)), pa.array(mass.argmax(1).astype(np.int32)), pa.array(above[:, 0]),
                 pa.array(above[:, 0] >= 0.5)], ["doc_id", "severity", "grade", "p_toxic", "toxic"])
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {doc_type}, severity double, grade int, p_toxic double, toxic boolean")
