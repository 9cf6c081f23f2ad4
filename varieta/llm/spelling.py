"""Spelling variants: words one insertion, deletion or replacement apart.

Words stand in sorted order; a trie node is numbered by the place where its
string first stands in that order, forward for beginnings and, over the
reversed words, for endings.  A word cut at place i is the integer pair
(node of its first i characters, node of the rest); a word with character i
skipped is the pair around that character.  Equal pairs are equal strings, so
equi-joins of these pairs give exactly the words at distance one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .tokens import text_chunks

CHUNK_BYTES = 8_000_000
CHANGE_EVERY = 97       # the contract's planted change: one in so many words of a document
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
PART_WORDS = 100_000    # words numbered in one task


# -- counting --------------------------------------------------------------
def word_runs(data: np.ndarray, doc_ends: np.ndarray):
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` in UTF-8 bytes, A-Z lower-cased:
    (bytes of the runs one after the other, their bounds, their documents).
    Those letters are C3 80 to C3 BF in UTF-8."""
    lower = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(0x20), data)
    lead = data == 0xC3
    inside = ((lower >= 0x61) & (lower <= 0x7A)) | lead
    inside[1:] |= lead[:-1]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    # two documents may touch: a run starts anew with its document
    starts_doc = doc_ends[:-1][doc_ends[:-1] < len(data)]
    first[starts_doc] = inside[starts_doc]
    at = np.flatnonzero(first)
    kept = np.cumsum(inside)
    bounds = np.append(kept[at] - 1, int(kept[-1]) if len(kept) else 0)
    return lower[inside], bounds, np.searchsorted(doc_ends, at, side="right") - 1


def crc_shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 register of each ``crc`` after ``length`` zero bytes; with the
    XOR of a second string's CRC it is the CRC of both strings in a row."""
    out = np.empty(len(crc), np.uint32)
    for n in np.unique(length).tolist():
        mine = np.flatnonzero(length == n)
        zeros = bytes(n)
        base = zlib.crc32(zeros)
        # linear in the register: one entry for each bit
        rows = np.array([zlib.crc32(zeros, 1 << k) ^ base for k in range(32)], np.uint32)
        value, got = crc[mine], np.zeros(len(mine), np.uint32)
        for k in range(32):
            got ^= np.where(value >> np.uint32(k) & np.uint32(1), rows[k], np.uint32(0))
        out[mine] = got
    return out


def _chunk_counts(t, every: int):
    import pyarrow as pa
    import pyarrow.compute as pc
    col = pc.fill_null(t.column(1).cast(pa.large_string()), "").combine_chunks()
    n = len(col)
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    body, bounds, doc = word_runs(data, ends)
    coded = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1,
                                  [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
    words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key, times = np.unique(doc * max(len(words), 1) + code, return_counts=True)
    if not every or not len(key):
        return words, np.bincount(code, minlength=len(words)), {}
    doc, code = key // len(words), key % len(words)
    ids = t.column(0).to_pylist()
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = np.array([zlib.crc32(w) for w in words], np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    h = crc_shift(prefix[doc], size[code]) ^ crc[code]
    hit = h % np.uint32(every) == 0
    counts = np.bincount(code[~hit], times[~hit], minlength=len(words)).astype(np.int64)
    changed: dict[bytes, int] = {}
    for c, v, m in zip(code[hit].tolist(), h[hit].tolist(), times[hit].tolist()):
        run = words[c].decode("utf-8")
        at = v % len(run)
        w = (run[:at] + run[at + 1:]).encode("utf-8")
        changed[w] = changed.get(w, 0) + m
    return words, counts, changed


def _counted(every: int, least: int, chunk_bytes: int):
    def run(batches):
        import pyarrow as pa
        for t in text_chunks(batches, 1, chunk_bytes):
            words, counts, changed = _chunk_counts(t, every)
            for w in np.flatnonzero(counts).tolist():
                changed[words[w]] = changed.get(words[w], 0) + int(counts[w])
            kept = [(w, c) for w, c in ((b.decode("utf-8"), c) for b, c in changed.items()) if len(w) >= least]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([c for _, c in kept], pa.int64())],
                                                 ["word", "n"])
    return run


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                change_every: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Words of all whole texts of ``docs(doc_id, text)`` and how often they
    stand there: (word, n).  ``change_every`` plants the contract's misspellings
    (a CRC of document and word decides and picks the character that goes); 0
    plants none.  A chunk sends each of its words once."""
    found = docs.select("doc_id", "text").mapInArrow(_counted(change_every, least_length, chunk_bytes), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# -- trie nodes ------------------------------------------------------------
def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n   # the first difference lies in (lo, hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def node_scan(words: list[str], part: int, last: str = "", nodes: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Numbers of the nodes on the path of each of the sorted ``words``: entry
    d is the node of the first d characters.  A new node's number is its place
    among all characters of the part; ``last`` and ``nodes`` are the word
    before the part and its path."""
    path = np.zeros(1, np.int64) if nodes is None else nodes   # the root is node 0
    at = (part << 36) + 1
    for w in words:
        same = _shared(last, w)
        path = np.concatenate([path[: same + 1], np.arange(at + same + 1, at + len(w) + 1)])
        at += len(w) + 1
        last = w
        yield path


def chain_paths(ends: list[tuple[int, str, list[int]]]) -> dict[int, tuple[str, np.ndarray]]:
    """For each part the word before it with its path, from each part's last
    word and the path that this word has without what stands before."""
    out, last, nodes = {}, "", np.zeros(1, np.int64)
    for part, word, path in sorted(ends):
        out[part] = (last, nodes)
        same = _shared(last, word)
        nodes = np.concatenate([nodes[: same + 1], np.array(path, np.int64)[same + 1:]])
        last = word
    return out


def _sorted_words(table, column: str):
    words = table.column(column).to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    return [words[i] for i in order], order


def trie_paths(words: DataFrame, reverse: bool, part_words: int = PART_WORDS) -> DataFrame:
    """(word, nodes): ``nodes[d]`` is the number of the trie node of the first
    d characters (of the last d with ``reverse``).  Words are sorted into
    ranges of about ``part_words``; a range takes over the path of the word
    before it, of which the driver sees one for each range."""
    from .common import Shared
    spark = words.sparkSession
    parts = max(1, -(-words.count() // part_words))
    keyed = words.select("word", (F.reverse("word") if reverse else F.col("word")).alias("_key"))
    dealt = stage(keyed.repartitionByRange(parts, "_key").withColumn("_part", F.spark_partition_id().cast("long")), "ranges")

    def last_paths(table):
        import pyarrow as pa
        part = table.column("_part")[0].as_py()
        keys, _ = _sorted_words(table, "_key")
        path = None
        for path in node_scan(keys, part):
            pass
        return pa.table([pa.array([part]), pa.array([keys[-1]]), pa.array([path.tolist()], pa.list_(pa.int64()))],
                        names=["_part", "word", "nodes"])
    ends = dealt.groupBy("_part").applyInArrow(last_paths, "_part long, word string, nodes array<long>").collect()  # one row a range
    before = spark.sparkContext.broadcast(chain_paths([tuple(r) for r in ends]))

    def paths(table):
        import pyarrow as pa
        part = table.column("_part")[0].as_py()
        keys, order = _sorted_words(table, "_key")
        found = list(node_scan(keys, part, *before.value[part]))
        ptr = np.concatenate([[0], np.cumsum([len(p) for p in found])])
        nodes = pa.LargeListArray.from_arrays(pa.array(ptr, pa.int64()), pa.array(np.concatenate(found)))
        return pa.table([table.column("word").take(pa.array(order)), nodes.cast(pa.list_(pa.int64()))], names=["word", "nodes"])
    return dealt.groupBy("_part").applyInArrow(paths, "word string, nodes array<long>")


# -- neighbours ------------------------------------------------------------
def near_pairs(nodes: DataFrame) -> DataFrame:
    """Dictionary of integer pairs: one row per pair of trie nodes that two
    words meet in.  ``skipped`` holds the words with one character left out
    there, ``plain`` the word that is the pair itself.  Words in one pair
    differ in that character alone, so a pair holds no more of them than there
    are letters.  ``nodes`` has id, n, letters, fore and back (node paths)."""
    length = F.size("letters")
    i = F.col("i")
    skip = nodes.select("id", "n", F.col("letters"), "fore", "back",
                        F.explode(F.sequence(F.lit(0), length)).alias("i")).select(
        "id", "n", F.col("fore")[i].alias("head"),
        F.explode(F.array(
            F.struct(F.col("back")[length - i].alias("tail"), F.lit(True).alias("plain"), F.lit(False).alias("once")),
            # of equal letters in a row only the first is left out: the others give the same string
            F.struct(F.when(i < length, F.col("back")[length - i - 1]).alias("tail"), F.lit(False).alias("plain"),
                     (F.when(i == 0, F.lit(True)).otherwise(F.try_element_at("letters", i + 1) != F.try_element_at("letters", F.greatest(i, F.lit(1))))
                      ).alias("once")))).alias("x")).select("id", "n", "head", "x.*").where(F.col("tail").isNotNull())
    member = F.struct((-F.col("n")).alias("less"), "id", "once")
    pairs = skip.groupBy("head", "tail").agg(F.collect_list(F.when(~F.col("plain"), member)).alias("skipped"),
                                             F.max(F.when(F.col("plain"), member)).alias("plain"))
    return pairs.where(F.size("skipped") + F.col("plain").isNotNull().cast("int") >= 2)


def near_words(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are near and the best of them as
    (-n, id); each pair of near words meets in one dictionary pair only."""
    once = F.filter("skipped", lambda m: m["once"])
    smaller = pairs.withColumn("low", F.array_min(F.transform("skipped", lambda m: F.struct(m["less"].alias("less"), m["id"].alias("id")))))
    second = F.array_min(F.transform(F.filter("skipped", lambda m: m["id"] != F.col("low.id")),
                                     lambda m: F.struct(m["less"].alias("less"), m["id"].alias("id"))))
    key = F.struct(F.col("plain.less").alias("less"), F.col("plain.id").alias("id"))
    by_skip = smaller.withColumn("second", second).withColumn("plain_key", F.when(F.col("plain").isNotNull(), key)) \
        .select("second", "low", "plain_key", F.size("skipped").alias("size"), F.explode("skipped").alias("m"))
    with_plain = F.col("m.once") & F.col("plain_key").isNotNull()
    other = F.when(F.col("low.id") == F.col("m.id"), F.col("second")).otherwise(F.col("low"))
    a = by_skip.select(F.col("m.id").alias("id"), (F.col("size") - 1 + with_plain.cast("int")).cast("long").alias("near"),
                       F.least(other, F.when(with_plain, F.col("plain_key"))).alias("best"))
    b = pairs.where(F.col("plain").isNotNull()).select(
        F.col("plain.id").alias("id"), F.size(once).cast("long").alias("near"),
        F.array_min(F.transform(once, lambda m: F.struct(m["less"].alias("less"), m["id"].alias("id")))).alias("best"))
    return a.unionByName(b).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")).where(F.col("n_near") > 0)


def follow_forms(forms: DataFrame) -> DataFrame:
    """(id, root) of ``forms(id, form)``: the last word reached.  Each round
    doubles the steps; counts at least double along a chain, so it ends."""
    at = stage(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        nxt = at.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        moved = stage(at.join(nxt, "root", "left").select("id", F.coalesce("_next", "root").alias("root"),
                                                          F.col("_next").isNotNull().alias("_moved")), "roots")
        if not moved.where("_moved").limit(1).count():
            return moved.select("id", "root")
        at = moved.select("id", "root")


def group_spellings(words: DataFrame, ratio: int = RATIO, part_words: int = PART_WORDS) -> DataFrame:
    """Spelling groups of ``words(word, n)``, each word once.

    Returns word, form, root, n, n_near, form_n: the near word with the
    largest n (ties: the smallest in code-point order) if it has ``ratio``
    times the word's n, the last word reached over forms, and the number of
    near words.  Nothing but one path a range of words and row counts reaches
    the driver; words of any length cost rows in their length, and move as
    numbers.

    A null or empty word, or one with a null n, is left out; an empty table
    gives no rows; other columns are ignored; a word given twice is an error
    of the caller (its counts are not added up)."""
    words = stage(words.select("word", "n").where("n IS NOT NULL AND word <> ''"), "words")
    fore = trie_paths(words, False, part_words).withColumnRenamed("nodes", "fore")
    back = trie_paths(words, True, part_words).withColumnRenamed("nodes", "back")
    # a word's own node in the forward trie is its number: unique, and in code-point order
    nodes = stage(words.join(fore, "word").join(back, "word")
                  .select(F.element_at("fore", -1).alias("id"), "word", "n", F.split("word", "").alias("letters"), "fore", "back"), "nodes")
    near = near_words(near_pairs(nodes.select("id", "n", "letters", "fore", "back")))
    found = stage(nodes.select("id", "word", "n").join(near, "id", "left")
                  .select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                          F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best")), "near")
    forms = found.where(F.col("best").isNotNull()).select("id", F.col("best.id").alias("form"))
    roots = follow_forms(forms)
    names = found.select("id", "word")
    out = found.where(F.col("best").isNotNull()).join(roots, "id") \
        .join(names.select(F.col("id").alias("_f"), F.col("word").alias("form")), F.col("best.id") == F.col("_f")) \
        .join(names.select(F.col("id").alias("_r"), F.col("word").alias("_root")), F.col("root") == F.col("_r")) \
        .select("word", "form", F.col("_root").alias("root"), "n", "n_near", (-F.col("best.less")).alias("form_n"))
    alone = found.where(F.col("best").isNull()).select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"),
                                                       "n", "n_near", F.lit(None).cast("long").alias("form_n"))
    return out.unionByName(alone)


def spelling_variants(docs: DataFrame, change_every: int = CHANGE_EVERY, chunk_bytes: int = CHUNK_BYTES,
                      part_words: int = PART_WORDS) -> DataFrame:
    """Count the words of ``docs`` (see ``word_counts``) and group their
    spellings (see ``group_spellings``).

    Null and empty texts have no words, a null doc_id plants like an empty
    one, repeated rows count as often as they stand there, an empty table
    gives no rows, other columns are ignored, texts of any length are read
    whole."""
    return group_spellings(word_counts(docs, change_every=change_every, chunk_bytes=chunk_bytes), part_words=part_words)
