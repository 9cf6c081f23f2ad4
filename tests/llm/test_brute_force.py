"""The operators against brute-force versions on the small driver tables and on
small fixtures with nulls, empty texts, ties, repeated rows and extra columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from varieta.llm import decontaminate, embeddings, lm, mixing, simhash, suffix_dedup
from varieta.llm.common import connected_components, spanning_links

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, _doc long, fp long, key string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df, *cols):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def odd_docs(spark):
    long = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    rows = [(1, long * 3, "a"), (2, None, "a"), (3, "", None), (4, " \t\n", "b"), (5, "one", "b"), (6, "ONE", "b"),
            (7, long * 3, "c"), (7, long * 3, "c"), (7, "x" * 250, "c"), (None, long + "tail", None), (None, None, None),
            (8, "é" * 300, "a"), (9, "w " * 3000, "a"), (10, long[:99], "b"), (11, "zz " + long[:99], "b")]
    return spark.createDataFrame([(*r, 0, 0, "k") for r in rows], DOCS)


# -- components ------------------------------------------------------------
def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("pairs", [
    [], [(3, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(-5, 2), (2, 9), (7, 7), (8, 6), (6, 8)]])
def test_connected_components(spark, pairs):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union_find([p for p in pairs if p[0] != p[1]])
    assert got == want


def test_spanning_links_keeps_components():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    u, v = spanning_links(a, b)
    want = union_find(zip(a.tolist(), b.tolist()))
    assert dict(zip(u.tolist(), v.tolist())) == {x: r for x, r in want.items() if x != r}


# -- SimHash ---------------------------------------------------------------
def slow_fingerprint(text):
    from xxhash import xxh64_intdigest
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    hs = [xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_simhash(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = union_find([*pairs, *((i, i) for i in range(len(fps)))])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    return sorted(((d, f"{f:016x}", least.get(root[i])) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


@pytest.mark.parametrize("limit", [200_000, 2])
def test_simhash_equals_brute_force(spark, documents, limit):
    for df in (documents, odd_docs(spark)):
        got = simhash.simhash_components(df, group_limit=limit).collect()
        assert sorted((tuple(r) for r in got), key=str) == slow_simhash(rows_of(df))


def test_simhash_empty_table(spark, documents):
    assert simhash.simhash_components(documents.limit(0)).collect() == []


def test_gray_index_finds_all_near_rows():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([centre, *(centre ^ (np.uint64(1) << np.uint64(b)) for b in rng.integers(0, 64, 30))]))
    fp = fp[np.argsort(simhash.gray_rank(fp))]
    for q in centre[:10]:
        index = simhash.GrayIndex(fp)
        assert sorted(index.take_near(q, 4).tolist()) == np.flatnonzero(np.bitwise_count(fp ^ q) <= 4).tolist()


def test_dense_group_joins_as_one_component():
    base = np.uint64(0x0123456789ABCDEF)
    fp = np.unique(np.array([base ^ np.uint64(1 << i | 1 << j) for i in range(40) for j in range(40)], dtype=np.uint64))
    fp = fp[np.argsort(simhash.gray_rank(fp))]
    a, b = simhash.group_links(np.zeros(len(fp), int), fp, 4)
    assert len(set(union_find(zip(a.tolist(), b.tolist())).values())) == 1
    assert len(a) < 3 * len(fp)  # not the square of the group


def test_keep_one_leaves_one_row_of_each_group(spark, documents):
    comp = simhash.simhash_components(documents)
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    assert kept.count() == comp.select("component_id").distinct().count()


def test_keep_one_with_repeated_and_missing_ids(spark):
    word = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(1, word("a"), "x"), (1, word("a"), "x"), (1, word("b"), "x"), (0, word("b"), "y"), (None, word("a"), "x"),
            (None, word("c"), "x"), (None, word("c"), "x"), (None, word("d"), "z"), (None, word("d"), None), (5, word("d"), "z"),
            (6, word("e"), None), (6, word("e"), "x"), (6, word("e"), "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for n in (1, 6):
        got = simhash.keep_one(df.repartition(n)).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == \
            sorted([(1, word("a")), (0, word("b")), (None, word("c")), (5, word("d")), (6, word("e"))], key=str)
        assert {tuple(r) for r in got} <= set(rows)
    odd = odd_docs(spark)
    assert simhash.keep_one(odd.repartition(5)).count() == len({c for _, _, c in slow_simhash([(i, t) for i, (_, t) in enumerate(rows_of(odd))])})


# -- repeated passages -----------------------------------------------------
def slow_passages(rows, length=100):
    uniq = sorted({(d if d is not None else 2**63 - 1, h, t) for d, t, h in rows})
    seen, out = set(), {}
    for d, h, t in uniq:
        data = (t or "").encode()
        mask = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i:i + length]
            if w in seen:
                mask[i:i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, m in zip(data, mask) if not m)
        out[d, t] = (len(data), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest())
    return out


def check_passages(df, **options):
    keyed = [(r.doc_id, r.text, r.h) for r in df.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h")).collect()]
    want = slow_passages(keyed)
    got = suffix_dedup.dedup_passages(df, **options).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, *tuple(r)[1:]) for r in got) == \
        sorted((d is None, d or 0, *want[d if d is not None else 2**63 - 1, t]) for d, t, _ in keyed)


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 5_000, "index_bytes": 20_000}, {"hot_contexts": 1}])
def test_passages_equal_brute_force(spark, documents, options):
    check_passages(documents, **options)


def test_passages_on_odd_rows(spark):
    check_passages(odd_docs(spark))
    check_passages(odd_docs(spark), chunk_bytes=150)


def test_passages_over_partition_and_batch_borders(spark):
    rng = np.random.default_rng(5)
    line = "".join(chr(97 + c) for c in rng.integers(0, 26, 130))
    rows = []
    for d in range(60):
        noise = ["".join(chr(97 + c) for c in rng.integers(0, 26, 90)) for _ in range(2)]
        rows.append((d, noise[0] + line[rng.integers(0, 20):130 - rng.integers(0, 20)] + noise[1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        check_passages(df)
        check_passages(df, hot_contexts=2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_passages_of_repeated_rows_stay_at_their_first_place(spark):
    """Documents that stand twice are the first holders of shared passages:
    their contexts reach the index from each row, also from different tasks."""
    rng = np.random.default_rng(15)
    text = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    shared = text(300)
    rows = [(7, text(200) + shared + text(200)), (None, text(150) + shared + text(90))]
    rows = rows * 3 + [(8, text(200) + shared + text(200))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 5):
        check_passages(df.repartition(n))
        check_passages(df.repartition(n), hot_contexts=1)
        assert suffix_dedup.dedup_passages(df.repartition(n)).where("doc_id = 7 and n_removed > 0").count() == 0


def test_windows_of_hot_anchors_move_once_a_chunk(spark):
    """A passage between different neighbours: its windows are combined before
    the shuffle, whatever the number of documents, and stay exact."""
    rng = np.random.default_rng(16)
    text = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    line = text(160)
    texts = [text(120) + line + text(120) for _ in range(300)]
    whole = [[{"anchor": 1, "span": at << 8 | 160, "hot": True} for at in (100, 161)] for _ in texts]
    import pyarrow as pa
    todo = pa.array(whole, pa.list_(pa.struct([("anchor", pa.int64()), ("span", pa.int64()), ("hot", pa.bool_())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([0] * 300), pa.array(texts), todo], ["doc", "tie", "text", "todo"])
    out = pa.Table.from_batches(suffix_dedup._cut_contexts(100, 1 << 30)([batch])).to_pylist()
    rows = Counter((r["key"], r["data"]) for r in out if r["kind"] == suffix_dedup._WINDOW)
    assert set(rows.values()) == {1}
    inside = {line[i:i + 100].encode() for i in range(61)}
    assert all(r["doc"] == 0 for r in out if r["data"] in inside)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n in (1, 4):
        check_passages(df.repartition(n), hot_contexts=5)
        check_passages(df.repartition(n), hot_contexts=5, window_bytes=2_000)


def test_run_length_index_counts_windows():
    rng = np.random.default_rng(7)
    strings = [bytes(rng.integers(97, 99, n).tolist()) for n in rng.integers(100, 140, 30)]
    strings += [s[:100] + b"end" for s in strings[:5]]
    order = rng.permutation(len(strings))
    s, o = suffix_dedup.repeated_windows(strings, order, 100)
    first = {}
    for j in np.argsort(order):
        for i in range(len(strings[j]) - 99):
            first.setdefault(strings[j][i:i + 100], (order[j], i))
    want = {(j, i) for j in range(len(strings)) for i in range(len(strings[j]) - 99)
            if first[strings[j][i:i + 100]] != (order[j], i)}
    assert set(zip(s.tolist(), o.tolist())) == want


def test_index_is_smaller_for_repetitive_text():
    base = bytes(np.random.default_rng(8).integers(97, 123, 2000).tolist())
    def runs(parts):
        data = np.concatenate([np.r_[np.frombuffer(p, np.uint8).astype(np.int16) + 1, 0] for p in parts]).astype(np.int16)
        return len(suffix_dedup.RunLengthIndex(data, np.arange(len(data)), 100).run_key)
    assert runs([base] * 8) < 1.2 * runs([base])


def test_without_passages_keeps_rows_and_whole_characters(spark, documents):
    out = suffix_dedup.without_passages(documents)
    assert out.columns == documents.columns and out.count() == documents.count()
    assert all(r.n_chars == len(r.text) for r in out.where("text is not null").collect()
               if r.text is not None and r.n_chars is not None)
    accents = spark.createDataFrame([(1, "à" + "é" * 120), (2, "è" + "é" * 120 + "ê")], "doc_id long, text string")
    assert {r.doc_id for r in suffix_dedup.without_passages(accents).collect()} == {1, 2}


# -- decontamination -------------------------------------------------------
def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_contamination(docs, items):
    windows = {}
    for item, text in items:
        ws = slow_words(text)
        k = min(10, len(ws))
        for i in range(len(ws) - k + 1) if k else ():
            windows.setdefault(tuple(ws[i:i + k]), set()).add("" if item is None else str(item))
    out = []
    for d, text in docs:
        ws, hit, found = slow_words(text), set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(ws) - k + 1):
                items_of = windows.get(tuple(ws[i:i + k]))
                if items_of:
                    hit.update(range(i, i + k))
                    found |= items_of
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


BENCH = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short item here"), (3, None), (4, "... --"),
         (None, "alpha beta gamma"), (5, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (6, "a a a"), (6, "a a a"),
         (7, "x1 " * 25), (8, "gamma delta")]


@pytest.mark.parametrize("block", [50_000, 20])
def test_contamination_equals_brute_force(spark, documents, block):
    docs = [(1, "ALPHA, beta-gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (2, None), (3, ""), (4, "a a a a b a a"),
            (5, "say short, item here short item"), (5, "say short, item here short item"), (None, "x1 " * 40), (6, "Éalpha beta gamma é"),
            (7, "beta gamma delta epsilon zeta eta theta iota kappa lambda MU alpha beta gamma delta")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame([(*b, 1) for b in BENCH], "item_id long, text string, doc_id int")
    got = decontaminate.contamination(df, bench, block_words=block)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == slow_contamination(docs, BENCH)


def test_decontaminate_cuts_spans_and_keeps_clean_rows(spark):
    passage = BENCH[0][1]
    docs = [(1, f"clean words before. {passage}! and many clean words after it, more than the passage holds by far, so it stays here", 5),
            (2, passage, 6), (3, "nothing to see", 7), (4, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in decontaminate.decontaminate(df, spark.createDataFrame(BENCH[:1], "item_id long, text string")).collect()}
    assert set(out) == {1, 3, 4}
    assert out[1].text.startswith("clean words before. !") and "alpha" not in out[1].text and out[1].n_chars == len(out[1].text)
    assert out[3].text == "nothing to see" and out[3].n_chars == 7 and out[4].text is None


def test_repeated_benchmark_rows_are_dealt_once(spark):
    """A third of the rows without id, all of one text, and one id many times."""
    rows = [(None, BENCH[0][1])] * 200 + [(5, BENCH[1][1])] * 200 + [(k, f"{BENCH[0][1]} w{k} x{k}") for k in range(10, 40)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    few = [len(a.value.next) for a in decontaminate._blocks(bench.distinct(), 10, 400)]
    assert len(few) > 1 and sorted(len(a.value.next) for a in decontaminate._blocks(bench, 10, 400)) == sorted(few)
    docs = [(1, f"before {BENCH[0][1]} w12 x12 after"), (2, BENCH[1][1]), (3, None)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_words=400)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == slow_contamination(docs, sorted(set(rows), key=str))


def test_clashing_names_keep_their_values(spark):
    """Columns named like the operators' own come back as they were."""
    shared = "one passage that several documents share word by word and that is longer than one hundred bytes in all, as it must be"
    rows = [(1, f"first start {shared} first end", 11, 12, 13, 14, 15, 16, 17, 18), (2, f"another head {shared} other tail", 21, 22, 23, 24, 25, 26, 27, 28),
            (2, f"another head {shared} other tail", 21, 22, 23, 24, 25, 26, 27, 28), (3, None, 31, 32, 33, 34, 35, 36, 37, 38)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _ROW long, _row2 long, _many long, _doc long, _tie long, _spans long, _masks long, _items long")
    bench = spark.createDataFrame([(1, shared)], "item_id long, text string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.where("doc_id > 0").collect()) == [rows[0], rows[1], rows[3]]
    cut = suffix_dedup.without_passages(df)
    assert cut.columns == df.columns
    assert sorted((r.doc_id, *r[2:]) for r in cut.collect()) == [(r[0], *r[2:]) for r in rows]
    assert {r.text for r in cut.collect() if r.doc_id == 2} == {"another headother tail"}
    clean = decontaminate.decontaminate(df, bench, max_coverage=1.0)
    assert clean.columns == df.columns and sorted((r.doc_id, *r[2:]) for r in clean.collect()) == [(r[0], *r[2:]) for r in rows]
    assert {r.text for r in clean.collect() if r.doc_id == 1} == {"first start  first end"}


def test_decontamination_without_items(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents, none).where("contaminated").count() == 0
    assert decontaminate.contamination(documents.limit(0), none).count() == 0


# -- language model --------------------------------------------------------
def slow_lm(rows):
    def tokens(t):
        return [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b"\n"]
    held = [d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    c, pairs = Counter(), Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            ws = tokens(t)
            c.update(ws)
            pairs.update(zip([b"\n", *ws], ws))
    n, v = sum(c.values()), len(c)
    out = []
    for (d, t), h in zip(rows, held):
        ws = tokens(t)
        p = [(c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in ws]
        exact = sum(math.log10((pairs[a, w] + lm.SMOOTHING * q) / (c[a] + lm.SMOOTHING)) for a, w, q in zip([b"\n", *ws], ws, p))
        out.append((d, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(map(math.log10, p)), exact))
    return out


@pytest.mark.parametrize("shard", [lm.SHARD_BYTES, 60_000])
def test_lm_equals_brute_force(spark, documents, shard):
    for df in (documents, odd_docs(spark)):
        want = sorted(slow_lm(rows_of(df)), key=lambda r: (str(r[0]), r[2], r[5]))
        got = sorted((tuple(r) for r in lm.lm_scores(df, shard_bytes=shard).collect()), key=lambda r: (str(r[0]), r[2], r[5]))
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
        # quantised counts and false positives: near the exact model
        if df is documents:
            assert abs(sum(r[6] for r in got) / sum(r[6] for r in want) - 1) < 0.03
        assert all(r[6] <= 0 for r in got)


def test_lm_is_better_than_its_base_on_held_out_texts(spark, documents):
    r = lm.lm_scores(documents).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_lm_without_training_or_rows(spark):
    assert lm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = lm.lm_scores(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in only] == [(3, 0, 0)]


def test_word_counts_above_32_bits_are_exact():
    import pyarrow as pa
    words = np.sort(np.random.default_rng(4).integers(0, 2**63, 6, dtype=np.uint64))
    n = np.array([3, 2**32 - 2, 2**32 - 1, 2**32, 4 * 10**9, 7], np.int64)

    def chunk(n):
        pairs, m = words[:1], np.array([5], np.int32)
        cols = [[0], [words.tobytes()], [n.tobytes()], [pairs.tobytes()], [m.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                                          ["part", "words", "word_n", "pairs", "pair_n"])
    for chunks in ([chunk(n)], [chunk(n), chunk(n)]):
        row = pa.Table.from_batches(lm._model_parts(chunks)).to_pylist()[0]
        shard = lm.Shard([row], 1, row["tokens"], row["types"])
        assert shard.count(words).tolist() == (len(chunks) * n).tolist()
        assert shard.count(words + np.uint64(1)).tolist() == [0] * 6
        assert row["tokens"] == len(chunks) * n.sum()


def test_filter_never_loses_a_level():
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    n = rng.geometric(0.2, len(x)) ** 2
    shard = lm.Shard([{"part": 0, "words": b"", "word_n": b"", "bits": lm.build_filter(x, n).tobytes()}], 1, 1, 1)
    word = np.zeros(len(x), np.uint64)
    assert (shard.level(x, word) >= lm.level_of(n)).all()
    other = np.setdiff1d(rng.integers(0, 2**63, 20_000, dtype=np.uint64), x)
    assert (shard.level(other, np.zeros(len(other), np.uint64)) > 0).mean() < 0.05


# -- embeddings ------------------------------------------------------------
def slow_embeddings(rows, threshold=0.9):
    ok = [bool(v) and None not in v and all(map(math.isfinite, v)) and any(v) for _, v in rows]
    pairs = []
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if ok[i] and ok[j] and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    pairs.append((i, j))
    root = union_find([*pairs, *((i, i) for i in range(len(rows)))])
    n = Counter(i for p in pairs for i in p)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    return sorted(((d, n[i], least.get(root[i]), d == least.get(root[i])) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 60, "tile_rows": 25}])
def test_embeddings_equal_brute_force(spark, sizes):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").limit(250)
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    rng = np.random.default_rng(4)
    near = rng.standard_normal(64)
    rows += [(10_000 + i, [float(np.float32(x)) for x in near + rng.standard_normal(64) * 0.25]) for i in range(60)]
    rows += [(1, None), (2, []), (3, [0.0] * 64), (4, [1.0, None]), (5, [float("nan")] * 64), (6, [float("inf")] * 64),
             (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [0.0, 5.0]), (9, [0.1, 7.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, node int")
    got = embeddings.embedding_components(df, **sizes).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow_embeddings(rows)


def test_embeddings_of_extreme_size(spark):
    """Squares that leave the doubles' range do not hide a direction."""
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [3.0, 3.0]), (4, [1.0, -1.0]), (5, [-0.0, 0.0]), (6, [1e308, float("inf")]),
            (7, [5e-324, 5e-324])]
    got = embeddings.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 0, 5, True),
                                             (6, 0, 6, True), (7, 3, 1, False)]


def test_cells_in_reach_hold_all_near_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.125, (1500, 16))
    tree = embeddings.CellTree(x[:1000], 100)
    home, row, cell = tree.reach(x, 0.1)
    assert 64 <= tree.cells <= 128 and set(home) == set(range(tree.cells))
    visits = set(zip(row.tolist(), cell.tolist()))
    assert len(visits) == len(row) and all(c < home[r] for r, c in visits)
    near = ((x[:, None] - x[None])**2).sum(2) <= 0.1
    assert near.sum() > 2000
    for a, b in zip(*np.nonzero(near)):
        assert home[a] == home[b] or ((a, home[b]) if home[b] < home[a] else (b, home[a])) in visits


def test_block_axes_keep_distances():
    rng = np.random.default_rng(2)
    raw = rng.normal(size=(200, 40)) * np.linspace(1, 3, 40)
    q = embeddings.rotation(40)
    turned = embeddings.principal_axes(q, raw)
    assert np.allclose(turned @ turned.T, np.eye(40))
    x, y = embeddings.unit_rotated(raw, q), embeddings.unit_rotated(raw, turned)
    for s in embeddings.blocks(40):
        assert np.allclose(np.linalg.norm(x[0, s] - x[1, s]), np.linalg.norm(y[0, s] - y[1, s]))
        var = y[:, s].var(0)
        assert (np.diff(var) <= 1e-12).all()


def test_embeddings_empty_table(spark):
    assert embeddings.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# -- mixing ----------------------------------------------------------------
def test_water_filling_by_hand(spark):
    per = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 100), ("d", 50), (None, 10)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(per).collect()}
    # 1890 words by 3:1:2:3:1; a, c and d are clamped at 200, 200, 100 and null at 20: b takes the rest
    assert got == {"a": 200.0, "c": 200.0, "d": 100.0, None: 20.0, "b": 1370.0}


def test_mix_meets_targets_and_repeats(spark, documents):
    for df in (documents.withColumn("taken", F.lit(1)), odd_docs(spark)):
        one, two = mixing.mix_sources(df).collect(), mixing.mix_sources(df.repartition(5)).collect()
        assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == df.count()
        assert all(0 <= r.taken <= 2 * r.size for r in one)
        taken, target = Counter(), {}
        for r in one:
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert r.target <= 2 * r.source_size
        assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    assert mixing.mix_sources(documents.limit(0)).collect() == []
