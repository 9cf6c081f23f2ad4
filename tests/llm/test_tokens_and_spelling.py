"""Tokenizer alignment, packing and spelling groups against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from varieta.llm import align, packing, spelling, tokens

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, chunk long, units string, length int, n int"
ODD = ["", None, " ", "  two  spaces ", "tab\there\nand  \n\n lines \n", "don't we've IT'S", "café  ÀÉ naïve", "nb sp   em 　 x",
       "emoji \U0001F468‍\U0001F469 \U0001F600\U0001F44D\U0001F3FD ok", "漢字 かな 漢字かな 한국어", "a▁b mark", "▁", "<|endoftext|> and </s> <s> <unk>",
       "x" * 5000, "=" * 3001 + " " + "-" * 17, "nul\x00byte \x1f sep\x85 next", "é combining", "ʼʼ ǅ ɏ ʰ", "word " * 800, " lead", "trail ",
       "“curly” ‘quotes’ – dash…", "\r\n\r\n win \r\n", "12345 1,234.56 ½ ² ٣"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_docs(spark):
    rows = [(k if k % 9 else None, t, "s", 1, "u", 2, 3) for k, t in enumerate(ODD + ODD[:6])]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer
    first = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    return first, sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path("piece_bpe_32k.model"))


# -- units -----------------------------------------------------------------
def test_units_encode_as_whole_texts(documents, library):
    import pyarrow as pa
    first, second = library
    texts = ODD + [r.text for r in documents.limit(120).collect()]
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "a", "é", "'s", "Word", "9", ".", " ", " ", "漢", "▁", "<|endoftext|>", "ß!"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    for plain, lead in ((True, True), (False, False)):
        first.encode_special_tokens = plain
        codes, at, units = tokens.cut_units(pa.array(texts), lead=lead)
        tools = [(tokens.ByteTokenizer(tokens.vocabulary_path("byte_bpe_50k.json"), plain), lambda t: first.encode(t, add_special_tokens=False).ids)]
        if lead:
            tools.append((tokens.PieceTokenizer(tokens.vocabulary_path("piece_bpe_32k.model")), lambda t: second.encode(t[1:])))
        for tool, whole in tools:
            ptr, ids = tool.encode(units)
            for k, t in enumerate(texts):
                got = [i for c in codes[at[k]: at[k + 1]] for i in ids[ptr[c]: ptr[c + 1]]]
                assert got == (whole(" " * lead + t) if t else []), t


# -- alignment -------------------------------------------------------------
def brute_alignment(rows, library):
    first, second = library
    first.encode_special_tokens = True
    letters = tokens.byte_letters()
    a_name = {i: bytes(letters[c] for c in e) for e, i in first.get_vocab(with_added_tokens=False).items()}
    pieces = [second.id_to_piece(i) for i in range(second.get_piece_size())]
    b_name = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    docs, count = [], Counter()
    for doc, text in rows:
        a, b, groups, links, shared = [], [], [], [], 0
        if text:
            raw = (" " + text).encode()
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            if b"".join(a_name[i] for i in a) != raw or b"".join(b_name[i] for i in b) != raw:
                a, b = [], []
        spans = []
        for ids, name in ((a, a_name), (b, b_name)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(name[i]), i))
                at += len(name[i])
            spans.append(out)
        j = 0
        for s, e, x in spans[0]:
            while j < len(spans[1]) and spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((x, spans[1][k][2]))
                k += 1
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        low = 0
        for end in ends:
            ga, gb = ([x for s, e, x in side if low < e <= end] for side in spans)
            groups.append((ga, gb))
            shared += len(ga) * len(gb)
            low = end
        count.update(links)
        docs.append((doc, a, b, groups, links, shared))
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    out = []
    for doc, a, b, groups, links, shared in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if a else "", shared))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("chunk", [2_000, 16_000_000])
def test_alignment_equals_brute_force(spark, documents, library, chunk):
    for docs in (odd_docs(spark), documents.limit(80)):
        want = brute_alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], library)
        got = [tuple(r) for r in align.alignment_counts(docs, chunk_bytes=chunk).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_alignment_without_tokens_or_rows(spark):
    none = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    got = {tuple(r) for r in align.alignment_counts(none).collect()}
    assert got == {(k, 0, 0, 0, 0, 0, 0, "", 0) for k in (1, 2, 3)}
    assert align.alignment_counts(none.where("doc_id < 0")).collect() == []
    assert align.token_links(none).collect() == []


@pytest.mark.parametrize("kind", ["overlap", "group"])
def test_links_equal_their_counts(spark, kind):
    docs = odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    n = {r.doc_id: r.n_links if kind == "overlap" else r.n_shared for r in align.alignment_counts(docs).collect()}
    links = align.token_links(docs, kind, chunk_bytes=3_000).collect()
    assert Counter(r.doc_id for r in links) == Counter({k: v for k, v in n.items() if v})
    assert len({(r.doc_id, r.a_index, r.b_index) for r in links}) == len(links)
    if kind == "overlap":
        size = Counter()
        for r in links:
            size[r.doc_id] += r.value
        text = {r.doc_id: r.text for r in docs.collect()}
        assert all(v == len(text[k].encode()) + 1 for k, v in size.items())


def test_sparse_products_equal_dense_ones():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n, m, k = rng.integers(1, 12, 3)
        x, y = rng.random((n, m)) < 0.3, rng.random((m, k)) < 0.3

        def csr(d):
            return align.Csr(np.concatenate([[0], np.cumsum(d.sum(1))]), np.nonzero(d)[1], d.shape[1])
        out = np.zeros((n, k), int)
        for i, j, v in align.row_products(csr(x), csr(y), block=int(rng.integers(1, 9))):
            out[i, j] += v
        assert (out == x.astype(int) @ y.astype(int)).all()
        t = csr(x).transpose()
        assert [t.cols[t.ptr[i]: t.ptr[i + 1]].tolist() for i in range(m)] == [np.flatnonzero(x[:, i]).tolist() for i in range(m)]


# -- packing ---------------------------------------------------------------
def brute_best_fit(items, capacity):
    rooms = []
    for s in sorted(items, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


def fewest(items, capacity):
    """Exact number of bins by search, for small instances."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= items[k]:
                i = rooms.index(r)
                place(k + 1, [*rooms[:i], r - items[k], *rooms[i + 1:]])
        place(k + 1, [*rooms, capacity - items[k]])
    place(0, [])
    return best[0]


def test_packing_by_counts_equals_item_by_item():
    rng = random.Random(2)
    for _ in range(200):
        c = rng.choice([7, 20, 100])
        items = [rng.randint(1, c) for _ in range(rng.randrange(1, 120))]
        counts = Counter(items)
        assert sum(n for _, n in packing.best_fit(dict(counts), c)) == brute_best_fit(items, c)
        bins, left = packing.pack_sizes(dict(counts), c), Counter()
        for sizes, n in bins:
            assert n > 0 and sum(sizes) <= c
            for s in sizes:
                left[s] += n
        assert left == counts


def test_reduction_keeps_the_optimum():
    """Bins fixed for good and the best of the rest make the best of all."""
    rng = random.Random(4)
    fixed_any = 0
    for _ in range(150):
        c = rng.choice([10, 17, 30])
        items = [rng.randint(2, c) for _ in range(rng.randrange(1, 10))]
        fixed, rest = packing.reduce_sizes(dict(Counter(items)), c)
        n = sum(t for _, t in fixed)
        fixed_any += n
        assert n + fewest(list(Counter(rest).elements()), c) == fewest(items, c)
    assert fixed_any > 300


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packed_pieces_hold_the_ids(spark, documents, library, capacity):
    first, _ = library
    first.encode_special_tokens = False
    for docs in (odd_docs(spark), documents):
        got = packing.pack_documents(docs, capacity).collect()
        want = Counter()
        total = 0
        for r in docs.select("doc_id", "text").collect():
            ids = [*first.encode(r.text or "", add_special_tokens=False).ids, 0]
            total += len(ids)
            n = -(-len(ids) // capacity)
            head = len(ids) - (n - 1) * capacity
            for p in range(n):
                s, e = (0, head) if p == 0 else (head + (p - 1) * capacity, head + p * capacity)
                want[(r.doc_id, p, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()))] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        seqs: dict = {}
        for r in got:
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in seqs.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        sizes = [r.length for r in got]
        assert -(-total // capacity) <= len(seqs) <= brute_best_fit(sizes, capacity)


def test_packing_of_no_rows(spark, documents):
    assert packing.pack_documents(documents.where("doc_id < 0")).collect() == []


# -- spelling --------------------------------------------------------------
def brute_counts(rows, every, least_length=5, least_count=3):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}


def brute_groups(n, ratio=2):
    words, near = sorted(n), {w: set() for w in n}
    shorter: dict = {}
    for w in words:
        for i in range(len(w)):
            shorter.setdefault((i, w[:i] + w[i + 1:]), []).append(w)
    for (_, s), group in shorter.items():
        for w in group:
            near[w].update(x for x in group if x != w)
            if s in near:
                near[w].add(s)
                near[s].add(w)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_crc_of_two_strings():
    rng = random.Random(1)
    a, b = ([bytes(rng.randrange(256) for _ in range(rng.randrange(1, 30))) for _ in range(300)] for _ in range(2))
    crc = [np.array([zlib.crc32(x) for x in s], np.uint32) for s in (a, b)]
    got = spelling.crc_shift(crc[0], np.array([len(x) for x in b])) ^ crc[1]
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


@pytest.mark.parametrize("every,part", [(97, 100_000), (2, 40), (0, 7)])
def test_spelling_equals_brute_force(spark, documents, every, part):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    n = brute_counts(rows, every)
    counted = {r.word: r.n for r in spelling.word_counts(documents, change_every=every, chunk_bytes=20_000).collect()}
    assert counted == n
    got = {tuple(r) for r in spelling.spelling_variants(documents, every, 20_000, part).collect()}
    assert got == brute_groups(n)


def test_spelling_of_odd_words(spark):
    rng = random.Random(7)
    words = {"".join(rng.choice("abé÷") for _ in range(rng.randrange(1, 9))): rng.randrange(1, 200) for _ in range(700)}
    words |= {"a" * k: 2 ** (k % 20) for k in range(1, 60)} | {"x" * 4000: 5, "x" * 3999 + "y": 11, "x" * 4001: 40}
    df = spark.createDataFrame([(w, n, 0, "f") for w, n in words.items()] + [(None, 3, 0, "f"), ("", 4, 0, "f"), ("nocount", None, 0, "f")],
                               "word string, n long, id int, form string")
    for part in (30, 100_000):
        assert {tuple(r) for r in spelling.group_spellings(df, part_words=part).collect()} == brute_groups(words)
    assert spelling.group_spellings(df.where("n < 0")).collect() == []


def test_spelling_of_odd_texts(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in spelling.spelling_variants(docs, 3).collect()} == brute_groups(brute_counts(rows, 3))
    assert spelling.spelling_variants(docs.where("doc_id < 0")).collect() == []


def test_each_dictionary_pair_holds_no_more_words_than_letters(spark):
    words = [(f"wor{c}d", 3) for c in "abcdefghijklmnopqrstuvwxyz"] + [("word", 90)]
    df = spark.createDataFrame(words, "word string, n long")
    got = {r.word: r for r in spelling.group_spellings(df).collect()}
    assert got["word"].n_near == 26 and got["word"].form is None
    assert all(r.form == "word" and r.n_near == 26 for w, r in got.items() if w != "word")
