"""Fixed public tokenizers over columns of texts, one encoding per distinct unit.

A text is cut before every space that follows a character which is surely not
white space.  Neither tokenizer has a token across such a place: the
byte-level pre-tokenizer joins a space to what follows it, and no piece of the
piece vocabulary holds a space inside.  So a text's tokens are its units'
tokens one after the other, and a chunk of texts encodes each distinct unit
once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 16_000_000   # text encoded at a time
ROW_BYTES = 32             # a row's weight beside its text
BLOCK_BYTES = 4_000        # units encoded in one call
SPACE, MARK = b" ", "▁"


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer's file; every worker has it there."""
    import public_tokenizers
    return public_tokenizers.path(name)


def text_chunks(batches: Iterator, column: int, limit: int = CHUNK_BYTES) -> Iterator:
    """Arrow batches dealt anew into tables of about ``limit`` bytes of text;
    a text is never cut, a longer one stands alone with what came before."""
    import pyarrow as pa
    import pyarrow.compute as pc
    held, size = [], 0
    for batch in batches:
        lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lens.astype(np.int64) + ROW_BYTES)
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = min(int(np.searchsorted(ends, base + limit - size)) + 1, batch.num_rows)
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1]) - base
            at = to
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def cut_units(texts, lead: bool = False):
    """Units of a string array: (code of each unit in order, per text the place
    of its first unit and one end, the distinct units as bytes).  ``lead``
    puts a space before every text that is not empty; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc
    col = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if lead:
        space, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
        col = pc.if_else(pc.equal(pc.binary_length(col), 0), none, pc.binary_join_element_wise(space, col, none))
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    p = np.flatnonzero(data == 0x20)
    p = p[p > 0]
    q = data[p - 1]
    sure = (q >= 0x21) & (q <= 0x7E)
    tail = (q >= 0x80) & (q < 0xC0)
    two, three = data[np.maximum(p - 2, 0)], data[np.maximum(p - 3, 0)]
    sure |= tail & (two >= 0xC3) & (two <= 0xDF)
    sure |= tail & (two >= 0x80) & (two < 0xC0) & (three >= 0xE4) & (three <= 0xED)
    begins = np.zeros(len(data), bool)
    begins[p[sure]] = True
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    bounds = np.append(starts, offsets[-1]).astype(np.int64)
    units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), raw if raw is not None else pa.py_buffer(b"")])
    coded = units.dictionary_encode()
    return (coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, offsets),
            coded.dictionary.to_pylist())


def gather(ptr: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the items of the picked lists, in order, and each list's length."""
    size = ptr[pick + 1] - ptr[pick]
    before = np.cumsum(size) - size
    return np.repeat(ptr[pick] - before, size) + np.arange(int(size.sum())), size


def joined(units: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of units to encode in one call.  Units may stand one after the
    other as long as only the last one ends in what may be white space and
    all but the first start with a space."""
    at, size = 0, 0
    for k, u in enumerate(units):
        if u[0] != 0x20 and at < k:
            yield at, k
            at, size = k, 0
        size += len(u)
        if size >= BLOCK_BYTES or not (0x21 <= u[-1] <= 0x7E or (u[-1] >= 0x80 and 0xC3 <= u[-2] <= 0xDF)):
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(units):
        yield at, len(units)


class _Units:
    """Encodes distinct units: ids of all units in order, and where each
    unit's ids start (and one end)."""

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Units of settled characters first, so that others do not share a block with them."""
        order = sorted(range(len(units)), key=lambda k: bool(units[k].translate(None, SETTLED)))
        ptr, ids = self._encode([units[k] for k in order])
        back = np.empty(len(units), np.int64)
        back[order] = np.arange(len(units))
        place, size = gather(ptr, back)
        return np.concatenate([[0], np.cumsum(size)]).astype(np.int64), ids[place]

    def _encode(self, units):
        ranges = list(joined(units))
        blocks = [b"".join(units[s:e]) for s, e in ranges]
        found = [np.array(x, np.int64) for x in self.ids_of(blocks)]
        lost = [k for k, (x, b) in enumerate(zip(found, blocks)) if not self.gives_back(x, b)]
        if lost:
            return self._one_by_one(units, ranges, found, set(lost))
        ids = np.concatenate(found) if found else np.zeros(0, np.int64)
        ends = np.cumsum(self.lengths[ids])
        sizes = np.cumsum([len(u) for u in units])
        return np.concatenate([[0], np.searchsorted(ends, sizes, side="right")]).astype(np.int64), ids

    def _one_by_one(self, units, ranges, found, lost):
        """As ``_encode``; units of blocks whose bytes do not come back on their own."""
        ptr, ids = [np.zeros(1, np.int64)], []
        total = 0
        for k, (s, e) in enumerate(ranges):
            if k in lost:
                each = [np.array(x, np.int64) for x in self.ids_of(units[s:e])]
                ends = np.cumsum([len(x) for x in each])
                ids += each
            else:
                ends = np.searchsorted(np.cumsum(self.lengths[found[k]]), np.cumsum([len(u) for u in units[s:e]]), side="right")
                ids.append(found[k])
            ptr.append(total + ends)
            total += int(ends[-1])
        return np.concatenate(ptr).astype(np.int64), np.concatenate(ids)


# Bytes of characters up to U+027F without U+0080 to U+00BF: no other lead byte.
SETTLED = bytes([*range(0x80), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
# --- fixed values: the byte-level pre-tokenizer's pattern
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes stand
    for themselves, the others follow from U+0100 on."""
    own = {b for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(lo, hi + 1)}
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class ByteTokenizer(_Units):
    """Byte-level tokenizer of a ``tokenizers`` file.  ``plain`` reads the
    strings of special tokens inside texts as ordinary text.

    Where the file's ids follow its merges, units of settled characters are
    encoded from the same vocabulary as ranks, which gives the same ids in a
    third of the time; all other units, and those with the string of a special
    token, go through ``tokenizers``."""

    def __init__(self, path: str, plain: bool):
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.inner = Tokenizer.from_file(path)
        if plain:
            self.inner.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [] if plain else [t["content"].encode() for t in spec["added_tokens"]]
        letters = byte_letters()
        vocab = {bytes([letters[c] for c in entry]): i for entry, i in spec["model"]["vocab"].items()}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"].get(m, -1) for m in merges]
        level = spec["pre_tokenizer"] or {}
        self.fast = None
        if order == sorted(order) and len(set(order)) == len(order) and spec["normalizer"] is None and level.get("type") == "ByteLevel" \
                and not level.get("add_prefix_space") and level.get("use_regex"):
            import tiktoken
            self.fast = tiktoken.Encoding("ranks", pat_str=PRETOKENS, mergeable_ranks=vocab, special_tokens={})
        names = {**vocab, **{t["content"].encode(): t["id"] for t in spec["added_tokens"]}}
        self.lengths = np.zeros(max(names.values()) + 1, np.int64)
        for entry, i in names.items():
            self.lengths[i] = len(entry)

    def ids_of(self, blocks: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(blocks)
        for k, b in enumerate(blocks):
            if self.fast and not b.translate(None, SETTLED) and not any(s in b for s in self.special):
                out[k] = self.fast.encode_ordinary(b.decode("utf-8"))
        rest = [k for k, x in enumerate(out) if x is None]
        found = self.inner.encode_batch_fast([blocks[k].decode("utf-8") for k in rest], add_special_tokens=False)
        for k, e in zip(rest, found):
            out[k] = e.ids
        return out

    def gives_back(self, ids: np.ndarray, block: bytes) -> bool:
        return int(self.lengths[ids].sum()) == len(block)


class PieceTokenizer(_Units):
    """Piece tokenizer of a ``sentencepiece`` model, for units that start with
    a space: the model puts that space there itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.inner = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.inner.id_to_piece(i) for i in range(self.inner.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.inner.is_byte(i) else p.replace(MARK, " ").encode("utf-8")
                      for i, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def ids_of(self, blocks: list[bytes]) -> list[list[int]]:
        return self.inner.encode([b[1:].decode("utf-8") for b in blocks], num_threads=1)

    def gives_back(self, ids: np.ndarray, block: bytes) -> bool:
        return b"".join([self.bytes[i] for i in ids.tolist()]) == block
