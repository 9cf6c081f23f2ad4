"""Main text of web pages: a recurrent block labeller over leaf sequences."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import Shared, lowest_hashes

PATH_DIMS, WORD_DIMS, SIZE_DIMS = 64, 16, 4
DIMS = PATH_DIMS + WORD_DIMS + SIZE_DIMS
HIDDEN = 16
SAMPLE_PAGES = 300
TRAIN_BLOCKS = 256           # training cuts a page into stretches of at most this many blocks; labelling reads pages in one
TRAIN_STRETCHES = 8          # and takes at most so many of a page, from its first to its last
# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style noscript template iframe svg math object canvas head title select option datalist".split())
HEAD_PARTS = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol p pre section table ul".split())
# Words in element names, classes and ids that mark furniture.
FURNITURE = frozenset("""nav navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget
widgets ad ads advert adverts advertisement advertisements banner banners sponsor sponsored promo promos promotion notice notices
cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login form forms comment comments
reply replies respond disqus related recommended share sharing social toolbar pagination pager copyright legal disclaimer
tags skip search dialog""".split())

# Elements that end an open svg or math element, and the parts of these that hold HTML again.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
                     "ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HTML_INSIDE = frozenset("foreignobject desc annotation-xml".split())

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![A-Za-z])[^>]*(?:>|\Z)"
                    r"|<(/?)([A-Za-z][^ \t\n\f\r/>]*)", re.S)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "iframe", "template", "textarea", "title")}
# The attributes of most tags hold no doubt: names, and values in quotes without angle brackets.
_PLAIN = re.compile(r"""((?:[ \t\n\f\r]++[A-Za-z][\w:.-]*+(?:="[^"<>]*+"|='[^'<>]*+'|=[\w:.#%+-]++(?=[ \t\n\f\r>]))?+)*+[ \t\n\f\r]*+/?+)>""", re.A)
_ATTR = re.compile(r"""[ \t\n\f\r]([A-Za-z][\w:.-]*)(?:=(?:"([^"]*)"|'([^']*)'|([\w:.#%+-]+)))?""", re.A)
_GAP = re.compile(r"[ \t\n\f\r/]*")
_KEY = re.compile(r"=?[^ \t\n\f\r/>=]*")
_EQUALS = re.compile(r"[ \t\n\f\r]*=[ \t\n\f\r]*")
_BARE = re.compile(r"[^ \t\n\f\r>]*")
_SHOWN_KEYS = frozenset("class id role hidden aria-hidden".split())
_NAMES = re.compile(r"[A-Za-z]+")


class _Tags:
    """Attributes of one page's tags.  A value ends where its own quote or, if
    it has none, white space or the tag ends.  A quote that never ends counts
    as a part of a value without quotes, so that the text behind it is kept."""

    def __init__(self, page: str):
        self.page, self.last = page, {q: page.rfind(q) for q in "\"'"}

    def read(self, at: int) -> tuple[list[tuple[str, str]], bool, int]:
        """(attributes, self-closed, end of the tag) from behind the tag's name."""
        m = _PLAIN.match(self.page, at)
        if m:
            found = [(k.lower(), a or b or c) for k, a, b, c in _ATTR.findall(m[1])] if len(m[1]) > 1 else []
            return found, m[1].endswith("/"), m.end()
        page, n, out = self.page, len(self.page), []
        while True:
            gap = at
            at = _GAP.match(page, at).end()
            if at >= n:
                return out, False, n
            if page[at] == ">":
                return out, page[at - 1] == "/" and at > gap, at + 1
            key = _KEY.match(page, at)
            at = key.end()
            value, equals = "", _EQUALS.match(page, at)
            if equals:
                at = equals.end()
                quote = page[at:at + 1]
                if quote in self.last and self.last[quote] > at:
                    end = page.index(quote, at + 1)
                    value, at = page[at + 1:end], end + 1
                else:
                    m = _BARE.match(page, at)
                    value, at = m[0], m.end()
            out.append((key[0].lower(), value))


def leaf_blocks(page: str | None) -> list[tuple[tuple[str, ...], str]]:
    """Leaf blocks of a page in order: (tag path, text).

    A block is the text between two block-level tags or line breaks; inline
    tags do not part it.  The path lists the open elements, each as its name
    and, after a dot, the words of its class, id and role.  Scripts, styles
    and other hidden elements hold no blocks; unclosed elements are closed by
    their parents' ends, a head also by text or the first element that is no
    part of a head, svg and math by an HTML element that cannot stand in them.
    Self-closed svg and math elements are empty."""
    out: list[tuple[tuple[str, ...], str]] = []
    if not page:
        return out
    stack: list[tuple[str, str]] = []
    buf: list[str] = []
    hidden = 0
    tags = _Tags(page)

    def flush():
        if buf:
            text = " ".join(_html.unescape("".join(buf)).split())
            buf.clear()
            if text:
                out.append((tuple(label for _, label in stack), text))

    def close(k: int):
        nonlocal hidden
        while len(stack) > k:
            hidden -= stack.pop()[0] in HIDDEN_TAGS
    at = 0
    while True:
        m = _TOKEN.search(page, at)
        between = page[at:m.start() if m else len(page)]
        if stack and stack[-1][0] == "head" and between.strip():
            close(len(stack) - 1)              # text is no part of a head
        if not hidden:
            buf.append(between)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and not hidden:
                buf.append(_html.escape(m[0][9:-3]))
            continue
        name = m[2].lower()
        attributes, self_closed, at = tags.read(at)
        inline = name in INLINE
        if not inline:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if inline and any(n not in INLINE for n, _ in stack[k + 1:]):
                        break
                    close(k)
                    break
                if name in CLOSES_P and stack[k][0] in ("body", "html"):
                    break
            continue
        if stack and stack[-1][0] == "head" and name not in HEAD_PARTS:
            close(len(stack) - 1)
        if hidden and name in BREAKOUT:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in HTML_INSIDE:
                    break
                if stack[k][0] in ("svg", "math"):
                    close(k)
                    break
        if name == "br" or name in VOID:
            continue
        if name in CLOSES_P and any(n == "p" for n, _ in stack):
            k = max(i for i, (n, _) in enumerate(stack) if n == "p")
            if all(n in INLINE for n, _ in stack[k + 1:]):
                close(k)
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        if self_closed and (name not in HIDDEN_TAGS or name in ("svg", "math")):
            continue
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            if name in HIDDEN_TAGS or name == "textarea":
                at = end.end() if end else len(page)
                continue
        words, unseen = [], False
        for key, value in attributes:
            if key == "hidden" or key == "aria-hidden" and "true" in value:
                unseen = True
            elif key in _SHOWN_KEYS:
                words += _NAMES.findall(value.lower())
        label = name + "".join("." + w for w in sorted(set(words)))
        stack.append((name, label + (".hidden" if unseen else "")))
        hidden += name in HIDDEN_TAGS
    flush()
    return out


def _bucket(text: str, seed: int) -> int:
    from xxhash import xxh64_intdigest
    return xxh64_intdigest(text.encode("utf-8", "replace"), seed)


class Features(dict):
    """Hashed vectors of tag paths and words, remembered while they are few."""

    def __missing__(self, key):
        if len(self) > 200_000:
            self.clear()
        if isinstance(key, tuple):
            v = np.zeros(PATH_DIMS, np.float32)
            for label in key:
                for k, part in enumerate(label.split(".")):
                    h, n = _bucket(part, 5), 2 if k else 1      # class and id words say more than names
                    v[h % PATH_DIMS] += n if h >> 40 & 1 else -n
                    v[(h >> 20) % PATH_DIMS] += n if h >> 41 & 1 else -n
        else:
            h = _bucket(key, 6)
            v = (h % WORD_DIMS, 1.0 if h >> 40 & 1 else -1.0)
        self[key] = v
        return v


def page_features(blocks: list[tuple[tuple[str, ...], str]], table: Features) -> np.ndarray:
    """One row per block: tag-path vector, hashed words, sizes."""
    x = np.zeros((len(blocks), DIMS), np.float32)
    for k, (path, text) in enumerate(blocks):
        x[k, :PATH_DIMS] = table[path]
        words = text.split(" ")
        got = [table[w] for w in words]
        v = np.bincount([g[0] for g in got], [g[1] for g in got], WORD_DIMS)
        x[k, PATH_DIMS:PATH_DIMS + WORD_DIMS] = v / np.sqrt(len(got))
        n = len(words)
        x[k, -SIZE_DIMS:] = (np.log1p(n) / 5, min(1.0, len(text) / n / 20), (k + 1) / len(blocks), 1.0 / len(blocks))
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM over the blocks of a page and a logistic output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["W" + d] = rng.normal(0, 1 / np.sqrt(DIMS + HIDDEN), (DIMS + HIDDEN, 4 * HIDDEN))
            self.p["b" + d] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])
        self.p["V"] = rng.normal(0, 1 / np.sqrt(2 * HIDDEN), 2 * HIDDEN)
        self.p["c"] = np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, page, HIDDEN); a masked step leaves the state."""
        t, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out = np.zeros((t, n, HIDDEN))
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            xh = np.concatenate([x[k], h], axis=1)
            z = xh @ self.p["W" + d] + self.p["b" + d]
            s = _sigmoid(z[:, :3 * HIDDEN])
            f, i, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[k][:, None]
            c2 = f * c + i * g
            th = np.tanh(c2)
            if keep is not None:
                keep.append((k, xh, f, i, o, g, c, th, m))
            c = m * c2 + (1 - m) * c
            h = m * o * th + (1 - m) * h
            out[k] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hid = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], axis=2)
        return _sigmoid(hid @ self.p["V"] + self.p["c"])

    def gradients(self, x, mask, y):
        """Gradients of the mean cross-entropy by back-propagation through time."""
        tapes = {"f": [], "b": []}
        hid = np.concatenate([self._run(x, mask, d, tapes[d]) for d in "fb"], axis=2)
        e = (_sigmoid(hid @ self.p["V"] + self.p["c"]) - y) * mask / mask.sum()
        g = {"V": np.einsum("tn,tnh->h", e, hid), "c": np.array([e.sum()])}
        for at, d in enumerate("fb"):
            up = e[:, :, None] * self.p["V"][at * HIDDEN:(at + 1) * HIDDEN]
            gw, gb = np.zeros_like(self.p["W" + d]), np.zeros_like(self.p["b" + d])
            dh = dc = np.zeros((x.shape[1], HIDDEN))
            for k, xh, f, i, o, cand, c, th, m in reversed(tapes[d]):
                dh = dh + up[k]
                do = dh * th * m
                dct = dc * m + dh * m * o * (1 - th * th)
                z = np.concatenate([dct * c * f * (1 - f), dct * cand * i * (1 - i), do * o * (1 - o), dct * i * (1 - cand * cand)], axis=1)
                gw += xh.T @ z
                gb += z.sum(0)
                dh = (z @ self.p["W" + d].T)[:, DIMS:] + dh * (1 - m)
                dc = dct * f + dc * (1 - m)
            g["W" + d], g["b" + d] = gw, gb
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 20, size: int = 16, step: float = 0.02, seed: int = 4):
        """Adam over batches of pages of similar length."""
        rng = np.random.default_rng(seed)
        pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        starts = np.arange(0, len(pages), size)
        for _ in range(epochs):
            for a in rng.permutation(starts):
                x, mask, y = pad([p[0] for p in pages[a:a + size]], [p[1] for p in pages[a:a + size]])
                t += 1
                for k, g in self.gradients(x, mask, y).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - step * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def label(self, pages: list[np.ndarray], size: int = 64) -> list[np.ndarray]:
        """Content or not, for every block of every page."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            n = max(1, min(size, 200_000 // max(1, len(pages[order[min(len(order) - 1, at + size - 1)]]))))
            group = order[at:at + n]
            x, mask, _ = pad([pages[k] for k in group])
            s = self.scores(x, mask)
            for i, k in enumerate(group):
                out[k] = s[:len(pages[k]), i] >= 0.5
            at += n
        return out


def pad(xs: list[np.ndarray], ys: list[np.ndarray] | None = None):
    t = max(len(x) for x in xs)
    x, mask, y = np.zeros((t, len(xs), DIMS)), np.zeros((t, len(xs))), np.zeros((t, len(xs)))
    for k, v in enumerate(xs):
        x[:len(v), k] = v
        mask[:len(v), k] = 1
        if ys is not None:
            y[:len(v), k] = ys[k]
    return x, mask, y


def weak_labels(blocks: list[tuple[tuple[str, ...], str]]) -> np.ndarray:
    """Training labels from the pages' own markup: a block is content unless an
    open element's name, class or id marks furniture, or the page has an
    article or main element and the block lies outside."""
    inside = any(p.split(".")[0] in ("article", "main") for path, _ in blocks for p in path)
    out = np.zeros(len(blocks))
    for k, (path, _) in enumerate(blocks):
        names = [p.split(".") for p in path]
        body = [i for i, n in enumerate(names) if n[0] in ("article", "main")]
        furniture = any(FURNITURE.intersection(n) and not (n[0] == "header" and body and body[0] < i) for i, n in enumerate(names))
        named = any(n[0] not in ("html", "body", "div") or {"content", "post", "entry", "story"}.intersection(n) for n in names)
        out[k] = not furniture and (bool(body) or not inside) and named
    return out


# Furniture that training puts into pages: (path below body, words).
_INSERTS = [(("header.masthead", "div"), 4), (("header", "h1"), 3), (("header", "p"), 5), (("aside.sidebar", "p"), 14), (("aside", "p"), 9),
            (("aside", "h3"), 3), (("div.sidebar.widget", "ul", "li"), 3),
            (("div.cookie.notice", "p"), 12), (("div.notice", "p"), 10), (("div.banner", "p"), 6), (("div.advert", "p"), 9), (("div.ad",), 8),
            (("div.ads", "div"), 7), (("form.newsletter.signup", "label"), 4), (("form", "button"), 1), (("section.comments", "div.comment", "p"), 18), (("section.comments", "article.comment", "p"), 16),
            (("div.comments", "ul", "li"), 15), (("section.comments", "h2"), 2), (("div.related", "ul", "li"), 6), (("div.share.social", "a"), 1),
            (("footer", "p"), 8), (("nav.breadcrumb", "ol", "li", "a"), 1), (("div.menu", "ul", "li", "a"), 1), (("div.promo", "p"), 10)]
_CONTENT = ["p", "div", "p.lead", "h2", "h3", "blockquote", "li", "pre", "td"]
_HOLDERS = [("article",), ("main",), ("main", "article"), ("main", "div.content"), ("div.content",), ("div.post.entry",),
            ("div.wrapper", "article.post"), ("section.story",), ("div.page", "main.content")]


def varied(blocks: list, rng: np.random.Generator) -> list:
    """A page with furniture put in at random places, also inside the article,
    with words of the page itself, with another holder of the article and with
    some paragraphs as other elements."""
    words = [w for _, t in blocks[:40] for w in t.split(" ")[:50]]
    out = list(blocks)
    holder = _HOLDERS[rng.integers(len(_HOLDERS))] if rng.random() < 0.7 else ("article",)
    plain = float(rng.choice([0.1, 0.3, 0.8]))
    for k in range(len(out)):
        path, text = out[k]
        if "article" in path:
            at = path.index("article")
            path = out[k][0][:at] + holder + out[k][0][at + 1:]
            out[k] = (path, text)
        if path and path[-1] == "p" and rng.random() < plain:
            tag = _CONTENT[rng.integers(len(_CONTENT))]
            lead = {"li": ("ul", "li"), "td": ("table", "tr", "td")}.get(tag, (tag,))
            out[k] = ((*path[:-1], *lead), text)
    for _ in range(rng.integers(2, 9)):
        path, n = _INSERTS[rng.integers(len(_INSERTS))]
        at = int(rng.integers(len(out) + 1))
        near = out[min(at, len(out) - 1)][0]
        stem = ("html", "body")
        if holder[-1] in near and rng.random() < 0.5:
            stem = near[:near.index(holder[-1]) + 1]
        for _ in range(int(rng.integers(1, 4))):
            i = int(rng.integers(max(1, len(words))))
            out.insert(at, ((*stem, *path), " ".join(words[i:i + 1 + int(rng.integers(1, 2 * n + 1))]) or "more"))
    return out


def stretches(n: int) -> list[slice]:
    """Even parts of a page of ``n`` blocks, of at most ``TRAIN_BLOCKS`` blocks; of more than
    ``TRAIN_STRETCHES`` of them as many, evenly spread, the first and last among them."""
    parts = max(1, -(-n // TRAIN_BLOCKS))
    cuts = [n * k // parts for k in range(parts + 1)]
    take = range(parts) if parts <= TRAIN_STRETCHES else [k * (parts - 1) // (TRAIN_STRETCHES - 1) for k in range(TRAIN_STRETCHES)]
    return [slice(cuts[k], cuts[k + 1]) for k in take]


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> BlockLabeller:
    """Fit on at most ``sample_pages`` different pages, those with the lowest
    hashes, and four varied copies of each; only feature rows reach the
    driver, of at most ``TRAIN_STRETCHES`` stretches a copy."""
    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa
        table = Features()
        for b in batches:
            for page in b.column(0):
                blocks = leaf_blocks(page.as_py())
                if not blocks:
                    continue
                xs, ys = [], []
                rng = np.random.default_rng(_bucket(blocks[-1][1], 9))
                for version in (blocks, *(varied(blocks, rng) for _ in range(4))):
                    x, y = page_features(version, table), weak_labels(version).astype(np.float32)
                    for part in stretches(len(x)):
                        xs.append(x[part].tobytes())
                        ys.append(y[part].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], ["x", "y"])
    sample = lowest_hashes(pages.select("page_id", "url", "html"), sample_pages)
    rows = sample.select("html").mapInArrow(features, "x binary, y binary").collect()
    rows.sort(key=lambda r: (len(r.x), bytes(r.x)))
    return BlockLabeller().fit([(np.frombuffer(r.x, np.float32).reshape(-1, DIMS), np.frombuffer(r.y, np.float32)) for r in rows])


def main_text(pages: list, model: BlockLabeller, table: Features | None = None) -> list[str]:
    table = Features() if table is None else table
    blocks = [leaf_blocks(p) for p in pages]
    kept = model.label([page_features(b, table) for b in blocks])
    return [" ".join(t for (_, t), ok in zip(b, k) if ok) for b, k in zip(blocks, kept)]


def extract_pages(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, url, text (the
    main text, empty if none), n_chars.

    Null and empty html has no text; whole pages are read however long; null
    or repeated page_ids and repeated rows keep their rows; an empty table
    gives no rows; other columns are ignored."""
    pages = pages.select("page_id", "url", "html")
    bc = Shared(pages.sparkSession, train(pages, sample_pages))

    def run(batches):
        import pyarrow as pa
        table = Features()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                text = main_text(part.column(2).to_pylist(), bc.value, table)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])
    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
