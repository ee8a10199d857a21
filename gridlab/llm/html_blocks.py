"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks: the text between block-level tags, with the
path of open elements above it. Each block becomes a vector of its hashed path
(tags, classes, ids, roles), its hashed words, and a few shares (links, marks,
length, place, usual names in the path). A bidirectional LSTM in numpy reads the page's blocks in order
and labels every block with the whole page as context; the blocks labelled as
main text are joined in page order. Scripts, styles, comments and the head are
markup and never become blocks; a head without an end tag ends at the first
text or tag that may not stand in it.

The labeller is fitted here, in one task, on at most about ``sample`` pages
(documented bound; drawn by a hash of the html). Their weak labels come from
semantic containers (article, main), less what such a container holds of
menus, notices, adverts, forms and comments; pages without one are labelled by
length and links. Each sampled page is also varied: containers are renamed to
divisions with usual class names, and side bars, notices, adverts, forms,
headers and comments made of other pages' texts are put in, so that layouts
without semantic tags are learned too.

Defined cases: null and empty html give an empty text, as do pages without
blocks; a tag that does not close before the next one is text, and elements
beyond ``MAX_DEPTH`` open ones are read as siblings; cut references are read as
browsers do; equal pages give equal texts, and count once in the fit; long
pages are read whole in one pass; ties do not arise, as each block is judged by
itself; without pages to learn from, containers and lengths decide; of the
input's columns only page_id, url and html are read.
"""
from __future__ import annotations

import html as html_lib
import random
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import WHITE, mix64, rows_of, span_hashes, text_blocks, word_spans

SAMPLE = 300
PATH_DIMS = 256
WORD_DIMS = 64
SHARES = 10
HIDDEN = 16
EPOCHS = 8
BATCH = 32

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/><]*)")
_STOP = re.compile(r"[\"'<>]")
#: elements whose content is no text of the page (fixed values of HTML)
_RAW = frozenset("script style noscript template svg iframe textarea select object title".split())
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
#: open elements that a browser nests; deeper ones become siblings
MAX_DEPTH = 512
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[a-z]+")
#: elements that do not end a block (fixed values of HTML)
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
#: elements without content (fixed values of HTML)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements that may stand in a head; any other begins the body (fixed values of HTML)
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_MAIN = frozenset({"article", "main", "articlebody"})
_SIDE = frozenset("nav aside footer form menu sidebar comments comment ad ads advert advertisement sponsor promo notice "
                  "cookie consent newsletter subscribe related share social breadcrumb banner popup login search".split())


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    link_chars: int


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    names = [tag]
    if attributes:
        for _, value in _ATTRIBUTE.findall(attributes):
            names.extend(_NAME.findall(value.lower()))
    return tuple(names)


def _tag_end(page: str, at: int) -> tuple[int, bool]:
    """(where the tag's attributes end, whether by `>`), from ``at`` on. Quoted
    values may hold anything; a `<` outside them begins another tag; a quote
    without its partner is an ordinary character. No character is passed twice."""
    while m := _STOP.search(page, at):
        c = m.group()
        if c in "<>":
            return m.start(), c == ">"
        end = page.find(c, m.end())
        at = end + 1 if end >= 0 else m.end()
    return len(page), False


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, closing, attributes) of the tags in order, in one pass.
    Comments, declarations and whole elements without text of the page have the
    tag '' or '-' (the latter for elements)."""
    at = page.find("<")
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            if end < 0:
                return
            end += 1
            yield at, end, "", False, ""
        elif m := _TAG.match(page, at + 1):
            stop, closed = _tag_end(page, m.end())
            end = stop + closed
            tag = m.group(2).lower()
            if closed and tag in _RAW and not m.group(1):
                over = _RAW_END[tag].search(page, end)
                end = over.end() if over else len(page)
                yield at, end, "-", False, ""
            elif closed:
                yield at, end, tag, bool(m.group(1)), page[m.end():stop]
        else:
            end = at + 1
        at = page.find("<", end)


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks in page order. White space of a block is one space."""
    out: list[Block] = []
    if not page:
        return out
    open_tags: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    paths: dict[tuple[str, ...], tuple[str, ...]] = {}  # equal paths are kept once
    path: tuple[str, ...] | None = None  # of the open elements, None when they have changed
    links = links_open = 0

    def end_block() -> None:
        nonlocal links, path
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                if path is None:
                    path = tuple(n for _, names in open_tags for n in names)
                    path = paths.setdefault(path, path)
                out.append(Block(text, path, min(links, len(text))))
            parts.clear()
        links = 0

    def end_head() -> None:
        nonlocal path
        if open_tags and open_tags[-1][0] == "head":
            open_tags.pop()
            path = None

    def add(text: str) -> None:
        nonlocal links
        if text:
            if not text.isspace():
                end_head()
            parts.append(text)
            if links_open:
                links += len(text.strip())

    at = 0
    for start, end, tag, closing, attributes in tokens(page):
        add(page[at:start])
        at = end
        if tag in ("", "-"):
            if tag:
                parts.append(" ")
            continue
        if tag not in _HEAD and not closing:
            end_head()
        if closing:
            if tag == "a":
                links_open = 0
            if tag not in INLINE:
                end_block()
                for k in range(len(open_tags) - 1, -1, -1):
                    if open_tags[k][0] == tag:
                        del open_tags[k:]
                        path = None
                        break
        elif tag in INLINE:
            if tag == "a":
                links_open = 1
            elif tag in ("br", "img", "wbr"):
                parts.append(" ")
        else:
            end_block()
            links_open = 0
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and open_tags and open_tags[-1][0] == tag:
                open_tags.pop()  # closed by the next of its kind
                path = None
            if tag not in VOID and len(open_tags) < MAX_DEPTH and not attributes.rstrip().endswith("/"):
                open_tags.append((tag, _names(tag, attributes)))
                path = None
    add(page[at:])
    end_block()
    return out


def weak_labels(blocks: list[Block]) -> np.ndarray:
    inside = np.array([bool(_MAIN.intersection(b.path)) for b in blocks], bool)
    if not inside.any():
        inside = np.array([len(b.text.split()) >= 10 and 3 * b.link_chars < len(b.text) for b in blocks], bool)
    side = np.array([bool(_SIDE.intersection(b.path)) for b in blocks], bool)
    return inside & ~side


def features(blocks: list[Block], sizes: list[int]) -> np.ndarray:
    """One row a block; sizes: blocks of each page."""
    out = np.zeros((len(blocks), PATH_DIMS + WORD_DIMS + SHARES), np.float32)
    for i, b in enumerate(blocks):
        for name in b.path:
            out[i, zlib.crc32(name.encode()) % PATH_DIMS] = 1.0
        if b.path:
            out[i, zlib.crc32(b"last " + b.path[-1].encode()) % PATH_DIMS] = 1.0
    texts = pa.array([b.text for b in blocks], pa.large_string())
    shares = out[:, PATH_DIMS + WORD_DIMS:]
    for first, data, off in text_blocks(texts):
        starts, ends = word_spans(data, off, WHITE)
        own = rows_of(off, starts) + first
        bucket = (mix64(span_hashes(data, starts, ends)) % np.uint64(WORD_DIMS)).astype(np.int64)
        n = len(off) - 1
        counts = np.bincount((own - first) * WORD_DIMS + bucket, minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
        words = np.log1p(counts)
        out[first:first + n, PATH_DIMS:PATH_DIMS + WORD_DIMS] = words / np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-6)
        n_words = np.bincount(own - first, minlength=n)
        row = np.repeat(np.arange(n), np.diff(off))
        marks = np.bincount(row[np.isin(data, np.frombuffer(b".,;:!?", np.uint8))], minlength=n)
        upper = np.bincount(row[(data >= 65) & (data < 91)], minlength=n)
        size = np.maximum(np.diff(off), 1)
        shares[first:first + n, 0] = np.log1p(n_words) / 5
        shares[first:first + n, 1] = np.minimum(marks / np.maximum(n_words, 1), 2)
        shares[first:first + n, 2] = upper / size
    at = 0
    for n in sizes:
        place = np.arange(n) / max(n, 1)
        shares[at:at + n, 3], shares[at:at + n, 4] = place, 1 - place
        at += n
    shares[:, 5] = [b.link_chars / len(b.text) for b in blocks]
    shares[:, 6] = [b.text[-1] in ".!?…\"'”»)" for b in blocks]
    shares[:, 7] = [bool(_SIDE.intersection(b.path)) for b in blocks]
    shares[:, 8] = [bool(_MAIN.intersection(b.path)) for b in blocks]
    shares[:, 9] = 1.0
    return out


# ---- the network -----------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_weights(inputs: int, hidden: int = HIDDEN, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.RandomState(seed)
    w: dict[str, np.ndarray] = {}
    for d in "fb":
        w["W" + d] = (rng.randn(inputs, 4 * hidden) * 0.1).astype(np.float32)
        w["U" + d] = (rng.randn(hidden, 4 * hidden) * 0.2).astype(np.float32)
        w["b" + d] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden).astype(np.float32)
    w["V"] = (rng.randn(2 * hidden) * 0.2).astype(np.float32)
    w["v"] = np.zeros(1, np.float32)
    return w


def _run(z: np.ndarray, u: np.ndarray, trace: list | None) -> np.ndarray:
    """Hidden states (steps, batch, hidden) of one direction."""
    hidden = u.shape[0]
    h = np.zeros((z.shape[1], hidden), np.float32)
    c = np.zeros_like(h)
    out = np.empty((*z.shape[:2], hidden), np.float32)
    for t in range(len(z)):
        a = z[t] + h @ u
        gates = _sigmoid(a[:, :3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden:2 * hidden], gates[:, 2 * hidden:]
        g = np.tanh(a[:, 3 * hidden:])
        before, h_before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if trace is not None:
            trace.append((i, f, o, g, before, tc, h_before))
    return out


def _run_back(d_out: np.ndarray, u: np.ndarray, trace: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs z and of u."""
    hidden = u.shape[0]
    d_z = np.empty((*d_out.shape[:2], 4 * hidden), np.float32)
    d_u = np.zeros_like(u)
    d_h = np.zeros(d_out.shape[1:], np.float32)
    d_c = np.zeros_like(d_h)
    for t in range(len(d_out) - 1, -1, -1):
        i, f, o, g, before, tc, h_before = trace[t]
        d_h = d_h + d_out[t]
        d_c = d_c + d_h * o * (1 - tc * tc)
        d_a = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
        d_z[t] = d_a
        d_u += h_before.T @ d_a
        d_h = d_a @ u.T
        d_c = d_c * f
    return d_z, d_u


def _padded(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (steps, batch) of the pages' rows, forwards and backwards; the
    row behind the last stands for padding."""
    steps = int(sizes.max())
    first = np.cumsum(sizes) - sizes
    t = np.arange(steps)[:, None]
    live = t < sizes[None, :]
    return np.where(live, first + t, rows), np.where(live, first + sizes - 1 - t, rows)


def logits(w: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray, trace: dict | None = None) -> np.ndarray:
    """One number a block. x: rows of all pages; sizes: blocks of each."""
    n = len(x)
    out = np.full(n + 1, w["v"][0], np.float32)
    hidden = len(w["V"]) // 2
    for k, (d, place) in enumerate(zip("fb", _padded(n, sizes))):
        z = np.concatenate([x[a:a + 4096] @ w["W" + d] + w["b" + d] for a in range(0, n, 4096)] + [np.zeros((1, 4 * hidden), np.float32)])
        own: list | None = [] if trace is not None else None
        h = _run(z[place], w["U" + d], own)
        out[place] += h @ w["V"][k * hidden:(k + 1) * hidden]  # each row has one place but padding
        if trace is not None:
            trace[d] = (place, h, own)
    return out[:n]


def gradients(w: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean logistic loss of the blocks, and its gradients."""
    trace: dict = {}
    s = logits(w, x, sizes, trace)
    p = _sigmoid(s)
    loss = float(-np.mean(np.where(y > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
    d_s = np.append((p - y) / len(y), 0).astype(np.float32)
    hidden = len(w["V"]) // 2
    g = {"V": np.empty_like(w["V"]), "v": np.array([d_s.sum()], np.float32)}
    for k, d in enumerate("fb"):
        place, h, own = trace[d]
        d_out = d_s[place]
        v = w["V"][k * hidden:(k + 1) * hidden]
        g["V"][k * hidden:(k + 1) * hidden] = np.tensordot(d_out, h, 2)
        d_z, g["U" + d] = _run_back(d_out[:, :, None] * v, w["U" + d], own)
        flat = np.zeros((len(x) + 1, 4 * hidden), np.float32)
        flat[place] = d_z
        g["W" + d] = x.T @ flat[:-1]
        g["b" + d] = flat[:-1].sum(axis=0)
    return loss, g


def train(pages: list[tuple[list[Block], np.ndarray]], epochs: int = EPOCHS, seed: int = 5) -> dict[str, np.ndarray]:
    w = new_weights(PATH_DIMS + WORD_DIMS + SHARES)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    rng = np.random.RandomState(seed)
    ready = [(features(b, [len(b)]), y.astype(np.float32)) for b, y in pages if b]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(ready))
        for at in range(0, len(order), BATCH):
            part = sorted((ready[i] for i in order[at:at + BATCH]), key=lambda r: len(r[0]))
            x = np.concatenate([r[0] for r in part])
            hide = rng.rand(len(x), 1) < 0.15  # some blocks must be told from words and neighbours
            x = np.concatenate([np.where(hide, 0, x[:, :PATH_DIMS]), x[:, PATH_DIMS:]], axis=1)
            _, g = gradients(w, x, np.array([len(r[0]) for r in part]), np.concatenate([r[1] for r in part]))
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            for k in w:
                d = g[k] / max(1.0, norm)
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.99 * s[k] + 0.01 * d * d
                w[k] = w[k] - (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


# ---- variations of the sampled pages -----------------------------------------

_CONTENT = ("content", "post", "entry content", "article body", "story", "main text", "post content", "page body")
_EXTRAS = (
    ("before", ("header", "masthead"), 1, 6), ("before", ("div", "menu"), 1, 3), ("before", ("div", "navbar"), 1, 3),
    ("before", ("div", "breadcrumb"), 1, 4), ("before", ("div", "notice"), 5, 25), ("before", ("div", "cookie", "consent"), 6, 30),
    ("before", ("div", "banner", "ad"), 3, 20), ("inside", ("div", "ad"), 3, 20), ("inside", ("aside", "related"), 3, 20),
    ("inside", ("div", "advert"), 3, 20), ("inside", ("form", "newsletter"), 2, 12), ("inside", ("div", "share", "social"), 1, 4),
    ("after", ("div", "sidebar"), 3, 30), ("after", ("aside",), 3, 30), ("after", ("form",), 1, 10), ("after", ("form", "search"), 1, 5),
    ("after", ("section", "comments"), 5, 60), ("after", ("div", "comment"), 5, 60), ("after", ("div", "reply", "comments"), 5, 60),
    ("inside", ("section", "comments"), 5, 60), ("after", ("div", "footer"), 3, 20), ("after", ("footer",), 3, 20))


def varied(blocks: list[Block], y: np.ndarray, texts: list[str], rng: random.Random) -> tuple[list[Block], np.ndarray]:
    """A page of another layout with the same main text."""
    rename = {"article": rng.choice((("div", *rng.choice(_CONTENT).split()), ("main",), ("section", *rng.choice(_CONTENT).split()))),
              "main": ("div", *rng.choice(_CONTENT).split()), "nav": rng.choice((("div", "menu"), ("div", "nav"), ("nav",), ("div", "navigation"))),
              "footer": rng.choice((("div", "footer"), ("footer",), ("div", "copyright")))}
    own = [b._replace(path=tuple(n for name in b.path for n in rename.get(name, (name,)))) for b in blocks]
    labels = list(map(bool, y))
    positive = [i for i, v in enumerate(labels) if v]
    if not positive or not texts:
        return own, y
    base = tuple(own[positive[0]].path[:2])
    inner = tuple(own[positive[0]].path[:-1])
    for where, names, least, most in rng.sample(_EXTRAS, rng.randint(2, 6)):
        positive = [i for i, v in enumerate(labels) if v]
        at = {"before": positive[0], "after": positive[-1] + 1}.get(where)
        if at is None:
            at = rng.choice(positive[1:] or positive) if "comments" not in names else positive[-1] + 1
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(texts).split()
            k = rng.randint(0, max(0, len(words) - most))
            text = " ".join(words[k:k + rng.randint(least, most)]) or "menu"
            path = (inner if where == "inside" else base) + names + rng.choice(((), ("p",), ("ul", "li"), ("div",)))
            own.insert(at, Block(text, path, len(text) if rng.random() < 0.3 else 0))
            labels.insert(at, False)
    return own, np.array(labels)


def fit_pages(pages: list[str], seed: int = 9) -> dict[str, np.ndarray] | None:
    rng = random.Random(seed)
    read = [b for b in map(blocks_of, pages) if b]
    if not read:
        return None
    marked = [(b, weak_labels(b)) for b in read]
    texts = [b.text for own, _ in marked for b in own if len(b.text) > 40][:5000]
    return train([*marked, *(varied(b, y, texts, rng) for b, y in marked for _ in range(3))])


def _shapes() -> list[tuple[str, tuple[int, ...]]]:
    return [(k, v.shape) for k, v in new_weights(PATH_DIMS + WORD_DIMS + SHARES).items()]


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """The labeller's weights, fitted in one task from the drawn pages."""
    total = pages.where(F.length("html") > 0).count()
    share = min(1.0, sample / total) if total else 0.0
    drawn = pages.select("html").where(F.length("html") > 0).where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < share * 1_000_000).distinct()

    def run(table: pa.Table) -> pa.Table:
        w = fit_pages(sorted(set(table.column("html").to_pylist())))
        flat = np.concatenate([w[k].ravel() for k, _ in _shapes()]) if w else np.zeros(0)
        return pa.table({"w": pa.array([flat.tolist()], pa.list_(pa.float64()))})

    got = drawn.groupBy(F.lit(0).alias("one")).applyInArrow(run, "w array<double>").collect()
    if not got or not got[0]["w"]:
        return None
    flat, at, out = np.array(got[0]["w"], np.float32), 0, {}
    for k, shape in _shapes():
        n = int(np.prod(shape))
        out[k] = flat[at:at + n].reshape(shape)
        at += n
    return out


def extract_pages(w: dict[str, np.ndarray] | None, pages: list[str | None], batch: int = 64) -> list[str]:
    """The main text of each page."""
    read = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(read)) if read[i]), key=lambda i: len(read[i]))
    at = 0
    while at < len(order):
        part, total = [], 0
        while at < len(order) and len(part) < batch and (not part or total + len(read[order[at]]) <= 20_000):
            part.append(order[at])
            total += len(read[order[at]])
            at += 1
        if w is None:
            chosen = [weak_labels(read[i]) for i in part]
        else:
            sizes = [len(read[i]) for i in part]
            s = logits(w, features([b for i in part for b in read[i]], sizes), np.array(sizes)) > 0
            chosen = np.split(s, np.cumsum(sizes)[:-1])
        for i, keep in zip(part, chosen):
            out[i] = " ".join(b.text for b, k in zip(read[i], keep) if k)
    return out


def extractor(spark, w: dict[str, np.ndarray] | None):
    """A column function from html to main text."""
    shared = spark.sparkContext.broadcast(w)

    @F.arrow_udf("string")
    def extract(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in parts:
            out: list[str] = []
            for at in range(0, len(pages), 256):
                out.extend(extract_pages(shared.value, pages.slice(at, 256).to_pylist()))
            yield pa.array(out, pa.string())
    return extract


def main_texts(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    extract = extractor(pages.sparkSession, fit(pages, sample))
    return pages.select("page_id", "url", extract("html").alias("text")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
