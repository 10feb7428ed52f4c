"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of open tags (and their classes, ids
and roles) above it.  Path and words are hashed into vectors; a bidirectional LSTM in numpy reads the whole sequence and says
for each block whether it belongs to the article, knowing all that stands before and after.  It is trained on pages that a
generator here makes up, with every kind of boilerplate in many spellings, so no page's words are learned by heart.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import lean, only, tune

PATH_DIM, WORD_DIM, OWN_DIM, HIDDEN = 96, 16, 6, 20
TRAIN_PAGES, EPOCHS, BATCH = 500, 10, 20
#: Padded blocks in one batch of pages.
CELLS = 60_000
#: Blocks that are read as one sequence, and how many of their neighbours are read with them.  Only pages of more blocks are cut.
WINDOW, MARGIN = 4096, 512
#: Elements of a path that are looked at, the innermost ones.
DEPTH = 64

#: Elements that do not break a line, that hold no text, and that have no end tag.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style noscript template iframe svg math object head textarea select option button canvas audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of these is closed by a new one of its group.
CLOSERS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "button": {"button"}}
NO_P_INSIDE = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: What may stand in a head; elements that hold phrases only; elements whose content is no markup.
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
PHRASING = frozenset("audio button canvas map option select video".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())

# Possessive throughout: no character is read twice by one of them.  A quoted value ends before a space, a slash or the tag's end;
# where it does not, the quotes are unbalanced and mean nothing.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>]))|[^>])*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z]+")
_ENDS = re.compile(r"</([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"<(?=[a-zA-Z/!?])")


def tags(page: str) -> Iterator[tuple[str, bool, str] | str]:
    """Text, and (name, whether it is an end, attributes) of tags, in page order and in linear time.

    Comments, declarations and what is inside RAW elements are left out.  An unfinished comment or declaration reaches to the
    end of the page; a raw element without an end tag reaches to the next tag.  Once a tag has no end because of its quotes, quotes
    mean nothing in the rest of the page; a tag without any end is text.
    """
    last: dict[str, int] = {m[1].lower(): m.start() for m in _ENDS.finditer(page)}
    at, n, tag = 0, len(page), _TAG
    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            yield page[at:]
            return
        if mark > at:
            yield page[at:mark]
        at = mark
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else n
            continue
        if not _MARK.match(page, at):
            yield "<"
            at += 1
            continue
        m = tag.match(page, at)
        if m is None and tag is _TAG and page.find(">", at) >= 0 and page[at + 1 : at + 2] != "/":
            tag = _PLAIN_TAG
            m = tag.match(page, at)
        if m is None:
            if page.find(">", at) < 0:
                yield page[at:]
                return
            yield "<"  # an end without a name
            at += 1
            continue
        at, name = m.end(), m[2].lower()
        if name in RAW and not m[1]:
            if last.get(name, -1) >= at:
                stop = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
                at = stop.start() if stop else at
            else:
                stop = _MARK.search(page, at)
                at = stop.start() if stop else n
            continue
        yield name, bool(m[1]), m[3]


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of its characters inside links) of every leaf block, in page order.

    A head without an end tag ends where something stands that no head has; elements that hold phrases only (buttons, lists of
    options) end where a block begins; silent elements that are never ended are not silent.
    """
    out: list[tuple[tuple[str, ...], str, float]] = []
    ends_left: dict[str, int] = {}
    for m in _ENDS.finditer(page):
        ends_left[m[1].lower()] = ends_left.get(m[1].lower(), 0) + 1
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: dict[str, int] = {}
    parts: list[str] = []
    path: tuple[str, ...] | None = None
    links, silent, linked = 0, 0, 0

    def close() -> None:
        nonlocal linked, path
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                if path is None:
                    path = tuple(w for _, ws in stack[-DEPTH:] for w in ws)
                out.append((path, text, min(1.0, linked / max(1, len(text)))))
            parts.clear()
        linked = 0

    def pop() -> str:
        nonlocal silent, path
        name, _ = stack.pop()
        opened[name] -= 1
        silent -= name in SILENT
        path = None
        return name

    for token in tags(page):
        if isinstance(token, str):
            if silent and stack[-1][0] == "head" and token.strip():
                pop()  # text ends a head, too
            if not silent:
                parts.append(token)
                if links:
                    linked += len(token)
            continue
        name, ending, attributes = token
        if ending:
            ends_left[name] = ends_left.get(name, 1) - 1
        if name in INLINE:
            if name == "br" and not silent:
                parts.append(" ")
            elif name == "a":
                links = max(0, links - 1) if ending else links + 1
            continue
        close()
        if ending:
            if opened.get(name):
                while pop() != name:
                    pass
                links = 0
            continue
        if opened.get("head") and name not in IN_HEAD:
            while pop() != "head":
                pass
        if name in NO_P_INSIDE:
            if stack and stack[-1][0] == "p":
                pop()
            while name != "div" and stack and stack[-1][0] in PHRASING:
                pop()
        while stack and stack[-1][0] in CLOSERS.get(name, ()):
            pop()
        if name in VOID or attributes.endswith("/") and name not in NO_P_INSIDE:
            continue
        if name in SILENT and name != "head" and ends_left.get(name, 0) <= 0:
            continue
        words = [name, *(w for _, v in _ATTR.findall(attributes[:4096]) for w in _PART.findall(v.lower()))] if attributes else [name]
        stack.append((name, tuple(words)))
        opened[name] = opened.get(name, 0) + 1
        silent += name in SILENT
        path = None
    close()
    return out


@lru_cache(maxsize=100_000)
def _slot(word: str) -> tuple[int, float]:
    h = int(textvec.span_keys(np.frombuffer(word.encode(), dtype=np.uint8), np.array([0]), np.array([len(word.encode())]))[0])
    return h % PATH_DIM, 1.0 if h >> 40 & 1 else -1.0


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Signed hashes of the path's words; each word once, the last ones again."""
    v = np.zeros(PATH_DIM + 1, dtype=np.float32)
    for w in dict.fromkeys(path):
        k, sign = _slot(w)
        v[k] += sign
    for w in path[-2:]:
        k, sign = _slot(w + "$")
        v[k] += sign
    v[PATH_DIM] = len(path) / 10
    return v


def vectors(pages: list[list[tuple]], places: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """A row for each block of each page: hashed path, hashed words, and plain measures of the block.

    ``places``: where the blocks stand in their page, from 0 to 1, if ``pages`` are parts of pages.
    """
    flat = [b for page in pages for b in page]
    if not flat:
        return [np.zeros((0, PATH_DIM + 1 + WORD_DIM + OWN_DIM), dtype=np.float32) for _ in pages]
    texts = pa.array([b[1] for b in flat], pa.string())
    _, _, keys, counts = textvec.words(*textvec.raw(texts))
    owner = np.repeat(np.arange(len(flat)), counts)
    words = np.zeros((len(flat), WORD_DIM), dtype=np.float32)
    slot = (keys % np.uint64(WORD_DIM)).astype(np.int64)
    sign = np.where(keys >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    words += np.bincount(owner * WORD_DIM + slot, sign, len(flat) * WORD_DIM).reshape(-1, WORD_DIM)
    words /= np.sqrt(np.maximum(counts, 1))[:, None]
    paths = np.stack([_path_vector(b[0]) for b in flat])
    n = np.cumsum([len(p) for p in pages])
    place = np.concatenate(places or [np.arange(len(p)) / max(1, len(p) - 1) for p in pages])
    own = np.column_stack([np.log1p(counts) / 4, [b[2] for b in flat], place, [b[1][-1] in ".!?…»”\"" for b in flat], [len(b[1]) / 500 if len(b[1]) < 1000 else 2 for b in flat], [any(c.isdigit() for c in b[1]) for b in flat]]).astype(np.float32)
    whole = np.hstack([paths, words, own]).astype(np.float32)
    return np.split(whole, n[:-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Labeller:
    """Weights of two LSTMs (forwards, backwards) and of the layer that reads both."""

    w: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.w, *self.u, *self.b, self.out, self.bias]

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Margins of padded pages ``x`` (page, block, feature); with ``keep`` also what training needs."""
        n, t, _ = x.shape
        states, memory = [], []
        for d in (0, 1):
            z = x @ self.w[d] + self.b[d]
            h = np.zeros((n, HIDDEN), dtype=np.float32)
            c = np.zeros_like(h)
            hs = np.zeros((n, t, HIDDEN), dtype=np.float32)
            kept = []
            for k in range(t) if d == 0 else range(t - 1, -1, -1):
                a = z[:, k] + h @ self.u[d]
                i, f, o = (_sigmoid(a[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
                g = np.tanh(a[:, 3 * HIDDEN :])
                m = mask[:, k, None]
                c_new = f * c + i * g
                th = np.tanh(c_new)
                if keep:
                    kept.append((k, h, c, i, f, o, g, th, m))
                c = np.where(m, c_new, c)
                h = np.where(m, o * th, h)
                hs[:, k] = h
            states.append(hs)
            memory.append(kept)
        both = np.concatenate(states, axis=2)
        return both @ self.out + self.bias, both, memory

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        margin, both, memory = self.run(x, mask, keep=True)
        e = np.where(mask, _sigmoid(margin[..., 0]) - y, 0)[..., None].astype(np.float32) / mask.sum()
        d_out, d_bias = np.einsum("ntk,nto->ko", both, e), e.sum(axis=(0, 1))
        d_both = e @ self.out.T
        dw, du, db = [], [], []
        for d in (0, 1):
            z = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
            gu = np.zeros_like(self.u[d])
            dh_next, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for k, h, c, i, f, o, g, th, m in reversed(memory[d]):
                dh = d_both[:, k, d * HIDDEN : (d + 1) * HIDDEN] + dh_next
                own = np.where(m, dh, 0)
                dcn = np.where(m, dc, 0) + own * o * (1 - th**2)
                a = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), own * th * o * (1 - o), dcn * i * (1 - g**2)], axis=1)
                z[:, k] = a
                gu += h.T @ a
                dh_next = np.where(m, a @ self.u[d].T, dh)
                dc = np.where(m, dcn * f, dc)
            dw.append(np.einsum("nti,ntj->ij", x, z))
            du.append(gu)
            db.append(z.sum(axis=(0, 1)))
        return [*dw, *du, *db, d_out, d_bias]


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(1, max(len(r) for r in rows))
    x = np.zeros((len(rows), t, PATH_DIM + 1 + WORD_DIM + OWN_DIM), dtype=np.float32)
    mask = np.zeros((len(rows), t), dtype=bool)
    for k, r in enumerate(rows):
        x[k, : len(r)], mask[k, : len(r)] = r, True
    return x, mask


#: Words for boilerplate containers of made-up pages, by kind.
NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav links mainmenu toc pagination pager".split(),
    "header": "header masthead banner topbar site branding logo".split(),
    "footer": "footer foot copyright bottom legal colophon".split(),
    "side": "sidebar aside related widget recommended popular trending secondary more teaser".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion adbox banner".split(),
    "notice": "notice cookie consent gdpr alert popup modal newsletter subscribe signup disclaimer warning".split(),
    "comment": "comment comments discussion disqus reply replies respond reader responses".split(),
    "share": "share social follow tools meta tags byline author".split(),
}
GOOD = "article content post entry main story body text page hentry".split()


def made_up(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A page and the texts of its article's blocks, in order."""
    letters = np.array(list("etaoinshrdlucmfwypvbgkéäöüñ"))
    word = lambda: "".join(rng.choice(letters, rng.integers(2, 11)))

    def prose(lo: int, hi: int) -> str:
        n, out = int(rng.integers(lo, hi)), []
        for k in range(n):
            w = word()
            out.append(w + (rng.choice([".", ",", "!", "?"], p=[0.6, 0.3, 0.05, 0.05]) if rng.random() < 0.15 else ""))
        return " ".join(out).capitalize() + (rng.choice([".", "", "!"], p=[0.8, 0.15, 0.05]))

    main: list[str] = []

    def good(tag: str, lo: int, hi: int) -> str:
        t = prose(lo, hi)
        main.append(t)
        body = t
        r = rng.random()
        if r < 0.15:
            body = f"<b>{t}</b>"
        elif r < 0.25:
            body = f"<b>{t}<br>"
        elif r < 0.4:
            cut = t.split(" ")
            k = int(rng.integers(0, len(cut)))
            cut[k] = f'<a href="/x">{cut[k]}</a>'
            body = " ".join(cut)
        return f"<{tag}>{body}" + ("" if tag in ("p", "li") and rng.random() < 0.3 else f"</{tag}>")

    def attrs(kind: str) -> str:
        w = rng.choice(NAMES[kind], int(rng.integers(1, 3)))
        return f' {rng.choice(["class", "id"])}="{rng.choice(["-", " ", "_"]).join(w)}"'

    def items(n: int, hi: int = 4) -> str:
        return "".join(f'<li><a href="/{word()}">{prose(1, hi)}</a></li>' for _ in range(n))

    def boiler(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside"}.get(kind, "div") if rng.random() < 0.6 else rng.choice(["div", "section"])
        named = attrs(kind) if tag in ("div", "section") or rng.random() < 0.4 else ""
        inner = {
            "nav": lambda: f"<ul>{items(int(rng.integers(2, 9)), 2 + int(rng.integers(0, 3)))}</ul>",
            "header": lambda: rng.choice([f"<a href='/'>{prose(1, 4)}</a>", f"<h1>{prose(1, 5)}</h1>", f"<p>{prose(2, 9)}</p>", prose(1, 6)]),
            "footer": lambda: rng.choice([f"&copy; {prose(3, 12)}", f"<p>{prose(3, 25)}</p>", f"<p>{prose(2, 8)}</p><ul>{items(3)}</ul>", prose(2, 15)]),
            "side": lambda: f"<h3>{prose(1, 4)}</h3><ul>{items(4, 9)}</ul>" if rng.random() < 0.5 else f"<h2>{prose(1, 4)}</h2><p>{prose(5, 40)}</p>",
            "ad": lambda: rng.choice([prose(3, 20), f"<p>{prose(4, 30)}</p>", f"<a href='/ad'>{prose(2, 8)}</a>"]),
            "notice": lambda: f"<p>{prose(5, 35)}</p><button>{prose(1, 3)}</button>" if rng.random() < 0.6 else prose(4, 30),
            "comment": lambda: f"<h3>{prose(1, 3)}</h3>" + "".join(f'<{t}{attrs("comment") if rng.random() < 0.7 else ""}><p>{prose(3, 60)}</p></{t}>' for t in [rng.choice(["div", "li", "article"])] * int(rng.integers(1, 6))),
            "share": lambda: f"<ul>{items(3, 2)}</ul>" if rng.random() < 0.5 else f"<span>{prose(1, 5)}</span>",
        }[kind]()
        if kind in ("notice", "comment", "side") and rng.random() < 0.25:
            inner += f"<form><label>{prose(1, 4)}</label><input name=q><button>{prose(1, 2)}</button><p>{prose(2, 12)}</p></form>"
        return f"<{tag}{named}>{inner}</{tag}>"

    head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{prose(2, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
    before = "".join(boiler(k) for k in rng.choice(["nav", "header", "ad", "notice", "side", "share"], int(rng.integers(0, 5)), p=[0.35, 0.2, 0.2, 0.1, 0.1, 0.05]))
    inner = good("h1", 2, 12) if rng.random() < 0.85 else ""
    for _ in range(int(rng.integers(1, 22))):
        r = rng.random()
        if r < 0.72:
            inner += good("p", 1, int(rng.choice([5, 25, 120])))
        elif r < 0.8:
            inner += good(rng.choice(["h2", "h3", "h4"]), 1, 8)
        elif r < 0.85:
            inner += "<ul>" + "".join(good("li", 1, 15) for _ in range(int(rng.integers(1, 5)))) + "</ul>"
        elif r < 0.88:
            inner += good("blockquote", 3, 40)
        elif r < 0.9:
            inner += good("pre", 2, 20)
        elif r < 0.92:
            inner += "<table><tr>" + "".join(good("td", 1, 5) for _ in range(3)) + "</tr></table>"
        else:
            inner += boiler(rng.choice(["ad", "share", "side", "notice", "nav", "comment"], p=[0.35, 0.2, 0.15, 0.15, 0.1, 0.05]))
    r = rng.random()
    tag, named = ("article", "") if r < 0.45 else ("main", "") if r < 0.6 else (rng.choice(["div", "section", "article"]), f' {rng.choice(["class", "id"])}="{"-".join(rng.choice(GOOD, int(rng.integers(1, 3))))}"')
    after = "".join(boiler(k) for k in rng.choice(["footer", "comment", "side", "ad", "notice", "share", "nav"], int(rng.integers(0, 5)), p=[0.35, 0.25, 0.15, 0.1, 0.05, 0.05, 0.05]))
    outer = rng.random() < 0.25
    return head + before + ("<div class='wrapper'>" if outer else "") + f"<{tag}{named}>{inner}</{tag}>" + ("</div>" if outer else "") + after + "</body></html>", [" ".join(html.unescape(t).split()) for t in main]


@lru_cache(maxsize=2)
def trained(seed: int = 11, pages: int = TRAIN_PAGES, epochs: int = EPOCHS) -> Labeller:
    """The labeller, trained anew in each driver process from the same seed (Adam, cross-entropy)."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        page, main = made_up(rng)
        found, wanted, y = blocks(page), iter([*main, None]), []
        want = next(wanted)
        for _, text, _ in found:
            hit = text == want
            y.append(hit)
            if hit:
                want = next(wanted)
        data.append((vectors([found])[0], np.array(y, dtype=np.float32)))
    size = PATH_DIM + 1 + WORD_DIM + OWN_DIM
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    bias = np.zeros(4 * HIDDEN, dtype=np.float32)
    bias[HIDDEN : 2 * HIDDEN] = 1
    net = Labeller([init(size, 4 * HIDDEN) for _ in (0, 1)], [init(HIDDEN, 4 * HIDDEN) for _ in (0, 1)], [bias.copy(), bias.copy()], init(2 * HIDDEN, 1), np.zeros(1, np.float32))
    first, second, t = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for a in range(0, len(data), BATCH):
            own = [data[k] for k in order[a : a + BATCH] if len(data[k][1])]
            x, mask = padded([o[0] for o in own])
            y = np.zeros(mask.shape, dtype=np.float32)
            for k, o in enumerate(own):
                y[k, : len(o[1])] = o[1]
            t += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.001
            for p, g, m, v in zip(net.parameters(), net.gradients(x, mask, y), first, second, strict=True):
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return net


def labels(found: list[list[tuple]], net: Labeller) -> list[np.ndarray]:
    """Whether each block of each page belongs to the article.  Pages of more than WINDOW blocks are read in windows."""
    parts = []
    for k, page in enumerate(found):
        for a in range(0, len(page), WINDOW):
            lo, hi = (0, len(page)) if len(page) <= WINDOW else (max(0, a - MARGIN), min(len(page), a + WINDOW + MARGIN))
            parts.append((k, lo, hi, a, min(len(page), a + WINDOW)))
    out = [np.zeros(len(page), dtype=bool) for page in found]
    order = sorted(range(len(parts)), key=lambda i: parts[i][2] - parts[i][1])
    while order:
        n = max(1, min(len(order), CELLS // (parts[order[-1]][2] - parts[order[-1]][1])))
        own, order = [parts[i] for i in order[-n:]], order[:-n]
        rows = vectors([found[k][lo:hi] for k, lo, hi, _, _ in own], [np.arange(lo, hi) / max(1, len(found[k]) - 1) for k, lo, hi, _, _ in own])
        x, mask = padded(rows)
        margin = net.run(x, mask)[0][..., 0]
        for (k, lo, _, a, b), m in zip(own, margin, strict=True):
            out[k][a:b] = m[a - lo : b - lo] > 0
    return out


def main_texts(pages: list[str | None], net: Labeller) -> list[str]:
    found = [blocks(p) if p else [] for p in pages]
    return ["\n\n".join(text for (_, text, _), keep in zip(page, own, strict=True) if keep) for page, own in zip(found, labels(found, net), strict=True)]


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", net: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row: the blocks of the article, in page order, joined by blank lines.

    Character references are decoded and white space inside a block becomes one space.  Null and empty pages, and pages
    without an article, give an empty text.  Repeated rows give one row each, an empty table none; ids and urls may be null.
    Pages of any length are read whole, in linear time.  Further columns are not read, whatever their names.
    """
    tune(df.sparkSession)
    net = net or trained()
    d = only(df, **{page_id: "id", url: "url", page: "html"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 250):
                own = batch.slice(a, 250)
                texts = main_texts(own.column("html").to_pylist(), net)
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    out = d.mapInArrow(lean(run), f"id {d.schema['id'].dataType.simpleString()}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(page_id), F.col("url").alias(url), "text", "n_chars")
