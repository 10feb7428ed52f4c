"""Personal data in texts: generators propose spans, boosted trees score them, calibrated thresholds select what is redacted.

Generators are generous and their spans overlap: the plain forms of an address or number, and forms that people use beside
them (``jane at host dot org``, ``192[.]0[.]2[.]1``, ``2001:db8::1``, a number without its country, a card grouped otherwise),
rows of digit groups whole and in parts.  A candidate becomes a row of numbers on its form and on what stands around it.
Trees learn from made-up sentences, in which data and look-alikes (orders, dates, versions, book numbers, tables of numbers) are
known; their scores are calibrated on sentences they have not seen, where each kind's threshold is set as well.  Spans of the plain
forms that pass their checks stay whatever the score; of the others the likeliest that overlap nothing chosen before are taken.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import lean, only, tune

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Made-up sentences to fit and to calibrate on; share of right spans among the selected ones that a threshold must reach there.
SENTENCES, PRECISION = 3000, 0.99
TREES, DEPTH, RATE, BINS, LEAST = 50, 3, 0.3, 24, 0.5
#: Bytes before and after a candidate that are read for its context.
BEFORE, AFTER = 40, 16

# Plain forms.  Quantifiers give nothing back and starts inside a run of digits are skipped, so that every scan is linear.
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = textvec.byte_class((65, 90), (97, 122), (48, 57)) | np.isin(np.arange(256), list(b"._%+-"))
_WIDE = _LOCAL | (np.arange(256) >= 128)

# Generous forms.  Parts of names are as long as such names may be at most (64 and 63 bytes).
_AT = [re.compile(p) for p in (rb"at(?<![A-Za-z0-9]at)(?![A-Za-z0-9])", rb"AT(?<![A-Za-z0-9]AT)(?![A-Za-z0-9])", rb"@")]
_DOT = rb"(?: {0,2}[\[({<] ?(?:dot|DOT|\.) ?[\])}>] {0,2}| (?:dot|DOT) |\.)"
_HOST = re.compile(rb" {0,2}[A-Za-z0-9\x80-\xff-]{1,63}+(?:" + _DOT + rb"[A-Za-z0-9\x80-\xff-]{1,63}+){1,6}")
_IP6 = re.compile(rb":(?:[0-9A-Fa-f]{0,4}:)++[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_APART = re.compile(rb"(?<![0-9])[0-9]{1,3}(?:(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) )[0-9]{1,3}){3}(?![0-9])")
_GROUPS = re.compile(rb"(?<![0-9])[0-9]++(?:(?:\xc2\xa0|[ ()./_-]){1,3}+[0-9]++)*+")
_DIGITS = re.compile(rb"[0-9]+")

# Words that tell what a number is.
_CUES = (b"mail contact correo courriel write".split(), b" ip host server addr ping node".split(), b"card visa master amex credit karte tarjeta carte".split(), "phone tel call mobil fax tél ring".encode().split())
_OTHER = b"order isbn issn version section page invoice total price date chapter figure serial sku ref id build code time since sum item".split()


def _back(text: bytes, at: int, low: int, known: np.ndarray) -> int:
    while at > low and known[text[at - 1]]:
        at -= 1
    return at


def luhn(digits: bytes) -> bool:
    """Whether the last digit checks the others."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = c - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _number(span: bytes) -> bytes:
    return b"".join(_DIGITS.findall(span))


def plain_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, stop) in bytes of the plain forms that pass their checks, leftmost and without overlap within a kind."""
    out = []
    if b"@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            start = _back(text, m.start(), end, _LOCAL)
            if start < m.start():
                out.append((EMAIL, start, m.end()))
                end = m.end()
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip(b"0") or b"0" for p in m[0].split(b"."))):
            out.append((IP, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(n := _number(m[0])) <= 19 and luhn(n):
            out.append((CARD, *m.span()))
    if b"+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_number(m[0])) <= 15:
                out.append((PHONE, *m.span()))
    return out


def _more_emails(text: bytes) -> Iterator[tuple[int, int, int]]:
    for pattern in _AT:
        for m in pattern.finditer(text):
            a, b = m.span()
            around = text[max(0, a - 2) : a].rstrip(b" ")[-1:] + text[b : b + 2].lstrip(b" ")[:1]
            if around in (b"[]", b"()", b"{}", b"<>"):
                a, b = text.rindex(around[:1], 0, a), text.index(around[1:], b) + 1
            host = _HOST.match(text, b)
            if host:
                stop = a
                while stop > 0 and a - stop < 2 and text[stop - 1] == 32:
                    stop -= 1
                start = _back(text, stop, max(0, stop - 64), _WIDE)
                if start < stop:
                    yield EMAIL, start, host.end()


def _more_ips(text: bytes) -> Iterator[tuple[int, int, int]]:
    for m in _IP6.finditer(text):
        start = m.start()
        while start > 0 and m.start() - start < 4 and text[start - 1] in b"0123456789abcdefABCDEF":
            start -= 1
        groups = text[start : m.end()].split(b":")
        if 3 <= len(groups) <= 9 and (b"::" in m[0] or len(groups) == 8) and not text[max(0, start - 1) : start].isalnum():
            yield IP, start, m.end()
    if any(x in text for x in (b".]", b".)", b".}", b".>", b". ]", b"dot", b"DOT")):
        for m in _APART.finditer(text):
            yield IP, *m.span()


def _more_numbers(text: bytes) -> Iterator[tuple[int, int, int]]:
    """Neighbouring groups of digits that make up a card or a number to call.

    They begin and end with the whole row of groups, or where what joins groups changes; a group of enough digits may stand alone.
    """
    for m in _GROUPS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(x.start(), x.end()) for x in _DIGITS.finditer(text, *m.span())]
        joints = [text[b:c] for (_, b), (c, _) in pairwise(groups)]
        for i, (a, b) in enumerate(groups):
            opens = i == 0 or (i < len(joints) and joints[i - 1] != joints[i])
            if not opens and b - a < 7:
                continue
            low = a - 1 if text[a - 1 : a] == b"(" else a
            low = low - 1 if text[low - 1 : low] == b"+" else low
            n = 0
            for j in range(i, min(len(groups), i + 19) if opens else i + 1):
                n += groups[j][1] - groups[j][0]
                if n > 19:
                    break
                if j == i or j == len(joints) or joints[j] != joints[j - 1]:
                    if 7 <= n <= 15:
                        yield PHONE, low, groups[j][1]
                    if n >= 12:
                        yield CARD, a, groups[j][1]


def candidates(text: bytes) -> tuple[list[tuple[int, int, int]], set[tuple[int, int, int]]]:
    """All proposed spans, each once, and those of them that the plain forms give."""
    plain = set(plain_spans(text))
    return sorted(plain.union(_more_emails(text), _more_ips(text), _more_numbers(text))), plain


FEATURES = (
    "kind", "length", "digits", "letters", "other", "groups", "longest", "shortest", "separators", "luhn", "distinct", "first", "plus", "bracket", "sign", "words", "dots", "octets", "colons", "top", "wide",
    "before_digit", "before_letter", "before_joint", "after_digit", "after_letter", "after_joint", "cue", "other_cue", "not_cue", "near_digits", "brackets_match", "prefix", "date",
)


def features(text: bytes, kind: int, a: int, b: int) -> list[float]:
    """A number for each of FEATURES: the span's form, then what stands around it."""
    s = text[a:b]
    runs = _DIGITS.findall(s)
    sizes = [len(r) for r in runs] or [0]
    n, digits = sum(sizes), b"".join(runs)
    letters = sum(c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 for c in s)
    between = _DIGITS.split(s)[1:-1]
    before, after = text[max(0, a - BEFORE) : a], text[b : b + AFTER]
    near = (before[-12:], after[:12])
    joint = b".,:;/_-+"
    prev, nxt = before[-1:], after[:1]
    said = b" " + before.lower()
    cues = [any(c in said for c in words) for words in _CUES]
    top = re.search(rb"[A-Za-z]{2,12}$", s)
    return [
        kind, b - a, n, letters, b - a - n - letters, len(runs), max(sizes), min(sizes), len(set(between)), luhn(digits) if n else 0, len(set(digits)), digits[0] - 48 if n else -1, s[:1] == b"+", s.count(b"(") + s.count(b"["),
        b"@" in s, len(re.findall(rb"(?<![A-Za-z])(?:at|AT|dot|DOT)(?![A-Za-z])", s)), s.count(b"."), n > 0 and all(len(r) <= 3 and int(r) <= 255 for r in runs), s.count(b":"), len(top[0]) if top else 0, sum(c >= 128 for c in s),
        bool(re.search(rb"[0-9][^A-Za-z\n]{0,2}$", before)), prev.isalpha() or prev >= b"\x80", prev != b"" and prev in joint, bool(re.match(rb"[^A-Za-z\n]{0,2}[0-9]", after)), nxt.isalpha() or nxt >= b"\x80", bool(re.match(rb"[.,:;/_+-][A-Za-z0-9]", after)),
        cues[kind], any(c for k, c in enumerate(cues) if k != kind), any(c in said for c in _OTHER), sum(48 <= c <= 57 for part in near for c in part), s.count(b"(") == s.count(b")"), int(digits[:2]) if n > 1 else -1, bool(re.search(rb"(?:19|20)[0-9]{2}[-./ ][01]?[0-9][-./ ]|[0-3]?[0-9][-./][01]?[0-9][-./](?:19|20)[0-9]{2}", s)),
    ]


@dataclass
class Model:
    """Trees of one depth, node after node; steps from scores to probabilities; a threshold for each kind."""

    base: float = -6.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    steps: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=lambda: [2.0] * len(KINDS))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated: the share of right spans among held-out ones of the kind with such a score."""
        m, out = self.margin(x), np.zeros(len(x))
        for kind, (edge, value) in enumerate(self.steps):
            own = x[:, 0] == kind
            out[own] = value[np.searchsorted(edge, m[own], side="right")]
        return out

    def chosen(self, text: bytes) -> list[tuple[int, int, int, bool, float]]:
        """(kind, start, stop, plain, probability) in bytes, by kind, then start."""
        spans, plain = candidates(text)
        if not spans:
            return []
        p = self.probability(np.array([features(text, *s) for s in spans], dtype=float)).tolist()
        out = [(*s, True, q) for s, q in zip(spans, p, strict=True) if s in plain]
        taken = sorted((a, b) for _, a, b, _, _ in out)
        starts, stops = [a for a, _ in taken], list(np.maximum.accumulate([b for _, b in taken])) if taken else []
        rest = sorted((-q, s[1] - s[2], *s) for s, q in zip(spans, p, strict=True) if s not in plain and q >= self.thresholds[s[0]])
        for q, _, kind, a, b in rest:
            at = int(np.searchsorted(starts, b))
            if at and stops[at - 1] > a:
                continue
            at = int(np.searchsorted(starts, a))
            starts.insert(at, a)
            stops.insert(at, b)
            out.append((kind, a, b, False, -q))
        return sorted(out)


def _best(bins: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[float, int, int]:
    """Gain, feature and bin of the best cut of ``rows``."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    own = bins[:, rows]
    lg, lh = (np.cumsum([np.bincount(b, w, BINS + 1) for b in own], axis=1)[:, :-1] for w in (g[rows], h[rows]))
    gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
    gain[(lh < LEAST) | (lh > total_h - LEAST)] = 0
    k, at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[k, at]), int(k), int(at) if gain[k, at] > 1e-9 else BINS


def boosted(x: np.ndarray, y: np.ndarray) -> Model:
    """Trees of DEPTH that follow the logistic loss, each on all rows.  Without rows, or of one label, a constant."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(rate / (1 - rate))))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)])  # bin <= j where value <= edge j
    margin = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(2**DEPTH - 1):
            rows = np.flatnonzero(at == node)
            _, k, j = _best(bins, g, h, rows) if len(rows) else (0, 0, BINS)
            if j < len(edges[k]):
                feature[node], cut[node] = k, edges[k][j]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        leaf = at - len(feature)
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        model.trees.append((feature, cut, value))
        margin += value[leaf]
    return model


def rising(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges and values of the rising step function closest to labels over scores: neighbours that fall are pooled."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, rows, first score
    for s, t in zip(score[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][2] == s:
            blocks[-1][0] += t
            blocks[-1][1] += 1
        else:
            blocks.append([t, 1, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, rows, _ = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += rows
    return np.array([b[2] for b in blocks[1:]]), np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks] or [0.0])


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Smallest probability at and above which PRECISION of the spans are right; 2 where there is none."""
    for t in np.unique(p):
        if y[p >= t].mean() >= PRECISION:
            return float(t)
    return 2.0


# Made-up sentences.

_SYLLABLES = "an be co da el fi go hu in ka lo mi nu or pe qua ri so ta un ver wi ze ment tion éa ção ñan über ßen".split()
_ENDS = "com org net de fr es io edu example co.uk".split()
_SAY = [  # words before data of a kind, then words before look-alikes
    "mail me:|e-mail|contact|write to|correo|courriel|Mail:|reach".split("|"), "host|server|IP|addr|ping|node|ip address|client".split("|"), "card|visa|credit card|pay with|Karte|tarjeta|card no.|carte".split("|"), "phone|tel|tel.|call|mobile|fax|Telefon|tél.|call us on".split("|"),
]
_NOT = "order|order no.|ISBN|version|v|section|page|invoice|total|price|date|chapter|figure|serial|SKU|ref|id|build|item|sum|code|since|at|look at|see|meet at".split("|")


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3)))


def _figures(r: random.Random, n: int) -> str:
    return str(r.randint(1, 9)) + "".join(str(r.randint(0, 9)) for _ in range(n - 1)) if n else ""


def _checked(r: random.Random, n: int) -> str:
    head = r.choice("34569") + _figures(r, n - 2)
    return next(head + str(d) for d in range(10) if luhn(f"{head}{d}".encode()))


def _dealt(s: str, sizes: list[int], joint: str) -> str:
    out = []
    for n in sizes:
        out.append(s[:n])
        s = s[n:]
    return joint.join(x for x in [*out, s] if x)


def _ascii(r: random.Random) -> str:
    return _word(r).encode("ascii", "ignore").decode() or "jo"


def _datum(r: random.Random, kind: int) -> str:
    """Personal data of a kind, plain or not."""
    if kind == EMAIL:
        local = _ascii(r) + r.choice(["", "." + _ascii(r), str(r.randint(1, 99)), "_" + _ascii(r)])
        at = r.choice(["@", " at ", " AT ", "(at)", " (at) ", "[at]", " [at] ", "{at}", " @ ", "@"])
        dot = r.choice([" dot ", "[dot]", "(dot)", " [dot] ", " (dot) ", "[.]", ".", " DOT "]) if at != " at " else r.choice([" dot ", "[dot]"])
        local = _word(r) + "ü" if at == "@" and dot == "." and r.random() < 0.7 else local
        return local + at + dot.join([_ascii(r), *r.choice(_ENDS).split(".")])
    if kind == IP:
        if r.random() < 0.5:
            return r.choice(["[.]", "(.)", "[dot]", " dot ", "(dot)", "[.]", "."]).join(str(r.randint(0, 255)) for _ in range(4))
        groups = [f"{r.randrange(1, 65536):x}" for _ in range(8)]
        cut = r.randint(1, 5)
        return ":".join(groups) if r.random() < 0.5 else ":".join(groups[:cut]) + "::" + ":".join(groups[8 - r.randint(1, 6 - cut) :])
    if kind == CARD:
        n = r.choice([13, 14, 15, 15, 16, 16, 16, 17, 18, 19])
        joint = r.choice(["", " ", "-", ".", " ", "/"])
        return _dealt(_checked(r, n), [4, 6, 5] if n == 15 else [4, 4, 4, 4], joint)
    s = _figures(r, 10)
    return r.choice([
        f"({s[:3]}) {s[3:6]}-{s[6:]}", f"{s[:3]}-{s[3:6]}-{s[6:]}", f"{s[:3]}.{s[3:6]}.{s[6:]}", f"1-{s[:3]}-{s[3:6]}-{s[6:]}", f"0{s[:3]} {s[3:6]} {s[6:]}", f"00 {s[:2]} {s[2:4]} {s[4:7]} {s[7:]}", f"0{s[:3]}/{s[3:9]}", f"+{s[:2]} {s[2:5]} {s[5:]}", f"+1 ({s[:3]}) {s[3:6]}-{s[6:]}", f"({s[:3]}){s[3:6]}-{s[6:]}",
    ])


def _lookalike(r: random.Random) -> str:
    f = lambda n: _figures(r, n)
    card = _checked(r, 16)
    return r.choice([
        lambda: card[:-1] + str((int(card[-1]) + r.randint(1, 9)) % 10), lambda: _dealt(card[:-1] + str((int(card[-1]) + r.randint(1, 9)) % 10), [4, 4, 4], r.choice([" ", "-", "."])), lambda: f"978-{f(1)}-{f(2)}-{f(6)}-{f(1)}", lambda: f"{r.randint(1950, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}",
        lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1950, 2030)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: f"{f(3)},{f(3)}.{f(2)}", lambda: " ".join(f(r.randint(1, 4)) for _ in range(r.randint(2, 9))), lambda: " | ".join(f(r.randint(1, 6)) for _ in range(r.randint(3, 9))),
        lambda: "%040x" % r.getrandbits(160), lambda: "%032x" % r.getrandbits(128), lambda: f(r.randint(7, 20)), lambda: f"{f(2)}.{f(r.randint(4, 9))}, {f(2)}.{f(r.randint(4, 9))}", lambda: f"{r.randint(1800, 2030)}-{r.randint(1800, 2030)}", lambda: f"{f(5)}-{f(4)}", lambda: f"{_ascii(r)}-{f(4)}-{f(4)}-{f(4)}", lambda: f"{f(3)}/{f(4)}/{f(5)}",
        lambda: f"at {_ascii(r)}.{r.choice(_ENDS)}", lambda: f"at {_ascii(r)}.{_ascii(r).title()}", lambda: f"{_ascii(r)} @ {_ascii(r)}. {_ascii(r)}", lambda: f"{_ascii(r)}::{_ascii(r)}::{_ascii(r)}", lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02}:{r.randint(0, 59):02}", lambda: f"{f(8)}-{'%04x' % r.getrandbits(16)}-{f(4)}-{f(4)}-{f(12)}", lambda: ":".join("%02x" % r.getrandbits(8) for _ in range(6)),
        lambda: f"{f(3)}-{f(2)}", lambda: f"a dot at {_ascii(r)} dot", lambda: f"{f(4)} {f(4)}", lambda: f"1 {f(3)} {f(3)}", lambda: f"{f(3)} {f(3)} {f(3)}", lambda: "0." + f(r.randint(5, 17)), lambda: f"{f(r.randint(3, 8))}e-{f(2)}", lambda: f"x{f(r.randint(7, 16))}", lambda: f"{f(2)}x{f(7)}y",
    ])()


def sentences(seed: int, rows: int = SENTENCES) -> Iterator[tuple[bytes, set[tuple[int, int, int]]]]:
    """Made-up texts, each with the (kind, start, stop) of its personal data in bytes."""
    r = random.Random(seed)
    for _ in range(rows):
        text, known = b"", set()
        for _ in range(r.randint(1, 4)):
            text += " ".join(_word(r) for _ in range(r.randint(0, 6))).encode() + b" "
            if r.random() < 0.5:
                kind = r.randrange(len(KINDS))
                text += (r.choice(_SAY[kind]) + r.choice([" ", ": "])).encode() if r.random() < 0.6 else b""
                datum = _datum(r, kind).encode()
                known.add((kind, len(text), len(text) + len(datum)))
                text += datum
            else:
                text += (r.choice(_NOT) + r.choice([" ", ": ", " #"])).encode() if r.random() < 0.6 else b""
                text += _lookalike(r).encode()
            text += r.choice([" ", ", ", ".\n", "\n", "; ", " | ", ". "]).encode()
        yield text, known


def _rows(seed: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels of the candidates of made-up sentences, and which of them are not plain."""
    x, y, more = [], [], []
    for text, known in sentences(seed, rows):
        spans, plain = candidates(text)
        x += [features(text, *s) for s in spans]
        y += [s in known for s in spans]
        more += [s not in plain for s in spans]
    return np.array(x, dtype=float), np.array(y, dtype=float), np.array(more)


def fit(seed: int = 13, rows: int = SENTENCES) -> Model:
    """Trees from the ``rows`` sentences of one seed, calibration and thresholds from those of the next; the same at every call."""
    model = boosted(*_rows(seed, rows)[:2])
    x, y, more = _rows(seed + 1, rows)
    margin = model.margin(x)
    model.steps = [rising(margin[x[:, 0] == k], y[x[:, 0] == k]) for k in range(len(KINDS))]
    p = model.probability(x)
    model.thresholds = [_threshold(p[more & (x[:, 0] == k)], y[more & (x[:, 0] == k)]) for k in range(len(KINDS))]
    return model


def _redacted(text: bytes, spans: list[tuple[int, int, int, bool, float]]) -> bytes:
    """``text`` with every stretch of chosen spans replaced by the kind of its first span."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b, _, _ in spans):
        if a >= at:
            out += [text[at:a], b"<" + KINDS[kind].upper().encode() + b">"]
        at = max(at, b)
    return b"".join([*out, text[at:]])


def find(df: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", redact: bool = False) -> DataFrame:
    """(doc_id, spans) for every row: kind, start and end in code points (end exclusive), whether plain, and probability.

    Spans are sorted by kind as in KINDS, then start.  Plain ones, which pass the checks of their kind, are always there; those of
    different kinds may overlap, all others overlap nothing.  With ``redact`` also the text, its spans replaced by their kind.  Null
    texts count as empty and have no spans.  Every row is searched whole and by itself: repeated rows come out alike, ids may be
    null, an empty table gives no rows, and further columns are not read.
    """
    tune(df.sparkSession)
    rows = only(df, **{doc_id: "doc_id", text: "text"})
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["kind", "start", "end", "plain", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = textvec.raw(batch.column("text"))
            found, out = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                own = body[a:b].tobytes()
                spans = model.chosen(own)
                if redact:
                    out.append(_redacted(own, spans))
                if spans and not own.isascii():
                    points = np.concatenate([[0], np.cumsum(body[a:b].view(np.int8) > -65)])
                    spans = [(k, int(points[x]), int(points[y]), p, q) for k, x, y, p, q in spans]
                found.append([dict(zip(names, (KINDS[k], x, y, p, q), strict=True)) for k, x, y, p, q in spans])
            kinds = pa.list_(pa.struct(list(zip(names, [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.float64()], strict=True))))
            columns = [batch.column("doc_id"), pa.array(found, kinds), *([pa.array(out, pa.binary()).cast(pa.string())] if redact else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", "redacted"][: len(columns)])

    return rows.mapInArrow(lean(run), f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, plain: boolean, score: double>>" + ", redacted string" * redact)


def digest(found: DataFrame) -> DataFrame:
    """One row a text of what ``find`` gives: plain spans by kind and as a hash, and all spans as ``kind:start:end``."""
    plain = F.filter("spans", lambda s: s["plain"])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(listed(plain), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
