"""Main content of web pages: a linear-chain conditional random field over the blocks of a page, decoded by Viterbi.

The blocks of a page are its non-blank lines.  Where the markup is gone, the shape of a block (length, separators, bullets, end,
case, figures) and its place stand in for its ancestor tags; its words are features too.  States: body, furniture (menus,
notices, controls, footers) and side box (heading, entries and teasers of a box).  No phrase is written down here: what
furniture says is learned from the corpus.

Labels come from repetition.  What is furniture stands on many pages of a site, or of many sites, around different bodies; so
the lines of a bounded sample of pages (``TRAIN_PAGES``) are counted over all pages, by site and in total, after figures and
host names are taken out.  Pages with the same longest line count once, so that copies of a page don't make its body look
like furniture.  A repeated line that is mostly followed by new short lines heads a box, and these lines are its entries.
Lines that the counts leave open have no label: the field is fitted to partial labels by expectation.

Fitting is deterministic.  Decoding covers every page.  Nulls and blank texts have no blocks and give no rows.  Blank lines are
never furniture.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import table

#: Most pages that the field is fitted on, drawn by hash; whole pages count.
TRAIN_PAGES = 1500
BODY, FURNITURE, BOX = 0, 1, 2
STATES = 3
#: A line is repeated on a site if at least so many pages and this share of the site's pages have it ...
SITE_PAGES, SITE_SHARE = 3, 0.04
#: ... or so many pages and this share of all pages, on several sites.
ALL_PAGES, ALL_SHARE, ALL_SITES = 6, 0.004, 3
#: Entries of a box that are labelled; whether it goes on is left open.
SURE_ENTRIES = 3
#: So many lines in a row that are neither repeated nor entries are a list or table of the body.
LIST_LINES = 5
#: Heads of boxes: so many times on training pages, and this share of times before a new short line.
HEAD_TIMES, HEAD_SHARE = 3, 0.7
#: Lines of more characters are paragraphs: their words are no features but for the first ones.
SHORT = 160
#: So many characters tell the forms of long lines apart before they are read in whole.
_START = 60

_HOST = re.compile(r"(?:https?://)?[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b(?:/\S*)?")
_DOT = re.compile(r"\.[a-z]{2}")
_NUMBER = re.compile(r"\d\d*")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|#|@|[^\w\s]")
#: For ASCII in lower case: numbers, words with marks inside, and what makes a space of all that is no letter.
_ASCII_NUMBER = re.compile(r"[0-9][0-9]*")
_ASCII_WORD = re.compile(r"[a-z][a-z]*(?:['-][a-z]+)*")
APART = "".join(chr(c) if "a" <= chr(c) <= "z" else " " for c in range(128))
_HAN = re.compile(r"[㐀-鿿]")
_END_MARKS, _CLOSERS = frozenset(".!?。！？…"), "\"”»“’')]）"
_BULLET = re.compile(r"(?:[*•–\-→●▪◦‣·■□▸✓+]|>>|\[[ x]\]|\(?[a-z]\)|\(?\d{1,3}[.)])\s+")
_PARTS = re.compile(r" ?[|·>»•/] ?|\s{2,}|\t")
_PART_MARK = re.compile(r"[|·>»•/]")
#: A text that is cut off, and what invites to read on.
_CUT = re.compile(r"(?:\.\.\.|…)\s*(?P<more>[^\W\d_][^.…]{0,30}?)[ .…»]*$")
#: What stands before a colon, an arrow or a date.
_LEAD = re.compile(r"^(.{2,40}?)(?:[:：»]|(?=#([./-])#\2#))")


def site_names(site: str | None) -> tuple[str, ...]:
    """Host name and display name of a site, in lower case."""
    if not site or not site.strip():
        return ()
    low = site.strip().lower()
    return low, " ".join(low.split(".")[0].replace("-", " ").split())


def normal(line: str, names: tuple[str, ...] = ()) -> str:
    """A line in lower case with '#' for numbers and '@' for the name of its own site and, in lines of up to ``SHORT`` characters, for other hosts."""
    n = " ".join(line.lower().split())
    for name in names:
        if len(name) > 2 and name in n:
            n = n.replace(name, "@")
    if len(n) <= SHORT and "." in n and _DOT.search(n):
        n = _HOST.sub("@", n)
    return (_ASCII_NUMBER if n.isascii() else _NUMBER).sub("#", n)


def _ends(bare: str) -> bool:
    return bare.rstrip(_CLOSERS)[-1:] in _END_MARKS


def _lead(n: str) -> re.Match | None:
    return _LEAD.match(n) if ":" in n or "#" in n or not n.isascii() else None


class Line(NamedTuple):
    """What one line says by itself."""

    form: str
    kind: int
    keys: tuple[int | str, ...]


# Coarse kinds of a block, by shape alone.
KINDS = ("long", "sentence", "bullet", "numbered", "menu", "cut", "word", "phrase", "clause", "cells", "figures", "own")
_K = {k: i for i, k in enumerate(KINDS)}
_EDGE = len(KINDS)
_NK = _EDGE + 1
_SHORT = frozenset(_K[k] for k in ("bullet", "numbered", "cut", "word", "phrase"))


def _shape(bare: str, n: str, size: int, figures: bool, ends: bool, parts: list[str]) -> int:
    if n == "@":
        return _K["own"]
    if figures:
        return _K["figures"]
    if ("..." in n or "…" in n) and _CUT.search(n):
        return _K["cut"]
    if ends and (size > 4 or len(n) > 30):
        return _K["sentence"]
    if _BULLET.match(bare):
        return _K["numbered"] if bare[0].isdigit() else _K["bullet"]
    if len(parts) >= 2 and max(map(len, parts)) <= 40:
        return _K["menu"]
    if "|" in bare or ";" in bare:
        return _K["cells"]
    if size <= 3 and len(n) <= 30:
        return _K["word"]
    return _K["phrase"] if size <= 14 else _K["clause"]


_BASE = {}
_at = 0
for _name, _size in (("kind", _NK), ("gap", 4 * _NK), ("prev", _NK * _NK), ("next", _NK * _NK), ("around", _NK * _NK), ("top", 8 * _NK), ("low", 8 * _NK), ("len", 12), ("parts", 8), ("flags", 64), ("since", 10 * 2 * _NK), ("run", 8 * _NK), ("prose", 9 * _NK)):
    _BASE[_name] = _at
    _at += _size
_PLACE = (0, 1, 2, 3, 4, 4, 5, 5, 5, 6, 6, 6, 6)


def _long_keys(start: str, bare: str) -> tuple[int | str, ...]:
    words = [m[0] for m in islice(_TOKEN.finditer(start), 4)]
    return (_BASE["kind"] + _K["long"], _BASE["flags"] + (start[0] == "@"), _BASE["flags"] + 8 + _ends(bare[-8:]), "<" + " ".join(words[:2]), "<" + " ".join(words))


def _line(raw: str, names: tuple[str, ...]) -> Line:
    bare = raw.strip()
    n = normal(bare, names)
    b = _BASE
    if len(n) > SHORT:
        return Line(n, _K["long"], _long_keys(n[:80], bare))
    ends = _ends(bare)
    wide = not n.isascii() and _HAN.search(n) is not None
    if ends and len(n) > 40 and "..." not in n and "…" not in n:  # a sentence, however it goes on inside
        first, last = (list(n[:4]), list(n[-4:])) if wide else (n.split(" ", 4)[:4], n.rsplit(" ", 4)[-4:])
        kind = _K["sentence"]
        marks = [i for i, f in enumerate((n[0] == "@", "@" in n, "#" in n, ":" in n, bare[0].islower())) if f]
        return Line(n, kind, (b["kind"] + kind, b["len"] + min(11, len(n) // 12), *(b["flags"] + 2 + i for i in marks), "=" + n, "<" + " ".join(first[:2]), ">" + " ".join(last[-2:]), "<" + " ".join(first), ">" + " ".join(last)))
    solid = len(n) - n.count(" ")
    if n.isascii():
        plain = _ASCII_WORD.findall(n) if "'" in n or "-" in n else n.translate(APART).split()
        letters = sum(map(len, plain))
        size = len(plain) + solid - n.count("_") - letters  # figures are gone, so each other character is a token
    else:
        tokens = _TOKEN.findall(n)
        plain = [w for w in tokens if w[0].isalnum()]
        letters, size = sum(map(len, plain)), len(tokens)
    if wide:
        han = len(_HAN.findall(n))
        size += han // 2
        if han * 2 > letters:
            plain = [c for c in n if c.isalnum()]
    parts = _PARTS.split(n) if _PART_MARK.search(n) else [n]
    kind = _shape(bare, n, size, letters * 3 < solid, ends, _PARTS.split(bare) if "  " in bare or "\t" in bare else parts)
    marks = "[+]" in n or not n.isascii() and ("♥" in n or "↻" in n or "✉" in n)
    flags = (raw[0] in " \t", n[0] == "@", "@" in n, (figure := "#" in n), figure and ("#.#.#" in n or "#-#-#" in n or "#/#/#" in n), bare.isupper(), bare[0].islower(), wide, ends, ":" in n or "：" in n, "©" in n, bare[-1] in ")]", bare[0].isdigit(), marks, "  " in bare)
    out = [b["kind"] + kind, b["len"] + min(11, len(n) // 12), b["parts"] + min(7, len(parts)), "=" + n]
    out += [b["flags"] + 16 + i for i, f in enumerate(flags) if f]
    if plain:
        out += ["<" + " ".join(plain[:2]), ">" + " ".join(plain[-2:]), "<" + " ".join(plain[:4]), ">" + " ".join(plain[-4:])]
        if len(plain) <= 14:
            out += ["w" + w for w in (plain if len(plain) < 2 else dict.fromkeys(plain))]
    if (lead := _lead(n)) is not None:
        out.append(":" + lead[1])
    if kind == _K["cut"]:
        out.append("…" + _CUT.search(n)["more"])
    if len(parts) > 1:
        out += ["|" + p for p in dict.fromkeys(parts) if p]
    return Line(n, kind, tuple(out))


@lru_cache(maxsize=200_000)
def _short_line(raw: str, names: tuple[str, ...]) -> Line:
    return _line(raw, names)


def read_line(raw: str, names: tuple[str, ...]) -> Line:
    return _short_line(raw, names) if len(raw) <= SHORT else _line(raw, names)


class Page(NamedTuple):
    """Line numbers of the non-blank lines, what they say, and whether a blank line stands before each."""

    at: list[int]
    lines: list[Line]
    gap: list[bool]


def blocks(text: str, site: str | None) -> Page:
    names = site_names(site)
    at: list[int] = []
    lines: list[Line] = []
    gap: list[bool] = []
    blank = True
    for i, raw in enumerate(text.split("\n")):
        if not raw.strip():
            blank = True
            continue
        at.append(i)
        lines.append(read_line(raw, names))
        gap.append(blank)
        blank = False
    return Page(at, lines, gap)


# ---------------------------------------------------------------------------------------------------------------------
# Labels of the training pages

LABELS = {BODY: (True, False, False), FURNITURE: (False, True, False), BOX: (False, False, True)}
OPEN = (True, True, True)


def leads(form: str) -> list[str]:
    """Parts of a form that may be repeated though the whole is not: what stands before a colon, arrow or date, and what invites to read on."""
    if len(form) > SHORT:
        return []
    if ("..." in form or "…" in form) and (m := _CUT.search(form)) is not None:
        return ["\x03" + m["more"]]
    if (m := _lead(form)) is not None and not _ends(form):
        return ["\x02" + form[: m.end()]]
    return []


def wordless(form: str) -> bool:
    """Whether a form has nothing but figures and rules: rows of tables repeat these."""
    return not any(c.isalpha() or c in "@©♥" or ord(c) > 0x2190 for c in form)


def _short(line: Line) -> bool:
    return line.kind in _SHORT


def box_heads(pages: list[Page], repeated: list[list[bool]]) -> frozenset[str]:
    """Repeated short lines that are mostly followed, without a blank line, by short lines that are not repeated."""
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for page, rep in zip(pages, repeated, strict=True):
        for i, line in enumerate(page.lines):
            if rep[i] and line.kind in (_K["word"], _K["phrase"]):
                count = seen[line.form]
                count[0] += 1
                count[1] += i + 1 < len(rep) and not rep[i + 1] and not page.gap[i + 1] and _short(page.lines[i + 1])
    return frozenset(f for f, (n, k) in seen.items() if n >= HEAD_TIMES and k >= HEAD_SHARE * n)


def label_page(page: Page, repeated: list[bool], tail: list[bool], heads: frozenset[str]) -> list[tuple[bool, ...]]:
    """Allowed states of each block.  ``repeated``: the whole line is; ``tail``: a part of it is."""
    n = len(page.lines)
    out = [OPEN] * n
    for i, line in enumerate(page.lines):
        if repeated[i]:
            out[i] = LABELS[BOX if line.form in heads else FURNITURE]
        elif tail[i]:
            out[i] = LABELS[BOX] if line.kind == _K["cut"] else LABELS[FURNITURE]
        elif line.kind in (_K["long"], _K["sentence"], _K["clause"]):
            out[i] = LABELS[BODY]
    i = 0
    while i < n:
        if repeated[i] and page.lines[i].form in heads:
            j = i + 1
            entries, style = 0, None
            while j < n and not page.gap[j] and not repeated[j] and _short(page.lines[j]):
                cut, listed = page.lines[j].kind == _K["cut"], page.lines[j].kind in (_K["numbered"], _K["bullet"])
                if not cut:
                    if style not in (None, listed):
                        break
                    entries, style = entries + 1, listed
                out[j] = LABELS[BOX] if entries <= SURE_ENTRIES and len(page.lines[j].form) <= 90 else OPEN
                j += 1
            i = j
        else:
            i += 1
    i = 0
    while i < n:
        j = i
        while j < n and out[j] is OPEN and not repeated[j]:
            j += 1
        if j - i >= LIST_LINES and not (i and out[i - 1] == LABELS[BOX]):
            out[i:j] = [LABELS[BODY]] * (j - i)
        i = max(j, i + 1)
    # short lines among bodies, or behind a blank line and before a body, are headings
    for i in range(n):
        if out[i] is OPEN:
            near = [out[j] for j in (i - 1, i + 1) if 0 <= j < n]
            if all(x == LABELS[BODY] or x is OPEN for x in near) and (LABELS[BODY] in near or not near):
                out[i] = LABELS[BODY]
    if n == 1:
        out = [LABELS[BODY]]
    return out


# ---------------------------------------------------------------------------------------------------------------------
# Features


def context(kinds: list[int], gap: list[bool], heads: list[bool]) -> list[tuple[int, ...]]:
    """Keys of the active features of each block that come from its place and neighbours."""
    n, b = len(kinds), _BASE
    gaps, prev, next_, around, top, low, since_, run_, prose = (b[k] for k in ("gap", "prev", "next", "around", "top", "low", "since", "run", "prose"))
    out = []
    since, entries = 9, 0
    # how far the next block is that looks like prose
    ahead = [9] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = 0 if kinds[i] <= 1 else min(9, ahead[i + 1] + 1)
    back, run, p, cut = 2, 0, _EDGE, _K["cut"]
    for i, k in enumerate(kinds):
        g = gap[i]
        last = i + 1 == n
        q = _EDGE if last else kinds[i + 1]
        if heads[i]:
            since, entries = 0, 0
        elif since < 9:
            if g or k not in _SHORT:
                since = 9
            else:
                entries += k != cut
                since = min(8, 1 + entries)
        run = run + 1 if k == p and not g else 0
        out.append(
            (
                gaps + 4 * k + 2 * g + (last or gap[i + 1]),
                prev + p * _NK + k,
                next_ + q * _NK + k,
                around + p * _NK + q,
                top + 8 * k + (_PLACE[i] if i < 13 else 7),
                low + 8 * k + (_PLACE[n - 1 - i] if n - i < 14 else 7),
                since_ + (2 * since + heads[i]) * _NK + k,
                run_ + 8 * k + min(7, run),
                prose + 9 * k + 3 * back + min(2, ahead[i + 1] // 3),
            )
        )
        back = 1 if k <= 1 else 0 if not i else back
        p = k
    return out


def features(page: Page, heads: frozenset[str]) -> list[list[int | str]]:
    """Keys of all active features of each block."""
    lines = page.lines
    near = context([x.kind for x in lines], page.gap, [x.form in heads for x in lines])
    out = []
    for i, (line, keys) in enumerate(zip(lines, near, strict=True)):
        f = [*line.keys, *keys]
        if i and lines[i - 1].kind > 1:
            f.append("p" + lines[i - 1].form)
        if i + 1 < len(lines) and lines[i + 1].kind > 1:
            f.append("n" + lines[i + 1].form)
        out.append(f)
    return out


# ---------------------------------------------------------------------------------------------------------------------
# The model


class Model:
    """Weights of features by state and of transitions, and the heads of boxes; with Viterbi decoding."""

    def __init__(self, weights: dict[int | str, tuple[float, float, float]], pair: np.ndarray, heads: frozenset[str] = frozenset()):
        self.weights, self.pair, self.heads = weights, pair, heads
        self._pair = pair.tolist()
        self._known = lru_cache(maxsize=200_000)(self._weigh)
        self._near = lru_cache(maxsize=50_000)(self._sum)

    def __reduce__(self):
        return Model, (self.weights, self.pair, self.heads)

    def _sum(self, keys) -> tuple[float, float, float]:
        a = b = c = 0.0
        for u, v, w in filter(None, map(self.weights.get, keys)):
            a += u
            b += v
            c += w
        return a, b, c

    def _weigh(self, raw: str, names: tuple[str, ...]) -> tuple:
        """Of one line: kind, whether it heads a box, its own score, and what it adds to the next and to the last line."""
        if len(raw) > 2 * SHORT:  # of a long line only the start and the end are features
            bare = raw.strip()
            start = normal(bare[: 2 * SHORT], names)
            if len(start) > SHORT:
                return _K["long"], False, self._sum(_long_keys(start[:80], bare)), None, None
        line = _line(raw, names)
        get = self.weights.get
        after, before = (get("p" + line.form), get("n" + line.form)) if line.kind > 1 else (None, None)
        return line.kind, line.form in self.heads, self._sum(line.keys), after, before

    def read(self, text: str, site: str | None) -> tuple[list[int], list[bool], list[tuple]]:
        """Numbers of the non-blank lines, whether a blank line stands before each, and what each says."""
        names = site_names(site)
        at, gap, seen, blank = [], [], [], True
        known, weigh = self._known, self._weigh
        named = bool(names) and ((whole := text.lower()).find(names[1]) >= 0 or whole.find(names[0]) >= 0)
        for i, raw in enumerate(text.split("\n")):
            if not raw or raw.isspace():
                blank = True
                continue
            at.append(i)
            gap.append(blank)
            if len(raw) > SHORT:
                seen.append(weigh(raw, names))
            elif named and ((low := raw.lower()).find(names[1]) >= 0 or low.find(names[0]) >= 0):
                seen.append(known(raw, names))
            else:  # a line that doesn't name its site says the same on all sites
                seen.append(known(raw, ()))
            blank = False
        return at, gap, seen

    def scores(self, gap: list[bool], seen: list[tuple]) -> list[tuple[float, float, float]]:
        """Sums of the weights of each block, by state."""
        out, near, after = [], self._near, None
        following = [*(x[4] for x in seen[1:]), None][: len(seen)]
        for x, keys, before in zip(seen, context([x[0] for x in seen], gap, [x[1] for x in seen]), following, strict=True):
            (a, b, c), (u, v, w) = x[2], near(keys)
            a, b, c = a + u, b + v, c + w
            if after is not None:
                a, b, c = a + after[0], b + after[1], c + after[2]
            if before is not None:
                a, b, c = a + before[0], b + before[1], c + before[2]
            out.append((a, b, c))
            after = x[3]
        return out

    def path(self, scores: list[tuple[float, float, float]]) -> list[int]:
        """Most probable states of a page."""
        if not scores:
            return []
        (t00, t01, t02), (t10, t11, t12), (t20, t21, t22) = self._pair
        back = []
        a, b, c = scores[0]
        for u, v, w in scores[1:]:
            x0, x1, x2 = a + t00, b + t10, c + t20
            y0, y1, y2 = a + t01, b + t11, c + t21
            z0, z1, z2 = a + t02, b + t12, c + t22
            k0 = 0 if x0 >= x1 and x0 >= x2 else 1 if x1 >= x2 else 2
            k1 = 0 if y0 >= y1 and y0 >= y2 else 1 if y1 >= y2 else 2
            k2 = 0 if z0 >= z1 and z0 >= z2 else 1 if z1 >= z2 else 2
            back.append((k0, k1, k2))
            a, b, c = (x0, x1, x2)[k0] + u, (y0, y1, y2)[k1] + v, (z0, z1, z2)[k2] + w
        s = 0 if a >= b and a >= c else 1 if b >= c else 2
        out = [s]
        for k in reversed(back):
            s = k[s]
            out.append(s)
        out.reverse()
        return out

    def page(self, text: str, site: str | None) -> tuple[list[int], list[int]]:
        """Line numbers of the non-blank lines and their states."""
        at, gap, seen = self.read(text, site)
        return at, self.path(self.scores(gap, seen))


def fit(pages: list[tuple[list[list[int | str]], list[tuple[bool, ...]]]], heads: frozenset[str] = frozenset(), rounds: int = 60, rate: float = 0.1, decay: float = 2e-3) -> Model:
    """Maximum likelihood of partial labels by full-batch Adam: expectations under all paths less those under the allowed ones.

    Pages run side by side, the longest first, so that step t only touches pages that have a block t.
    """
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
    pair = np.zeros((STATES, STATES))
    if not pages:
        return Model({}, pair, heads)
    times = Counter(x for f, _ in pages for keys in f for x in keys)
    number = {x: i for i, x in enumerate(x for x, n in times.items() if n > 1 or isinstance(x, int))}
    lengths = np.array([len(f) for f, _ in pages])
    count, longest = len(pages), int(lengths[0])
    # block (page i, place t) has number offset[t] + i: pages are sorted, so the pages that reach t are the first ones
    alive = np.array([(lengths > t).sum() for t in range(longest)])
    offset = np.concatenate([[0], np.cumsum(alive)])
    order: list[list[int]] = [[]] * int(offset[-1])
    allowed = np.zeros((len(order), STATES), bool)
    for i, (f, lab) in enumerate(pages):
        for t, (x, y) in enumerate(zip(f, lab, strict=True)):
            order[offset[t] + i] = [number[k] for k in x if k in number]
            allowed[offset[t] + i] = y
    sizes = np.array([len(x) for x in order])
    index = np.fromiter((x for f in order for x in f), np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(order)), sizes)
    w = np.zeros((len(number), STATES))
    barred = np.where(allowed, 0.0, -1e4)
    mom = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]

    def expectations(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the blocks and sums of those of the transitions."""
        peak = score.max(1, keepdims=True)
        e, trans = np.exp(score - peak), np.exp(pair)
        fwd, bwd = np.zeros_like(e), np.ones_like(e)
        fwd[: alive[0]] = e[: alive[0]] / e[: alive[0]].sum(1, keepdims=True)
        for t in range(1, longest):
            a = alive[t]
            now = (fwd[offset[t - 1] : offset[t - 1] + a] @ trans) * e[offset[t] : offset[t] + a]
            fwd[offset[t] : offset[t] + a] = now / np.maximum(now.sum(1, keepdims=True), 1e-300)
        edges = np.zeros_like(pair)
        for t in range(longest - 2, -1, -1):
            a = alive[t + 1]
            right = e[offset[t + 1] : offset[t + 1] + a] * bwd[offset[t + 1] : offset[t + 1] + a]
            here = right @ trans.T
            left = fwd[offset[t] : offset[t] + a]
            joint = left[:, :, None] * trans[None] * right[:, None, :]
            edges += (joint / np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)).sum(0)
            bwd[offset[t] : offset[t] + a] = here / np.maximum(here.sum(1, keepdims=True), 1e-300)
        m = fwd * bwd
        return m / np.maximum(m.sum(1, keepdims=True), 1e-300), edges

    for step in range(1, rounds + 1):
        score = np.add.reduceat(w[index], starts)
        free, free_edges = expectations(score)
        held, held_edges = expectations(score + barred)
        diff = free - held
        grad = np.stack([np.bincount(index, diff[owner, k], len(number)) for k in range(STATES)], 1)
        for k, (param, g) in enumerate(((w, grad / count + decay * w / 10), (pair, (free_edges - held_edges) / count + decay * pair))):
            mom[2 * k] = 0.9 * mom[2 * k] + 0.1 * g
            mom[2 * k + 1] = 0.99 * mom[2 * k + 1] + 0.01 * g * g
            param -= rate * (mom[2 * k] / (1 - 0.9**step)) / (np.sqrt(mom[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return Model({x: tuple(w[i].tolist()) for x, i in number.items()}, pair, heads)


# ---------------------------------------------------------------------------------------------------------------------
# Training


def _long_line(text: str) -> int:
    """Number of a page by its longest line: copies of a page have the same."""
    lines = text.split("\n")
    size = max(map(len, lines))
    longest = max(x for x in lines if len(x) == size)
    return int.from_bytes(blake2b(longest.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def long_start(raw: str, names: tuple[str, ...]) -> str:
    """First ``_START`` characters of the form of a long line from its own first ones; empty if they don't settle that it is long and starts so."""
    start = normal(raw[: 2 * SHORT], names)
    # only the end of what was cut off can read otherwise in the whole line: a name, a figure or a letter that goes on
    return start[:_START] if len(start) > SHORT + _START and all(len(x) <= _START for x in names) else ""


def form_counts(docs: DataFrame, forms: set[str], sites: set[str]) -> tuple[dict[tuple[str, str], int], dict[str, tuple[int, int]], dict[str, int], int]:
    """Over all pages: by (site, form) and by form the pages (and sites) that have it, by site the pages, and all pages.

    Counted are the given forms only, and what reaches the driver has a row for each of them and each of its given sites.
    A long line is read in whole if it starts as one of the given forms does.
    """
    given = docs.sparkSession.sparkContext.broadcast((frozenset(forms), frozenset(f[:_START] for f in forms if len(f) > SHORT)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, starts = given.value
        for b in batches:
            rows = set()
            for text, site in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names, page = site_names(site), None
                for raw in dict.fromkeys(text.split("\n")):
                    if not raw or raw.isspace():
                        continue
                    if len(raw) > 2 * SHORT and (start := long_start(raw, names)) and start not in starts:
                        continue
                    form = normal(raw, names)
                    for f in (form, *leads(form)):
                        if f in wanted:
                            page = _long_line(text) if page is None else page
                            rows.add((site, f, page))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["site", "form", "page"])

    spark = docs.sparkSession
    own = docs.where("text is not null").select("text", F.lower(F.trim(F.coalesce("site", F.lit("")))).alias("site"))
    # two steps, so that a line of a third of all pages is spread out before it comes together
    found = table(own.mapInArrow(run, "site string, form string, page long").groupBy("site", "form", "page").agg(F.lit(1).alias("one")), "forms")
    by_site = found.groupBy("site", "form").agg(F.count("*").alias("n"))
    ours = F.broadcast(spark.createDataFrame([(s,) for s in sorted(sites)], "site string"))
    local = {(r.site, r.form): r.n for r in by_site.join(ours, "site").where(f"n >= {SITE_PAGES}").collect()}
    total = found.groupBy("form", "page").agg(F.lit(1).alias("one")).groupBy("form").agg(F.count("*").alias("n")).join(by_site.groupBy("form").agg(F.count("*").alias("s")), "form")
    whole = {r.form: (r.n, r.s) for r in total.where(f"n >= {ALL_PAGES}").collect()}
    pages = own.groupBy("site").agg(F.count("*").alias("n"))
    size = {r.site: r.n for r in pages.join(ours, "site").collect()}
    return local, whole, size, own.count()


def train(docs: DataFrame, pages: int = TRAIN_PAGES) -> Model:
    """Model fitted on at most ``pages`` whole pages (id, text, site) drawn by hash, labelled by counts over all pages."""
    drawn = docs.where("text is not null").select("id").orderBy(F.xxhash64("id", F.lit(17)), "id").limit(pages)
    some = docs.select("id", "text", "site").join(F.broadcast(drawn), "id", "left_semi").where("text is not null").collect()
    some.sort(key=lambda r: (r.id, r.text))
    read = [blocks(r.text, r.site) for r in some]
    of = [(r.site or "").strip().lower() for r in some]
    forms = {f for p in read for x in p.lines for f in (x.form, *leads(x.form)) if not wordless(f)}
    local, whole, size, n = form_counts(docs, forms, set(of))

    def known(site: str, form: str, kind: int) -> bool:
        factor = 2 if kind <= _K["sentence"] else 1
        here, (all_, sites) = local.get((site, form), 0), whole.get(form, (0, 0))
        return here >= factor * max(SITE_PAGES, SITE_SHARE * size.get(site, 0)) or all_ >= factor * max(ALL_PAGES, ALL_SHARE * n) and sites >= ALL_SITES

    repeated = [[known(s, x.form, x.kind) for x in p.lines] for p, s in zip(read, of, strict=True)]
    part = [[any(known(s, f, _EDGE) for f in leads(x.form)) for x in p.lines] for p, s in zip(read, of, strict=True)]
    heads = box_heads(read, repeated)
    return fit([(features(p, heads), label_page(p, r, t, heads)) for p, r, t in zip(read, repeated, part, strict=True)], heads)


def furniture_lines(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(id, line_no) of every furniture line of docs (id, text, site)."""
    given = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = given.value
        for b in batches:
            ids: list[int] = []
            lines: list[int] = []
            for i, text, site in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                at, states = own.page(text, site)
                found = [n for n, s in zip(at, states, strict=True) if s != BODY]
                ids += [i] * len(found)
                lines += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int64())], names=["id", "line_no"])

    return docs.where("text is not null").select("id", "text", "site").mapInArrow(run, "id long, line_no long")


def main_bodies(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(id, body): the text without its furniture lines; other lines, blank ones included, stay as they are.  Null stays null."""
    given = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = given.value
        for b in batches:
            out = []
            for text, site in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out.append(None if text is None else own_body(own, text, site))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.string())], names=["id", "body"])

    return docs.select("id", "text", "site").mapInArrow(run, "id long, body string")


def own_body(model: Model, text: str, site: str | None) -> str:
    at, states = model.page(text, site)
    drop = {n for n, s in zip(at, states, strict=True) if s != BODY}
    return "\n".join(line for n, line in enumerate(text.split("\n")) if n not in drop) if drop else text
