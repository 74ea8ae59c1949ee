"""Personal data in free text: spans proposed by patterns, confirmed by check digits, weighed by the words around them.

Each pattern proposes spans of one kind with a starting score.  A validator (Luhn-like weighted sums, modulo 97, 23, 11,
ISO 7064) raises it or, where it fails, lowers it below ``KEEP``; context words before the span move it further; a span is kept
from ``KEEP`` on, so that a number that fails its check digit is one only where the text says what it is.  Where spans overlap,
the higher score, then the longer, then the earlier one stays.

Names are found by titles, initials, given names (a list of frequent ones and the lexicon) and by family names.  What a family
name ends in, and what characters Chinese given names have, is learned by ``learn`` from grouped counts over all texts: endings
of capitalised words that mostly stand behind a given name, title or initial, and characters that mostly stand behind a family
name.

Nulls give null text and no spans.  Texts are scanned whole.  Offsets are code points from 0.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prose

KEEP = 0.5
#: Characters before and after a span whose words count as its context.
REACH = 48


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


# ---------------------------------------------------------------------------------------------------------------------
# Check digits


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return bool(digits) and total % 10 == 0


def mod97(digits: str) -> bool:
    """Key of 13 digits: 97 minus their remainder."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def iban(number: str) -> bool:
    """The first four characters moved to the end, letters as 10 to 35: remainder 1 by 97."""
    s = "".join(number.split())
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def mod23(number: str) -> bool:
    """Eight digits, or a letter X, Y, Z for a first digit 0, 1, 2, and a control letter."""
    s = "".join(c for c in number.upper() if c.isalnum())
    if len(s) != 9:
        return False
    body = {"X": "0", "Y": "1", "Z": "2"}.get(s[0], s[0]) + s[1:8]
    return body.isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(body) % 23] == s[8]


def mod11_weighted(digits: str) -> bool:
    """Nine digits; the last is 11 minus the sum weighted 9..2, or 0 from 10 on."""
    if len(digits) != 9:
        return False
    c = 11 - sum(int(d) * w for d, w in zip(digits, range(9, 1, -1), strict=False)) % 11
    return (0 if c > 9 else c) == int(digits[8])


def iso7064_11_10(digits: str) -> bool:
    """Eleven digits with a hybrid modulo 11, 10 check digit."""
    if len(digits) != 11:
        return False
    p = 10
    for c in digits[:10]:
        s = (int(c) + p) % 10 or 10
        p = 2 * s % 11
    return (11 - p) % 10 == int(digits[10])


def iso7064_11_2(number: str) -> bool:
    """Seventeen digits and a check character 0-9 or X."""
    s = number.upper()
    if len(s) != 18 or not s[:17].isdigit():
        return False
    return "10X98765432"[sum(int(c) * pow(2, 17 - i, 11) for i, c in enumerate(s[:17])) % 11] == s[17]


def mod10_731(number: str) -> bool:
    """Letters and digits weighted 7, 3, 1; the last is the check digit."""
    s = number.upper()
    value = [int(c, 36) for c in s[:-1]]
    return s[-1].isdigit() and sum(v * (7, 3, 1)[i % 3] for i, v in enumerate(value)) % 10 == int(s[-1])


# ---------------------------------------------------------------------------------------------------------------------
# Patterns.  Each: kind, expression (group "s" is the span, or the whole match), starting score, validator, gain, loss.

# Words by which an address names its street, by language.
_EN_STREET = r"(?:Street|St\.|Road|Rd|Lane|Ln|Avenue|Ave|Close|Terrace|Drive|Crescent|Square|Court|Way)"
_FR_STREET = r"(?:rue|avenue|chemin|place|impasse|boulevard|allée|allee|quai|cours|route)"
_ES_STREET = r"(?:Calle|Cl\.|C/|Avenida|Avda\.?|Av\.|Plaza|Pl\.|Paseo|P\.º|Camino|Ronda|Travesía|Travesia)"
_PT_STREET = r"(?:Rua|R\.|Largo|Avenida|Av\.|Travessa|Tv\.|Praça|Praca|Pç\.|Pc\.|Beco|Alameda|Estrada)"
_DE_STREET = r"(?:straße|strasse|str\.|gasse|allee|weg|platz|ring|ufer|damm)"

_U, _L = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_LETTERS = r"[^\W\d_]"
_WORD = rf"[{_U}](?:{_LETTERS}|['’])+"
_G = r"[ \t ]{1,3}"

ADDRESS = [
    rf"(?<![\w.,/-])\d{{1,4}}[a-z]?{_G}(?:{_WORD}{_G}){{1,2}}{_EN_STREET}(?!\w)",
    rf"\b[{_U}]{_LETTERS}+?(?:{_DE_STREET}){_G}\d{{1,4}}[a-z]?(?!\w)",
    rf"(?<![\w.,/-])\d{{1,4}}(?:{_G}?(?:bis|ter|quater|[a-d]))?,?{_G}{_FR_STREET}{_G}(?:de{_G}la|de{_G}l['’]|des|du|de|d['’])(?:{_G})?{_WORD}",
    rf"(?<!\w){_ES_STREET}(?:{_G})?(?:de{_G}la|de{_G}las|de{_G}los|del|de)?{_G}{_WORD},{_G}\d{{1,4}}(?!\w)",
    rf"(?<!\w){_PT_STREET}{_G}(?:da|do|das|dos|de){_G}{_WORD},{_G}\d{{1,4}}(?!\w)",
    r"(?:[一-鿿]{2}市)?(?:[一-鿿]{2}区)?[一-鿿]{2}(?:街|路|大道|巷|胡同)\d{1,4}号",
]

_SEP = r"[  .\-/]?"
#: (expression, starting score).  Area codes are written out where a country's plan reserves them for invented numbers.
#: One of these is in every address of the pattern at the same place.
STREETS = [
    "Street|St.|Road|Rd|Lane|Ln|Ave|Close|Terrace|Drive|Crescent|Square|Court|Way",
    "straße|strasse|str.|gasse|allee|weg|platz|ring|ufer|damm",
    " rue| avenue| chemin| place| impasse| boulevard| allée| allee| quai| cours| route",
    "Calle|Cl.|C/|Av|Pl|Paseo|P.º|Camino|Ronda|Traves",
    "Rua|R.|Largo|Av|Tra|Tv.|Pra|Pç.|Pc.|Beco|Alameda|Estrada",
    "号",
]
PHONE = [
    (r"\+\d{1,3}[ .\-]?(?:\(0\)[ ]?|\(\d{2,4}\)[ .\-]?)?\d(?:[ .\-/]?\d){6,11}", 0.8),
    (r"\(\+\d{1,3}\)[ .\-]?\d(?:[ .\-]?\d){6,11}", 0.8),
    (r"00[1-9]\d{0,2}[ .\-]?\d{2,4}(?:[ .\-]?\d){6,9}", 0.6),
    (r"\(\d{3}\)[ ]?\d{3}-\d{4}", 0.8),
    (r"\d{3}([.\-])\d{3}\1\d{4}", 0.7),
    (r"0\d{4}[ ]\d{6}|0\d{4}[ ]\d{3}[ ]\d{3}|0\d{10}", 0.6),
    (r"\(0\d{2,4}\)[ ]?\d{5,8}(?:-\d{2,4})?|0\d{2}[ /\-]\d{5}[ \-]?\d{3}|0\d{2}[ /]\d{8}", 0.75),
    (r"0[1-9]([ .\-])\d{2}(?:\1\d{2}){3}|0[1-9]\d{8}", 0.55),
    (r"[2-9]\d{2}([ \-.])\d{3}\1\d{3}|[2-9]\d{8}", 0.45),
    (r"[2-9]\d{2}([ \-.])\d{2}\1\d{2}\1\d{2}", 0.45),
    (r"\(0\d{2,3}\)[ ]?\d{8}|0\d{2,3}-\d{8}|1\d{2}-\d{4}-\d{4}|1\d{10}|1\d{2}[ ]\d{4}[ ]\d{4}", 0.6),
]

ID = [
    (r"9\d{2}([ \-])\d{2}\1\d{4}", 0.6, None),
    (r"(?!000|666)[0-8]\d{2}-(?!00)\d{2}-(?!0000)\d{4}", 0.5, None),
    (r"[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]", 0.65, None),
    (r"[A-Z]\d{8}", 0.5, None),
    (r"\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}|\d{11}", 0.25, lambda s: iso7064_11_10(_digits(s))),
    (r"[A-Z](?=[0-9A-Z]*\d[A-Z])[0-9A-Z]{7}\d", 0.45, mod10_731),
    (r"\d{1,2}\.?\d{3}\.?\d{3}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]", 0.5, mod23),
    (r"[12]\d{14}|[12]([ .])\d{2}\1\d{2}\1\d{2}\1\d{3}\1\d{3}\1\d{2}", 0.5, lambda s: mod97(_digits(s))),
    (r"\d{3}[ ]\d{3}[ ]\d{3}|\d{9}", 0.05, lambda s: mod11_weighted(_digits(s))),
    (r"\d{17}[\dXx]", 0.5, iso7064_11_2),
    (r"[3-6]\d{3}([ \-])\d{4}\1\d{4}\1\d{1,7}|[3-6]\d{3}[ \-]\d{6}[ \-]\d{5}|[3-6]\d{12,18}", 0.3, lambda s: luhn(_digits(s))),
]
#: Account numbers: two letters, two check digits, up to 30 letters and digits.
IBAN = r"(?<![\w.])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)"
#: What a failed check takes from the score of a pattern that would be kept by itself.
FAILED = 0.1

AT = r"@|＠|[(\[{] ?at ?[)\]}]"
LOCAL_MARKS = frozenset(".%+-_")
DOMAIN = r"[ ]?[^\W_][\w\-]*(?:(?:\.|[ ]?[(\[{][ ]?dot[ ]?[)\]}][ ]?)[\w\-]+)*(?:\.|[ ]?[(\[{][ ]?dot[ ]?[)\]}][ ]?)[A-Za-z]{2,}"

# Titles that may stand before a surname.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Hr", "Fr", "Mme", "Mlle", "Me", "Monsieur", "Madame", "Sr", "Sra", "Srta", "Dra", "Don", "Doña", "Dona", "Dª", "Señor", "Señora", "Senhor", "Senhora", "Dña")
#: Titles of one language only, also single letters, which elsewhere are initials.
OWN_TITLES = {"M": ("fr",), "Me": ("fr",), "D": ("es", "pt"), "Don": ("es", "pt"), "Fr": ("de",), "Hr": ("de",)}
# Frequent given names in the languages of Western Europe.
GIVEN = """
    James Robert John Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Paul Steven Andrew George Edward Brian Kevin Henry
    Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Emily Emma Alice Helen Anna Jane Laura Rachel
    Hans Peter Klaus Wolfgang Jürgen Dieter Uwe Stefan Andreas Markus Jan Lukas Heinrich Friedrich Karl Martin Bernd Günter
    Angela Ursula Monika Petra Sabine Renate Claudia Julia Katharina Birgit Helga Ingrid Anke
    Jean Pierre Michel Philippe Alain Nicolas Christophe Laurent François Jacques Olivier Antoine Marie Nathalie Isabelle Sylvie Catherine Martine Françoise Camille Chloé
    José Antonio Juan Manuel Francisco Luis Javier Carlos Miguel Alejandro Pablo Diego María Carmen Ana Isabel Dolores Teresa Lucía Elena
    João Pedro Paulo Rui Tiago Ricardo Nuno Fernando Mariana Beatriz Inês Catarina Sofia Margarida"""
#: Words that follow a proper name of a place or body, never of a person.
BODIES = ("Museum", "Press", "Library", "Station", "Valley", "Works", "Archive", "Gazette", "Laboratory", "Harbour", "Foundation", "Institute", "Society", "Bridge", "Island")

# Frequent Chinese family names.
ZH_FAMILY = ("司马", "欧阳", "诸葛", "上官", "陈", "郭", "孙", "李", "王", "赵", "罗", "林", "周", "徐", "吴", "梁", "何", "高", "黄", "马", "朱", "胡", "张", "刘", "杨", "郑", "谢", "宋", "唐", "许", "韩", "冯", "邓", "曹", "彭", "曾", "萧", "田", "董", "袁", "潘", "于", "蒋", "蔡", "余", "杜", "叶", "程", "苏", "魏", "吕", "丁", "任", "沈", "姚", "卢", "姜", "崔", "钟", "谭", "陆", "汪", "范", "石", "廖", "贾", "夏", "韦", "付", "方", "白", "邹", "孟", "熊", "秦", "邱", "江", "尹", "薛", "闫", "段", "雷", "侯", "龙", "史", "陶", "黎", "贺", "顾", "毛", "郝", "龚", "邵", "万", "钱", "严", "覃", "武", "戴", "莫", "孔", "向", "汤")

# Context words by kind, with what they add to a score.
CONTEXT = {
    "phone": (r"\b(?:tel|phone|call|mobile|ring|reach|fax|telefon|rufen|anrufen|erreich\w*|unter|appelez|joindre|téléphone|llame|teléfono|telefono|ligue|telefone)\b|电话|拨打|手机|致电", 0.3),
    "id_number": (r"\b(?:ssn|social security|iban|(?:credit|debit) card|card number|kreditkarte|identity|identit\w*|ID|passport|holder|kennung|ausweis\w*|steuer\w*|numéro|numero|documento|dni|nif|nie|identidad|identificação|identificacao|pessoal)\b|证件|身份证", 0.45),
}
#: Words of numbers that belong to things.
THINGS = (r"\b(?:order|reference|shelf|mark|checksum|version|ticket|bestellnummer|signatur|prüfsumme|pruefsumme|vorgang|commande|cote|référence|reference|referência|referencia|pedido|signatura|incidencia|caso|cota|somme)\b|订单|编号|校验|问题|索书", -0.5)


@lru_cache(maxsize=50_000)
def plain(s: str) -> str:
    """Without accents."""
    if s.isascii():
        return s
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


#: A word that starts with a capital, or an initial with its full stop.
_CAP = re.compile(rf"(?<![\w@])(?:[{_U}](?:{_LETTERS}|['’](?={_LETTERS}))+(?:-[{_U}]{_LETTERS}+)*\.?|[{_U}]\.)")
_COMMA_GIVEN = re.compile(rf",{_G}(?P<after>[{_U}]{_LETTERS}+(?:-[{_U}]{_LETTERS}+)?|[{_U}]\.)(?!\w)")
_HAN = re.compile(r"[一-鿿]")
_ENDING = range(3, 7)
_ZH_TITLES = "先生|女士|小姐|太太|老师|教授|医生|博士|经理|律师"


class Learned(NamedTuple):
    """What was learned of names: endings of family names, characters of Chinese given names."""

    endings: frozenset[str] = frozenset()
    zh_given: frozenset[str] = frozenset()


class Token(NamedTuple):
    start: int
    end: int
    text: str
    low: str


def capitals(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """Capitalised words and initials: start, end, text, and whether it stands beside the one before with blanks between."""
    end, before = -9, ""
    for m in _CAP.finditer(text):
        a, b = m.span()
        word = m[0]
        # the full stop belongs to an initial or a title; else it ends a sentence
        if len(word) > 2 and word[-1] == ".":
            word, b = word[:-1], b - 1
        yield a, b, word, a - end <= 4 and _joined(text[end:a], before)
        end, before = b, word


def runs(text: str) -> Iterator[list[Token]]:
    """Capitalised words and initials that stand beside each other, or one alone before a comma."""
    run: list[tuple[int, int, str]] = []
    for a, b, word, beside in capitals(text):
        if beside:
            run.append((a, b, word))
            continue
        if len(run) > 1 or run and text[run[0][1] : run[0][1] + 1] == ",":
            yield [Token(x, y, w, plain(w.lower())) for x, y, w in run]
        run = [(a, b, word)]
    if len(run) > 1 or run and text[run[0][1] : run[0][1] + 1] == ",":
        yield [Token(x, y, w, plain(w.lower())) for x, y, w in run]


def _joined(between: str, before: str) -> bool:
    if between[:1] == ".":
        if before not in ALL_TITLES:
            return False
        between = between[1:]
    return between.strip(" \t\xa0") == "" and "\n" not in between and (bool(between) or before[-1] == ".")


ALL_TITLES = frozenset(TITLES) | frozenset(OWN_TITLES)


class Finder:
    """Compiled patterns; one for each Python worker."""

    def __init__(self, given: frozenset[str] = frozenset(), families: frozenset[str] = frozenset(), bodies: frozenset[str] = frozenset(), learned: Learned = Learned()):
        c = re.compile
        self.bodies = frozenset(w.lower() for w in (*BODIES, *bodies))
        self.given = frozenset(plain(g.lower()) for g in (*GIVEN.split(), *given))
        self.endings = learned.endings
        self._like: dict[str, bool] = {}
        self.at, self.domain = c(AT), c(DOMAIN)
        self.address = [c(p) for p in ADDRESS]
        self.flat = c(rf"(?:Flat|Apt|Unit){_G}\d+[a-z]?,?{_G}$")
        after = r"(?![^\W_]|[.\-:, ]\d|/)"
        self.phone = [(c(rf"(?:{p}){after}"), s) for p, s in PHONE]
        self.ids = [(c(rf"(?:{p}){after}"), s, v) for p, s, v in ID]
        self.iban = c(IBAN)
        #: where a number with at least six digits starts
        self.number = c(r"(?<![A-Za-z0-9_.+/\-])(?:\+|\(\+?|[A-Z]{1,2}[ ]?)?\d(?:(?:[ .\-/]?\(|[ .\-/]|\)[ ]?|[A-Z])?\d){5,}")
        self.streets = [(p, w.split("|")) for p, w in zip(self.address, STREETS, strict=True)]
        self.cell = c(r"(?:^|[;|│\t\n]|[ ]{2})[ ]?$"), c(r"[ ]?(?:$|[;|│\t\n]|[ ]{2})")
        self.context = {k: (c(p, re.I), w) for k, (p, w) in CONTEXT.items()}
        self.things = c(THINGS[0], re.I)
        family = self.family = zh_families(families)
        chars = "".join(sorted(learned.zh_given))
        free = r"(?<![一-鿿])", r"(?![一-鿿])"
        self.zh_name = c((rf"(?:{family})[{chars}]{{1,2}}|" if chars else "") + rf"{free[0]}(?:{family})[一-鿿]{{1,2}}(?={_ZH_TITLES})|(?:(?<=^)|(?<=\n)|(?<=[，。；：、！？（\s]))(?:{family})[一-鿿]{{1,2}}(?=[ \xa0])")
        self.zh_place = c(r"(?:实验室|图书馆|博物馆|档案馆|出版社|基金会|研究院|学会|工坊|山谷|[桥岛港站河市区街路])")

    def _context(self, text: str, a: int, b: int, kind: str) -> float:
        before = text[max(0, a - REACH) : a]
        for cut in ("\n", ". ", "。", "? ", "! "):  # only words of the same sentence
            before = before.rsplit(cut, 1)[-1]
        score = 0.0
        for k, (p, w) in self.context.items():
            if p.search(before):
                score += w if k == kind else -w
        if self.things.search(before):
            score += THINGS[1]
        left, right = self.cell
        if score == 0.0 and left.search(text, max(0, a - 3), a) and right.match(text, b):
            score += 0.1  # alone in a table cell or line
        return score

    def _numbers(self, text: str) -> Iterator[Span]:
        for a in (m.start() for m in self.number.finditer(text)):
            for p, s, valid in self.ids:
                if m := p.match(text, a):
                    score = s + self._context(text, a, m.end(), "id_number")
                    yield Span(a, m.end(), "id_number", score + (0.0 if valid is None else 0.35 if valid(m[0]) else -FAILED if s >= KEEP else 0.0))
            for p, s in self.phone:
                if m := p.match(text, a):
                    yield Span(a, m.end(), "phone", s + self._context(text, a, m.end(), "phone"))
        for m in self.iban.finditer(text):
            yield Span(m.start(), m.end(), "id_number", 1.0 if iban(m[0]) else 0.2)

    def _emails(self, text: str) -> Iterator[Span]:
        floor = 0
        for m in self.at.finditer(text):
            # back to where the local part starts, however far that is, but not beyond the address before
            end = m.start() - (text[m.start() - 1 : m.start()] == " ")
            a = end
            while a > floor and (text[a - 1].isalnum() or text[a - 1] in LOCAL_MARKS):
                a -= 1
            while a < end and not text[a].isalnum():
                a += 1
            domain = self.domain.match(text, m.end())
            if a < end and text[end - 1] != "." and domain:
                yield Span(a, domain.end(), "email", 1.0)
            floor = m.end()

    def family_like(self, low: str) -> bool:
        """Whether a word has an ending of family names, in any part of a double name."""
        if (known := self._like.get(low)) is None:
            if len(self._like) > 100_000:
                self._like.clear()
            known = self._like[low] = any(part[-k:] in self.endings for part in low.split("-") for k in _ENDING if len(part) > k)
        return known

    def _language(self, text: str, a: int) -> frozenset[str]:
        """Languages most of whose frequent words stand around a place."""
        seen: dict[str, int] = {}
        for w in re.findall(r"[^\W\d_]+", prose.plain(text[max(0, a - 80) : a + 80])):
            for x in prose.WORD_LANGS.get(w, ()):
                seen[x] = seen.get(x, 0) + 1
        most = max(seen.values(), default=0)
        return frozenset(x for x, n in seen.items() if n == most)

    def _title(self, text: str, t: Token) -> bool:
        word = t.text.rstrip(".")
        if word in OWN_TITLES:
            return bool(self._language(text, t.start) & set(OWN_TITLES[word]))
        return word in TITLES

    def _run(self, text: str, run: list[Token]) -> Iterator[Span]:
        """Names among words that stand beside each other."""
        i, n = 0, len(run)
        while i < n:
            t = run[i]
            title = i + 1 < n and t.text.rstrip(".") in ALL_TITLES and self._title(text, t)
            first = i + title
            # given names and initials, then a family name
            j = first
            while j < n - 1 and j - first < 3 and (run[j].low in self.given or run[j].text[-1] == "." or run[j].low.split("-")[0] in self.given):
                j += 1
            last = run[j]
            body = last.low in self.bodies or j + 1 < n and run[j + 1].low in self.bodies
            word = last.text[-1] != "." and not body and last.text.rstrip(".") not in ALL_TITLES
            like = word and self.family_like(last.low)
            score = 0.0
            if word and j > first:
                initial = run[first].text[-1] == "." and len(run[first].text) == 2
                known = like or last.low not in prose.ANY_COMMON
                score = 0.4 + 0.4 * like if initial else (0.7 + 0.3 * like) * known
            elif word and title:
                score = 0.9 if like or last.low not in prose.ANY_COMMON else 0.0
            if score:
                behind = _COMMA_GIVEN.match(text, last.end) if j == first else None
                end = behind.end() if behind and plain(behind["after"].lower()) in self.given else last.end
                yield Span(run[first].start, end, "name", score)
                i = j + 1
                continue
            if word and like and j == first:
                behind = _COMMA_GIVEN.match(text, last.end)
                if behind and (plain(behind["after"].lower()) in self.given or len(last.low) > 5):
                    yield Span(last.start, behind.end(), "name", 0.9 if plain(behind["after"].lower()) in self.given else 0.55)
            elif word and j == first and (behind := _COMMA_GIVEN.match(text, last.end)) and plain(behind["after"].lower()) in self.given and last.low not in prose.ANY_COMMON and last.low not in self.given:
                yield Span(last.start, behind.end(), "name", 0.5)
            # a capitalised word that is no known given name before a family name
            if i + 1 < n and j == i and len(t.text) > 1 and t.text[-1] != "." and t.low not in prose.ANY_COMMON and t.low not in self.bodies and t.text not in ALL_TITLES:
                nxt = run[i + 1]
                if nxt.text[-1] != "." and self.family_like(nxt.low) and nxt.low not in self.bodies and not (i + 2 < n and run[i + 2].low in self.bodies) and (not nxt.text.isupper() or t.text.isupper() and self._apart(text, t.start, nxt.end)):
                    yield Span(t.start, nxt.end, "name", 0.6)
                    i += 2
                    continue
            i += 1

    @staticmethod
    def _apart(text: str, a: int, b: int) -> bool:
        """Whether capitals stand among lower case."""
        return any(c.islower() for c in text[max(0, a - 12) : a] + text[b : b + 12])

    def _names(self, text: str) -> Iterator[Span]:
        for run in runs(text):
            yield from self._run(text, run)
        if _HAN.search(text):
            for m in self.zh_name.finditer(text):
                if not self.zh_place.match(text, m.end()):
                    yield Span(m.start(), m.end(), "name", 0.7)

    def find(self, text: str) -> list[Span]:
        """Spans of a text, without overlaps, in order."""
        spans: list[Span] = list(self._emails(text))
        spans += self._numbers(text)
        for p, words in self.streets:
            for m in p.finditer(text) if any(w in text for w in words) else ():
                a = m.start()
                flat = self.flat.search(text, max(0, a - 16), a)
                spans.append(Span(flat.start() if flat else a, m.end(), "address", 0.9))
        spans += self._names(text)
        taken: list[Span] = []
        for s in sorted((s for s in spans if s.score >= KEEP), key=lambda s: (-s.score, s.start - s.end, s.start)):
            at = bisect_left(taken, s.start, key=lambda t: t.start)
            if (at == 0 or taken[at - 1].end <= s.start) and (at == len(taken) or taken[at].start >= s.end):
                taken.insert(at, s)
        return taken


def zh_families(families: frozenset[str]) -> str:
    """Pattern of Chinese family names; longer ones first."""
    own = sorted({f for f in {*families, *ZH_FAMILY} if _HAN.match(f)}, key=lambda f: (-len(f), f))
    return "|".join([*(f for f in own if len(f) > 1), "[" + "".join(f for f in own if len(f) == 1) + "]"])


#: Least occurrences behind a cue, and least share of all occurrences, of an ending; the same of a character, with its share behind any family name.
LEAST_CUES, CUE_SHARE = 4, 0.3
LEAST_CHARS, CHAR_SHARE, FAMILY_SHARE = 3, 0.25, 0.8


def learn(docs: DataFrame, given: frozenset[str] = frozenset(), families: frozenset[str] = frozenset()) -> Learned:
    """Endings of family names and characters of given names, from counts over all texts (id, text).

    Counted are endings of three to six letters of capitalised words, and Han characters; only those that stand behind a cue often
    enough reach the driver.
    """
    base = Finder(given, families)
    first = re.compile(rf"(?<![一-鿿])(?:{base.family})([一-鿿])([一-鿿])?")
    any_ = re.compile(rf"(?:{base.family})([一-鿿])([一-鿿])?")
    known = base.given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every: dict[tuple[str, int], list[int]] = {}
            for text in b.column(0).to_pylist():
                before = ""
                for _, _, word, beside in capitals(text):
                    low = plain(word.lower())
                    if len(low) >= 5 and low.isalpha() and not word.isupper() and low not in base.bodies:
                        cue = beside and (before in ALL_TITLES or before[-1] == "." or plain(before.lower()) in known)
                        for k in _ENDING:
                            if len(low) > k:
                                row = every.setdefault((low[-k:], 0), [0, 0, 0])
                                row[0] += 1
                                row[1] += cue
                    before = word
                if _HAN.search(text):
                    for c in _HAN.findall(text):
                        every.setdefault((c, 1), [0, 0, 0])[0] += 1
                    for at, p in ((1, first), (2, any_)):
                        for pair in p.findall(text):
                            for c in filter(None, pair):
                                every[c, 1][at] += 1
            keys = list(every)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([every[k][i] for k in keys], pa.int64()) for i in range(3))], names=["gram", "han", "n", "cued", "near"])

    counts = docs.where("text is not null").select("text").mapInArrow(run, "gram string, han long, n long, cued long, near long")
    sums = counts.groupBy("gram", "han").agg(*(F.sum(c).alias(c) for c in ("n", "cued", "near")))
    good = sums.where(f"(han = 0 and cued >= {LEAST_CUES} and cued >= {CUE_SHARE} * n) or (han = 1 and cued >= {LEAST_CHARS} and cued >= {CHAR_SHARE} * n and near >= {FAMILY_SHARE} * n)")
    rows = good.select("gram", "han").collect()
    return Learned(frozenset(r.gram for r in rows if not r.han), frozenset(r.gram for r in rows if r.han))


def mask(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


def _finder(docs: DataFrame, lexicon: DataFrame | None, entities: DataFrame | None) -> Callable[[], Finder]:
    """The lexicon (name_form, form_kind) and the entity list (name_en) are short lists kept by hand; every worker gets them once.
    Of entities only the last words count: what follows a proper name in the name of a place or body."""
    rows = [] if lexicon is None else lexicon.where("name_form is not null").select("name_form", "form_kind").distinct().collect()
    given = frozenset(r.name_form for r in rows if r.form_kind == "given")
    families = frozenset(r.name_form for r in rows if r.form_kind == "family")
    last = [] if entities is None else entities.select(F.element_at(F.split(F.trim("name_en"), " +"), -1).alias("w")).where("length(w) > 2").distinct().collect()
    shared = docs.sparkSession.sparkContext.broadcast((given, families, frozenset(r.w for r in last), learn(docs, given, families)))
    return lambda: Finder(*shared.value)


def mentions(docs: DataFrame, lexicon: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """(id, start_pos, end_pos, kind, score) of each mention in docs (id, text)."""
    make = _finder(docs, lexicon, entities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = make()
        for b in batches:
            rows = [(i, s) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s in finder.find(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], pa.int64()), *(pa.array([s[k] for _, s in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.float64())))],
                names=["id", "start_pos", "end_pos", "kind", "score"],
            )

    return docs.where("text is not null").select("id", "text").mapInArrow(run, "id long, start_pos long, end_pos long, kind string, score double")


def redact(docs: DataFrame, lexicon: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """(id, text, n_masked) with typed placeholders such as [EMAIL] in place of personal data; null stays null."""
    make = _finder(docs, lexicon, entities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = make()
        for b in batches:
            texts = b.column(1).to_pylist()
            spans = [[] if t is None else finder.find(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([None if t is None else mask(t, s) for t, s in zip(texts, spans, strict=True)], pa.string()), pa.array(map(len, spans), pa.int64())],
                names=["id", "text", "n_masked"],
            )

    return docs.select("id", "text").mapInArrow(run, "id long, text string, n_masked long")
