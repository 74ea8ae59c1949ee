"""Text quality statistics of records, and outlier scores from their exact ranks within a language.

Each record gets word count, mean word length, symbol and digit ratio, share of lines that end in punctuation, share of common
words, and the share of its lines that are list items, table rows or no language.  Lines of page furniture don't count.

Ranks are exact: distinct values are counted first, sorted by range partitions, and every partition adds the offset of those
before it.  The two empirical-cumulative tail probabilities of each statistic combine into an outlier score, the sum of the
negative logarithms of the smaller tail.  A second score takes of the statistics of the layout (``LAYOUT``) only the tail that
lists, tables and dumps are in; records are ranked by it within their language, and ``outlying`` keeps the top of each language.

Nulls and blank texts give no row.  Statistics without a basis (no words, no lines) are 0.  A record without any language
belongs to no language's ranks; its score is infinite.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import furniture
from ..operators.joins import lookup, partitions
from ..store import table

PROSE, ITEM, ROW, NONE = 0, 1, 2, 3

# Frequent function words by language, without accents.
COMMON = {
    "en": "the of and to in a is that it was for on with as by at from this be are or an not but every another one our some have has there were which when if after before until only other their so because his her its we you i they he she",
    "de": "der die das und den dem des ein eine einen einem einer in im zu zur zum von vom mit auf fur ist es nicht aber denn doch ohne bei wir ich sich nur auch noch sondern man uber unter nach aus bis damit weil obwohl hinter neben am an war wie",
    "fr": "le la les l un une des du de d et en au aux a est que qu ce cette il ne pas mais sur avec sans pour par chez sous nous je s n plus ou quand bien donc car deux apres avant pendant comme pres parce afin fait",
    "es": "el la los las un una de del y en a al es que no por para con sin su se lo mas pero como desde hasta cuando aunque porque sobre tras encima detras junto nadie segun otros dos entre hay he mi solo este esta",
    "pt": "o a os as um uma de do da dos das e em no na nos nas ao que nao por para com sem se mas como ate quando embora porque sobre depois atras acima perto ninguem segundo outros duas entre foi foram ha meu so este esta pela pelo",
}
WORD_LANGS = {}
for _lang, _words in COMMON.items():
    for _w in _words.split():
        WORD_LANGS.setdefault(_w, []).append(_lang)
ANY_COMMON = frozenset(WORD_LANGS)

# Words that start a noun phrase, by language, without accents.
DETERMINERS = frozenset("the a an this that every another one our some der die das ein eine dieser diese dieses le la les l un une cette ce el los las una o os as um uma".split())

_DIGIT = re.compile(r"\d")
_LETTER = re.compile(r"[^\W\d_]")
_STRANGE = re.compile(r"[^\x00-\x7f\u3400-\u9fff\u3000-\u303f\uff00-\uffef“”‘’–—…]")
_NOISE = re.compile(r"^[A-Za-z\s]+$")
_HARSH = re.compile(r"[bcdfghjklmnpqrstvwxz]{4}|[aeiou]{4}|q(?!u)|[bcdfghjklmnpqrstvwxz]{3}$")
_ZH_STOP = re.compile(r"[，。；？！“”,.!?]")
_AMOUNT = re.compile(r"^\s*(?:\d{1,4} ?(?:x|g|kg|mg|ml|l|cm|mm|m|km|pcs|pc|st|oz|lb|Stk|Stück|uds|pz|个|件|克|千克|毫升|厘米)\b|\d{1,2}[:：.h]\d\d\b)")
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
#: Marks that end a sentence, and what may close behind them.
END_MARKS, CLOSERS = frozenset(".!?。！？…"), "\"”»“’')]）」』"
_LOG = re.compile(r"^\[?(?:\d{4}-\d\d-\d\d[ T])?\d\d:\d\d:\d\d\S* \[?[A-Z]{3,}|^(?:DEBUG|INFO|WARN|WARNING|ERR|ERROR|TRACE|FATAL)\b")
_CODE = re.compile(r"\w\(.*\)\s*;?\s*$.*|[;{}]\s*$")
_CODE_SIGN = re.compile(r"[=(){}\[\]<>]|->|:=")
_RULE = re.compile(r"^[\s|│+:;,\-=_]{3,}$")
_BLOB = 18
_MARK = re.compile(r"^\s*(?:[•*→▪●◦‣·■□▸✓]|\[[ xX]\]|>>|[-–—]|\(?\d{1,4}[.)]|\(?[a-zA-Z][.)])\s*(?=\S)|^(?:\t| {2,})(?=\S)")
_TALK = re.compile(r"^\s*(?:[-–—]|>+)\s*")
_SPEAKER = re.compile(r"^\s*(?:>+ ?)?(?:[\[<]?[a-z][\w.-]*\d+[\]>]?)(?: ?[:：|]|(?<=[\]>]) )")
_LABEL = re.compile(r"^[^\W\d_][^:：.!?]{0,40}[:：] ?\S")
_SEPARATORS = tuple((mark, re.compile(p)) for mark, p in (("|", r" ?\| ?"), ("│", r" ?│ ?"), ("\t", r"\t+"), (";", r";(?! )"), ("；", r"；"), ("   ", r" {3,}"), (",", r",(?=\S)")))
_COMMA = re.compile(r"[,，、] ?")
_LEAST_CELLS = (2, 2, 2, 2, 2, 2, 3)


_ACCENTS = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0] != chr(c)}
_ACCENTED = re.compile("[\xc0-\u024f]")


def bare(s: str) -> str:
    """Without accents, letter by letter."""
    if not s.isascii():
        for c in set(_ACCENTED.findall(s)):
            s = s.replace(c, _ACCENTS.get(c, c))
    return s


def plain(s: str) -> str:
    """Lower case without accents."""
    return bare(s.lower())


def words_of(low: str) -> list[str]:
    """Runs of letters of a text in lower case."""
    return low.translate(furniture.APART).split() if low.isascii() else _WORD.findall(low)


def ends(line: str) -> bool:
    """Whether a line ends as a sentence."""
    return line.rstrip().rstrip(CLOSERS)[-1:] in END_MARKS


def cells(line: str) -> tuple[int, int]:
    """Separator and number of cells of a table row, or (-1, 1)."""
    s = line.strip(" |│>\t")
    best = (-1, 1)
    for i, ((mark, p), least) in enumerate(zip(_SEPARATORS, _LEAST_CELLS, strict=True)):
        if mark in s:
            n = len(p.findall(s)) + 1
            if n >= least and n > best[1]:
                best = (i, n)
    return best


def no_language(line: str, words: list[str], han: int) -> bool:
    """Whether a line is dump, log, code, noise or broken encoding."""
    s = line.strip()
    if _LOG.match(s):
        return True
    solid = len(s) - s.count(" ") if s.isascii() and "\t" not in s else len("".join(s.split()))
    letters = sum(map(len, words))
    if letters < (0.15 if han else 0.4) * solid:
        return True
    if han * 3 > letters:
        return False
    if not s.isascii() and len(_STRANGE.findall(s)) > 0.35 * solid:
        return True
    if ("(" in s or s[-1] in ";{}") and len(_CODE_SIGN.findall(s)) >= 3 and _CODE.search(s):
        return True
    if han:
        return False
    if not any(len(w) > 1 and w in ANY_COMMON for w in words):
        blob = next((x for x in s.split() if len(x) >= _BLOB), "")
        if blob and (len(blob) > 30 or re.search(r"\d", blob) and re.search(r"[A-Za-z]", blob)):
            return True
    if len(words) >= 3 and s[-1].isalpha() and _NOISE.match(s) and sum(w in ANY_COMMON for w in words if len(w) > 1) < 0.15 * len(words):
        return sum(bool(_HARSH.search(w)) for w in words) * 2 >= len(words)
    return False


def _phrase(line: str, words: list[str], han: int) -> bool:
    """Whether an unmarked line looks like an entry: it starts as a noun phrase, or is a short run of Han characters."""
    if _AMOUNT.match(line):
        return True
    if han:
        return han <= 16 and not _ZH_STOP.search(line)
    return (bool(words) and words[0] in DETERMINERS and len(words) <= 11)


def _first_look(lines: list[str]) -> tuple[list[int], list[list[str]], list[int], list[bool], list[int]]:
    """Rows and lines without language, and what the classes of the others are made from: words, Han characters, ends, sizes."""
    n = len(lines)
    words = [words_of(plain(x)) for x in lines]
    han = [0 if x.isascii() or not _HAN.search(x) else len(_HAN.findall(x)) for x in lines]
    over = [ends(x) for x in lines]
    grid = [(-1, 1) if e and len(w) > 6 else cells(x) for x, e, w in zip(lines, over, words, strict=True)]
    size = [len(w) + h // 2 for w, h in zip(words, han, strict=True)]
    out = [PROSE] * n
    for i, line in enumerate(lines):
        if _RULE.match(line) and ("|" in line or "│" in line or "---" in line):
            out[i] = ROW
        elif grid[i][0] >= 0 and not _SPEAKER.match(line) and any(0 <= j < n and grid[j] == grid[i] for j in (i - 1, i + 1)) and (not over[i] or size[i] < 8):
            out[i] = ROW
        elif no_language(line, words[i], han[i]):
            out[i] = NONE
    return out, words, han, over, size


def mostly_bare(lines: list[str]) -> bool:
    """Whether more than half of a body's lines are rows or no language; a body without lines is.

    The steps after the first look can make rows of short lines without an end only, and no more lines without language unless half
    of them are: where even so there would be too few, they are left out.
    """
    if not lines:
        return True
    # a line of eight words that ends as a sentence and has a language is prose for good: more than half of these settle it
    n, sure = len(lines), 0
    for i, x in enumerate(lines):
        if ends(x):
            words = words_of(plain(x))
            han = 0 if x.isascii() or not _HAN.search(x) else len(_HAN.findall(x))
            if len(words) + han // 2 >= 8 and not no_language(x, words, han):
                sure += 1
                if sure * 2 > n:
                    return False
        if (sure + n - i - 1) * 2 <= n:
            break
    look = _first_look(lines)
    out, _, _, over, size = look
    most = sum(c != PROSE or s <= 9 and not e for c, s, e in zip(out, size, over, strict=True))
    if most * 2 <= len(lines) and out.count(NONE) * 2 < len(lines):
        return False
    return sum(c in (ROW, NONE) for c in line_classes(lines, look)) * 2 > len(lines)


def line_classes(lines: list[str], look: tuple | None = None) -> list[int]:
    """Class of each non-blank line of a body.  ``look``: what ``_first_look`` has found, if it is known."""
    n = len(lines)
    out, words, han, over, size = look or _first_look(lines)
    # list items: marked or labelled short phrases, unless most marked lines are sentences
    marked = [i for i in range(n) if out[i] == PROSE and _MARK.match(lines[i]) and not _SPEAKER.match(lines[i])]

    def sentence(i: int) -> bool:
        follows = i + 1 < n and out[i + 1] == PROSE and lines[i + 1].strip()[:1].islower() and not _MARK.match(lines[i + 1])
        return over[i] and size[i] > 5 or size[i] > (12 if _TALK.match(lines[i]) else 30) or follows and size[i] > 5

    if sum(map(sentence, marked)) * 2 <= len(marked):
        for i in marked:
            if not sentence(i):
                out[i] = ITEM
    labelled = [i for i in range(n) if out[i] == PROSE and _LABEL.match(lines[i]) and not over[i] and size[i] <= 14 and not _SPEAKER.match(lines[i])]
    if len(labelled) >= 3:
        for i in labelled:
            if i - 1 in labelled or i + 1 in labelled:
                out[i] = ITEM
    # unmarked entries: runs of three and more noun phrases, or of enumerations
    def entry(i: int) -> bool:
        if out[i] != PROSE or over[i] or _SPEAKER.match(lines[i]):
            return out[i] == ITEM
        if size[i] <= 12 and _phrase(lines[i], words[i], han[i]):
            return True
        parts = _COMMA.split(lines[i])
        return len(parts) >= 3 and all(len(_WORD.findall(p)) + len(_HAN.findall(p)) // 2 <= 8 for p in parts)

    i = 0
    while i < n:
        j = i
        while j < n and entry(j):
            j += 1
        if j - i >= 3 or j - i >= 2 and n <= 4:
            out[i:j] = [ITEM] * (j - i)
        i = max(j, i + 1)
    # lines without a known word among noise are noise
    if out.count(NONE) * 2 >= n:
        for i in range(n):
            if out[i] == PROSE and not han[i] and sum(w in ANY_COMMON for w in words[i] if len(w) > 1) * 4 < max(1, len(words[i])):
                out[i] = NONE
    # short leftovers between items or rows belong to them
    for i in range(n):
        if out[i] == PROSE and size[i] <= 9 and not over[i]:
            before, after = out[i - 1] if i else PROSE, out[i + 1] if i + 1 < n else PROSE
            if before in (ITEM, ROW) and after in (ITEM, ROW):
                out[i] = before
    return out


def statistics(body: str) -> tuple | None:
    """Statistics of a body, or None if it is blank: (language, n_words, mean_word_len, symbol_ratio, digit_ratio, end_share, common_share, junk_share, counted)."""
    lines = [x for x in body.split("\n") if x.strip()]
    if not lines:
        return None
    classes = line_classes(lines)
    words = words_of(plain(body))
    han = len(_HAN.findall(body))
    spaces = body.split()
    solid = sum(map(len, spaces))
    n = len(words) if not han else sum(not _HAN.match(w) for w in words) + han
    common: dict[str, int] = {}
    hits = 0
    for w in words:
        if (langs := WORD_LANGS.get(w)) is not None:
            hits += 1
            for x in langs:
                common[x] = common.get(x, 0) + 1
    letters = sum(map(len, words))
    language = "zh" if han * 2 > letters else max(common, key=lambda x: (common[x], x)) if hits and classes.count(NONE) * 2 <= len(classes) else ""
    digits = len(_DIGIT.findall(body))
    # Han text has no spaces: two characters count as a word
    short = len(lines) == 1 and (han < 15 if han * 2 > letters else len(spaces) < 8)
    return (
        language,
        n,
        round(letters / len(words), 2) if words else 0.0,
        round((solid - letters - digits) / solid, 3),
        round(digits / solid, 3),
        round(sum(map(ends, lines)) / len(lines), 3),
        round(hits / len(words), 3) if words else 0.0,
        round(sum(c != PROSE for c in classes) / len(lines), 3),
        round(sum(c in (ROW, NONE) for c in classes) / len(lines), 3),
        not short,
    )


STATISTICS = ("n_words", "mean_word_len", "symbol_ratio", "digit_ratio", "end_share", "common_share", "junk_share")
_SCHEMA = "id long, lang string, n_words long, mean_word_len double, symbol_ratio double, digit_ratio double, end_share double, common_share double, junk_share double, bare_share double, counted boolean"
_TYPES = (pa.string(), pa.int64(), *([pa.float64()] * 7), pa.bool_())


def measure(records: DataFrame, model: furniture.Model | None = None) -> DataFrame:
    """Statistics of records (id, text[, site]).  With a model, lines of page furniture are left out."""
    given = None if model is None else records.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if given is None else given.value
        for b in batches:
            sites = b.column(2).to_pylist() if own is not None else [None] * b.num_rows
            ids, rows = [], []
            for i, text, site in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), sites, strict=True):
                row = statistics(text if own is None else furniture.own_body(own, text, site))
                if row is not None:
                    ids.append(i)
                    rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES))], names=[f.split()[0] for f in _SCHEMA.split(", ")])

    columns = ["id", "text"] + ([] if model is None else ["site"])
    return records.where("text is not null").select(*columns).mapInArrow(run, _SCHEMA)


def exact_ranks(values: DataFrame) -> DataFrame:
    """(grp, stat, value, n, upto, total): for each distinct value its count, the rows of its group up to it, and the group's rows.

    Values are counted map-side, then sorted by range partitions.  Each partition's rows by group reach the driver (partitions
    times groups, not rows), and become the offsets of the partitions behind it.
    """
    counted = values.groupBy("grp", "stat", "value").agg(F.count("*").alias("n"))
    part = counted.repartitionByRange(partitions(values), "grp", "stat", "value").sortWithinPartitions("grp", "stat", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, upto = None, 0
        for b in batches:
            run_, totals = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), []
            for k, n in zip(run_, b.column(3).to_pylist(), strict=True):
                key, upto = (k, n) if k != key else (key, upto + n)
                totals.append(upto)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(5)] + [pa.array(totals, pa.int64())], names=["grp", "stat", "value", "n", "part", "within"])

    sorted_ = table(part.withColumn("part", F.spark_partition_id()).mapInArrow(run, "grp string, stat string, value double, n long, part int, within long"), "sorted")
    ends = sorted_.groupBy("grp", "stat", "part").agg(F.max("within").alias("rows")).collect()
    offset, running = [], {}
    for r in sorted(ends, key=lambda r: (r.grp, r.stat, r.part)):
        offset.append((r.grp, r.stat, r.part, running.get((r.grp, r.stat), 0)))
        running[r.grp, r.stat] = running.get((r.grp, r.stat), 0) + r.rows
    spark = values.sparkSession
    rows = [(*o, running[o[0], o[1]]) for o in offset]
    offsets = spark.createDataFrame(rows, "grp string, stat string, part int, before long, total long")
    return sorted_.join(F.broadcast(offsets), ["grp", "stat", "part"]).select("grp", "stat", "value", "n", (F.col("before") + F.col("within")).alias("upto"), "total")


#: Statistics of the layout, and the tail that lists, tables and dumps are in: -1 low values, 1 high ones.
LAYOUT = {"end_share": -1, "junk_share": 1}


def outliers(measured: DataFrame, keys: list[str]) -> DataFrame:
    """``measured`` with ``score`` and ``layout_score``, the sums over statistics of the negative logarithm of a tail probability within the language.

    ``score`` takes the smaller tail of every statistic, ``layout_score`` the tail of LAYOUT.  Tail probabilities count the value
    itself, so they are above 0.  Tails are looked up one statistic at a time; a value that a large part of the records share is
    broadcast (``lookup``).  Columns of ``measured`` named score or layout_score give way; records without a language have
    infinite scores.
    """
    measured = measured.drop("score", "layout_score")
    spoken = measured.where("lang <> ''")
    long_ = spoken.select(F.col("lang").alias("grp"), F.expr("stack(7, " + ", ".join(f"'{s}', cast({s} as double)" for s in STATISTICS) + ") as (stat, value)"))
    ranks = table(exact_ranks(long_), "ranks")
    tail = -F.log(F.least(F.col("upto"), F.col("total") - F.col("upto") + F.col("n")) / F.col("total"))
    low, high = -F.log(F.col("upto") / F.col("total")), -F.log((F.col("total") - F.col("upto") + F.col("n")) / F.col("total"))
    rows = measured
    for s in STATISTICS:
        own = ranks.where(F.col("stat") == s).select(F.col("grp").alias("lang"), F.col("value").alias(f"v_{s}"), "n", tail.alias(f"t_{s}"), *([(low if LAYOUT[s] < 0 else high).alias(f"d_{s}")] if s in LAYOUT else []))
        rows = lookup(rows.withColumn(f"v_{s}", F.col(s).cast("double")), own, ["lang", f"v_{s}"])
    infinite = F.lit(float("inf"))
    score, layout = sum((F.col(f"t_{s}") for s in STATISTICS), F.lit(0.0)), sum((F.col(f"d_{s}") for s in LAYOUT), F.lit(0.0))
    return rows.select(*measured.columns, F.coalesce(score, infinite).alias("score"), F.coalesce(layout, infinite).alias("layout_score"))


def outlying(scored: DataFrame) -> DataFrame:
    """Rows of ``scored`` (a table) at the top of their language by ``layout_score``, and those without a language.

    The top of a language is as large as the number of its records whose lines are mostly items, rows or no language; the score's
    exact ranks say which records are in it.  Records of equal score stand together.
    """
    spoken = scored.where("lang <> ''")
    ranks = exact_ranks(spoken.select(F.col("lang").alias("grp"), F.lit("layout_score").alias("stat"), F.col("layout_score").alias("value")))
    size = spoken.groupBy(F.col("lang").alias("grp")).agg(F.count_if(F.col("junk_share") > 0.5).alias("k"))  # one row a language
    cuts = ranks.join(F.broadcast(size), "grp").where("upto > total - k").groupBy(F.col("grp").alias("lang")).agg(F.min("value").alias("cut"))
    return scored.join(F.broadcast(cuts), "lang", "left").where("lang = '' or layout_score >= cut").drop("cut")
