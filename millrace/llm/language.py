"""Languages of documents and of their mixed-in segments, by Bayesian fusion of evidence.

Evidence for the main language of a page's body:
- text: naive Bayes over words (Han characters count as one class), whose counts by declared language are summed over all documents;
- the declared language, right as often as labels of that language agree with clear texts (grouped counts, smoothed towards ``LABEL_RIGHT``);
- the host: a prior smoothed towards the prior of the address suffix, and that towards the prior of the corpus, each from
  grouped counts of declared languages.  A host of a large part of all rows is broadcast (``lookup``).

Sentences are judged by the text alone; a second language is one that has at least ``LEAST_SENTENCES`` of them, of
``LEAST_WORDS`` words, each by a clear margin over the main one.  Stretches of sentences of one language are segments: (start, end,
lang, confidence), offsets in code points of the page's text, confidence the posterior of the stretch among all languages with
the text's share of each as prior.  A body of one language is one segment from its first to its last line.

Parameters that bound the model: ``LANGUAGES`` are the languages that a text can be in (another one gets the nearest of them);
``VOCABULARY`` words of each language are known, of at most ``MAX_LETTERS`` letters; all other words say nothing.

Nulls, blank texts and texts of fewer than 8 words (15 Han characters) get a row with no language and no segments.  Page furniture
is left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import furniture, prose
from ..operators.joins import lookup
from ..store import table

LANGUAGES = ("en", "zh", "de", "fr", "es", "pt")
VOCABULARY = 4000
MAX_LETTERS = 40
#: Labels are taken to be right so often before any are counted, and so many labels' weight that has.
LABEL_RIGHT, LABEL_WEIGHT = 0.8, 20.0
#: Texts that count for labels: at least so many words, and so much likelier than in any other language.
CLEAR_WORDS, CLEAR_MARGIN = 20, 10.0
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 200.0
LEAST_SENTENCES, LEAST_WORDS, MARGIN = 2, 4, 3.0

# Names and codes of the languages, and marks for none.
NAMES = {
    "en": "en eng english anglais englisch inglés inglês 英语 英文",
    "zh": "zh zho chi chinese chinois chinesisch chino chinês cmn 中文 汉语",
    "de": "de deu ger german deutsch allemand alemán alemão 德语",
    "fr": "fr fra fre french français francais französisch francés francês 法语",
    "es": "es spa spanish español espanol castellano espagnol spanisch espanhol 西班牙语",
    "pt": "pt por portuguese português portugues portugais portugiesisch portugués 葡萄牙语",
}
NO_LABEL = ("", "und", "zxx", "??", "?", "unknown", "none", "null", "n/a", "na", "xx", "xxx", "mis", "mul", "-", "--", "undefined", "other")
_OF = {name: lang for lang, names in NAMES.items() for name in names.split()}
HAN = "一"

#: A run of Han characters is one token that counts as many times as it has characters.
_TOKEN = re.compile(r"[a-z\xdf-\u02af\u0370-\u1fff]+|[㐀-鿿豈-﫿]+")
_ANY_HAN = re.compile(r"[㐀-鿿豈-﫿]")
#: The first character is one of a set, which is searched for fast; what may follow depends on it.
_SENTENCE = re.compile(r"[.!?…。！？](?:(?<=[.!?…])[.!?…]*[\"”»’')\]]*\s+|(?<=[。！？])[。！？]*[”’」』）\"]*)")
#: What can be in a token besides a to z.
_WIDE = re.compile(r"[\xdf-\u02af\u0370-\u1fff㐀-鿿豈-﫿]")


def declared(label: Column) -> Column:
    """Two-letter code of a label; empty if it is absent, '?' if it names another language."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    head = F.regexp_extract(low, r"^([^\-_. ]+)", 1)
    codes = F.create_map(*(F.lit(x) for kv in _OF.items() for x in kv))
    return F.when(low.isin(*NO_LABEL), "").otherwise(F.coalesce(codes[low], codes[head], F.lit("?")))


def split_tokens(low: str) -> list[str]:
    """Tokens of a text in lower case without accents."""
    if not low.isascii():
        if _WIDE.search(low):
            return _TOKEN.findall(low)
        low = low.encode("ascii", "replace").decode("ascii")
    return low.translate(furniture.APART).split()


def tokens(text: str) -> list[str]:
    return split_tokens(prose.plain(text))


def count_words(counter: Counter, text: str) -> None:
    found = tokens(text)
    if not text.isascii() and _ANY_HAN.search(text):
        han = [t for t in found if t[0] >= "㐀"]
        counter[HAN] += sum(map(len, han))
        found = [t for t in found if t[0] < "㐀"]
    counter.update(found)


def word_model(docs: DataFrame, size: int = VOCABULARY) -> dict[str, tuple[float, ...]]:
    """Log likelihoods of the ``size`` most frequent words of each language, from all documents with a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, Counter] = {}
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                count_words(by.setdefault(lang, Counter()), t)
            rows = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    known = docs.where("text is not null").select("text", declared(F.col("label")).alias("lang")).where(F.col("lang").isin(*LANGUAGES))
    counts = known.mapInArrow(run, "lang string, word string, n long").where(f"length(word) <= {MAX_LETTERS}").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    kept = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size)
    table_: dict[str, dict[str, int]] = {}
    total = Counter()
    for r in kept.collect():
        table_.setdefault(r.word, {})[r.lang] = r.n
        total[r.lang] += r.n
    most = max(total.values(), default=1)
    # counts are scaled to the largest language, so that smoothing treats all alike
    return {word: tuple(log((n.get(x, 0) * most / max(1, total[x]) + 0.02 * sum(n[y] * most / total[y] for y in n) + 0.5) / (most * 1.2)) for x in LANGUAGES) for word, n in table_.items()}


def sentences(body: str) -> tuple[list[str], list[int]]:
    """Tokens of a body and where its sentences start; a stretch of over 45 words (90 Han characters) without an end is cut into pieces."""
    flat: list[str] = []
    starts: list[int] = []
    for part in _SENTENCE.split(prose.plain(body)):
        found = split_tokens(part) if part else ()
        if not found:
            continue
        at = len(flat)
        starts.append(at)
        flat += found
        if len(found) > 45:
            starts += range(at + 15, len(flat), 15)
        elif len(part) > 90 and not part.isascii() and _ANY_HAN.search(part):
            size = 0
            for i, t in enumerate(found):
                if size >= 40:
                    starts.append(at + i)
                    size = 0
                size += len(t)
    return flat, starts


class Judge:
    """Text evidence of a body."""

    def __init__(self, model: dict[str, tuple[float, ...]]):
        self.index = {w: i for i, w in enumerate(model)}
        self.han = self.index.get(HAN, -1)
        # the last row is for unknown words
        self.table = np.array([*model.values(), (0.0,) * len(LANGUAGES)])

    def weigh(self, flat: list[str], starts: list[int], text: str) -> tuple[np.ndarray, ...]:
        """Of each sentence: log likelihoods, words, Han characters, and whether its language is clear."""
        at = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
        if text.isascii() or not _ANY_HAN.search(text):  # each token has the weight 1
            scores = np.add.reduceat(self.table.take(at, axis=0), starts)
            bounds = np.array([*starts, len(flat)])
            size = (bounds[1:] - bounds[:-1]).astype(float)
            known = np.add.reduceat((at >= 0).astype(float), starts)
            ranked = np.sort(scores, axis=1)
            return scores, size, np.zeros(len(starts)), (known >= 3) & (size >= LEAST_WORDS) & (ranked[:, -1] - ranked[:, -2] >= MARGIN)
        weight = np.ones(len(flat))
        for i, t in enumerate(flat):
            if t[0] >= "㐀":
                at[i], weight[i] = self.han, len(t)
        scores = np.add.reduceat(self.table[at] * weight[:, None], starts)
        size = np.add.reduceat(weight, starts)
        known = np.add.reduceat(weight * (at >= 0), starts)
        han_size = np.add.reduceat(weight * (at == self.han) * (self.han >= 0), starts)
        ranked = np.sort(scores, axis=1)
        clear = (known >= 3) & (size >= np.where(han_size * 2 > size, 8, LEAST_WORDS)) & (ranked[:, -1] - ranked[:, -2] >= MARGIN)
        return scores, size, han_size, clear

    def body(self, body: str) -> tuple[list[float], int, int, dict[str, int]]:
        """Log likelihoods (over the body), words, Han characters, and sentences by their own clear language."""
        flat, starts = sentences(body)
        if not flat:
            return [0.0] * len(LANGUAGES), 0, 0, {}
        scores, size, han, clear = self.weigh(flat, starts, body)
        own = np.bincount(scores[clear].argmax(1), minlength=len(LANGUAGES)).tolist()
        return scores.sum(0).tolist(), int(size.sum()), int(han.sum()), {x: n for x, n in zip(LANGUAGES, own, strict=True) if n}

    def segments(self, body: str) -> list[tuple[int, int, str, float]]:
        """Stretches of one language: start and end in the body, language, confidence.

        A language needs ``LEAST_SENTENCES`` clear sentences to have stretches of its own; a sentence that isn't clear goes with the one before.
        """
        spans = sentence_spans(body)
        if not spans:
            return []
        flat = [t for _, _, found in spans for t in found]
        starts = np.cumsum([0, *(len(f) for _, _, f in spans[:-1])]).tolist()
        scores, size, _, clear = self.weigh(flat, starts, body)
        best = scores.argmax(1)
        counts = Counter(best[clear].tolist())
        total = scores.sum(0)
        main = counts.most_common(1)[0][0] if counts else int(total.argmax())
        ours = {k for k, n in counts.items() if n >= LEAST_SENTENCES} | {main}
        firm = [int(k) if c and k in ours else None for k, c in zip(best, clear, strict=True)]
        now = next((k for k in firm if k is not None), main)
        prior = np.log((np.bincount(best[clear], size[clear], len(LANGUAGES)) + 1) / (size[clear].sum() + len(LANGUAGES)))
        out: list[list] = []
        for (a, b, _), k, s in zip(spans, firm, scores, strict=True):
            now = now if k is None else k
            if out and out[-1][2] == now:
                out[-1][1] = b
                out[-1][3] = out[-1][3] + s
            else:
                out.append([a, b, now, s.copy()])
        return [(a, b, LANGUAGES[k], float(1 / np.exp(np.minimum(700, s + prior - s[k] - prior[k])).sum())) for a, b, k, s in out]


def sentence_spans(body: str) -> list[tuple[int, int, list[str]]]:
    """Start, end and tokens of the sentences of a body; those without tokens are left out."""
    low = body.lower()
    if len(low) != len(body):  # lower case of some letters is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in body)
    low = prose.bare(low)
    out, at = [], 0
    for m in [*_SENTENCE.finditer(low), None]:
        end = len(low) if m is None else m.end()
        if (found := _TOKEN.findall(low, at, end)):
            piece = low[at:end]
            left = at + len(piece) - len(piece.lstrip())
            out.append((left, at + len(piece.rstrip()), found))
        at = end
    return out


_SEGMENTS = "array<struct<start:bigint,end:bigint,lang:string,confidence:double>>"
_SCHEMA = "id long, site string, suffix string, label string, words long, bare boolean, " + ", ".join(f"l_{x} double, s_{x} long" for x in LANGUAGES) + f", segments {_SEGMENTS}"


def page_segments(judge: Judge, body: str, kept: list[tuple[int, str]]) -> list[dict]:
    """Segments of a page with offsets in its text.  ``kept``: offset and text of the body's lines."""
    starts, at = [], 0
    for _, line in kept:
        starts.append(at)
        at += len(line) + 1

    def there(offset: int) -> int:
        i = bisect_right(starts, offset) - 1
        return kept[i][0] + offset - starts[i]

    # an end is the place after a character
    return [{"start": there(a), "end": there(max(a, b - 1)) + 1, "lang": x, "confidence": c} for a, b, x, c in judge.segments(body)]


def evidence(docs: DataFrame, words: dict[str, tuple[float, ...]], model: furniture.Model) -> DataFrame:
    """Text evidence of docs (id, text, site, url, label)."""
    given = docs.sparkSession.sparkContext.broadcast((words, model))
    names = ["id", "site", "suffix", "label", "words", "bare", *(f"{c}_{x}" for x in LANGUAGES for c in "ls"), "segments"]
    segment = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pages = given.value
        judge = Judge(known)
        for b in batches:
            rows = []
            for i, text, site, suffix, label in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                at, states = pages.page(text, site)
                drop = {n for n, s in zip(at, states, strict=True) if s != furniture.BODY}
                kept, offset = [], 0
                for n, line in enumerate(text.split("\n")):
                    if n not in drop:
                        kept.append((offset, line))
                    offset += len(line) + 1
                body = "\n".join(line for _, line in kept)
                bare = prose.mostly_bare([line for _, line in kept if line.strip()])
                whole, n, han, own = judge.body(body)
                # two Han characters make a word: 15 characters are the least, as 8 words are elsewhere
                size = n if han * 2 <= n else (8 if han >= 15 else 0)
                row = [i, site, suffix, label, size, bare]
                for k, x in enumerate(LANGUAGES):
                    row += [whole[k], own.get(x, 0)]
                mixed = sum(v >= LEAST_SENTENCES for v in own.values()) > 1
                row.append(page_segments(judge, body, kept) if mixed else [{"start": kept[0][0], "end": kept[-1][0] + len(kept[-1][1]), "lang": None, "confidence": None}] if n else [])
                rows.append(row)
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()] + [pa.float64(), pa.int64()] * len(LANGUAGES) + [segment]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    suffix = F.regexp_extract(F.coalesce("site", F.lit("")), r"\.([^.]+)$", 1)
    rows = docs.where("text is not null").select("id", "text", F.coalesce("site", F.lit("")).alias("site"), suffix.alias("suffix"), declared(F.col("label")).alias("label"))
    return rows.mapInArrow(run, _SCHEMA)


def label_reliability(found: DataFrame) -> dict[str, float]:
    """For each declared language the share of its labels that the text confirms, among texts of a clear language; counted, one row a language."""
    scores = F.array_sort(F.array(*(F.struct(F.col(f"l_{x}").alias("s"), F.lit(x).alias("x")) for x in LANGUAGES)))
    clear = found.where((F.col("words") >= CLEAR_WORDS) & ~F.col("bare") & F.col("label").isin(*LANGUAGES)).withColumn("r", scores)
    clear = clear.select("label", F.col("r")[len(LANGUAGES) - 1].alias("best"), F.col("r")[len(LANGUAGES) - 2]["s"].alias("next")).where(F.col("best.s") - F.col("next") >= CLEAR_MARGIN)
    counts = {r.label: (r.n, r.right) for r in clear.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("best.x")).alias("right")).collect()}
    return {x: (counts.get(x, (0, 0))[1] + LABEL_WEIGHT * LABEL_RIGHT) / (counts.get(x, (0, 0))[0] + LABEL_WEIGHT) for x in LANGUAGES}


def priors(found: DataFrame) -> DataFrame:
    """(site, n, p_en, ...): rows of a host and the log prior of each language there, smoothed towards its suffix and the corpus."""
    counts = [F.sum((F.col("label") == x).cast("double")).alias(f"n_{x}") for x in LANGUAGES]
    host = found.groupBy("site", "suffix").agg(F.count("*").alias("rows"), *counts)
    by_suffix = host.groupBy("suffix").agg(*(F.sum(f"n_{x}").alias(f"u_{x}") for x in LANGUAGES))
    whole = by_suffix.agg(*(F.coalesce(F.sum(f"u_{x}"), F.lit(0.0)) for x in LANGUAGES)).first()
    total = lambda p: sum((F.col(f"{p}_{x}") for x in LANGUAGES), F.lit(0.0))
    joined = host.join(by_suffix, "suffix")
    out = []
    for x, n in zip(LANGUAGES, whole, strict=True):
        corpus = F.lit((n + 1) / (sum(whole) + len(LANGUAGES)))
        suffix = (F.col(f"u_{x}") + SUFFIX_WEIGHT * corpus) / (total("u") + SUFFIX_WEIGHT)
        out.append(F.log((F.col(f"n_{x}") + HOST_WEIGHT * suffix) / (total("n") + HOST_WEIGHT)).alias(f"p_{x}"))
    return joined.select("site", F.col("rows").alias("n"), *out)


def languages(docs: DataFrame) -> DataFrame:
    """(id, label, lang, confidence, second, segments, plain_text) of docs (id, text, site, url, label).

    ``label`` is the declared code ('' if absent, '?' if another); ``lang`` the main language, null for too short texts;
    ``second`` the other languages of the body with their number of sentences; ``segments`` its stretches (start, end, lang,
    confidence); ``plain_text`` false for tables and bodies without language.
    """
    model = furniture.train(docs)
    found = table(evidence(docs, word_model(docs), model), "evidence")
    fused = lookup(found, table(priors(found), "hosts"), ["site"])
    right = label_reliability(found)
    # a label that names a language speaks for it as far as it is right, and for the others by what is left
    says = [(y, *(log(right[y] if x == y else (1 - right[y]) / (len(LANGUAGES) - 1)) for x in LANGUAGES)) for y in LANGUAGES]
    said = found.sparkSession.createDataFrame(says, "label string, " + ", ".join(f"r_{x} double" for x in LANGUAGES))
    fused = fused.join(F.broadcast(said), "label", "left")
    post = [F.struct((F.col(f"l_{x}") + F.col(f"p_{x}") + F.coalesce(f"r_{x}", F.lit(0.0))).alias("s"), F.lit(x).alias("x")) for x in LANGUAGES]
    best = fused.withColumn("post", F.array(*post)).withColumn("best", F.array_max("post"))
    mass = F.aggregate("post", F.lit(0.0), lambda a, p: a + F.exp(F.greatest(F.lit(-700.0), p["s"] - F.col("best.s"))))
    second = F.filter(F.array(*(F.struct(F.lit(x).alias("x"), F.col(f"s_{x}").alias("n")) for x in LANGUAGES)), lambda p: (p["n"] >= LEAST_SENTENCES) & (p["x"] != F.col("best.x")))
    long_ = F.col("words") >= 8
    # the one segment of a body of one language has the language of the document
    whole = F.transform("segments", lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), F.coalesce(g["lang"], F.col("best.x")).alias("lang"), F.coalesce(g["confidence"], 1 / F.col("mass")).alias("confidence")))
    return best.withColumn("mass", mass).select(
        "id", "label", F.when(long_, F.col("best.x")).alias("lang"), F.when(long_, 1 / F.col("mass")).alias("confidence"), F.when(long_, second).alias("second"), F.when(long_, whole).otherwise(F.array().cast(_SEGMENTS)).alias("segments"), (~F.col("bare")).alias("plain_text")
    )


def segments(found: DataFrame) -> DataFrame:
    """(id, seg_no, start_pos, end_pos, lang, confidence): one row for each segment of ``languages``."""
    rows = found.select("id", F.posexplode("segments").alias("seg_no", "g"))
    return rows.select("id", F.col("seg_no").cast("long").alias("seg_no"), F.col("g.start").alias("start_pos"), F.col("g.end").alias("end_pos"), "g.lang", "g.confidence")


def cases(found: DataFrame) -> DataFrame:
    """(id, lang) of documents whose label is absent or wrong, or that mix languages: one row for each language of the body."""
    seen = found.where("lang is not null and plain_text").withColumn("all", F.concat(F.array("lang"), F.transform("second", lambda p: p["x"])))
    return seen.where((F.col("label") != F.col("lang")) | (F.size("second") > 0)).select("id", F.explode("all").alias("lang"))
