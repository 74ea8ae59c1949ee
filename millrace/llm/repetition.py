"""Repetition inside one document.

``repetition`` gives each document the divergence of its character classes and common words from the reference of its
language, and the exact share of repeated characters.  The divergence alone cannot give the share: a text of ordinary
sentences that says a third of them twice has the same histograms as one that doesn't.  So the share is measured on every
document that passes the length guard, and decides.

Null ids and null texts give no row; a text with fewer than ``width + 1`` letters and digits has share 0 and null divergences.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log2, sqrt

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import chunks, code_points, windows
from ..store import table

WIDTH = 20
#: Texts with fewer letters and digits have no divergence: their histograms are too thin.
LEAST_CHARS = 50
#: Documents with fewer common words have no word distance.
LEAST_WORDS = 10
WORDS = r"\p{L}+"
#: Words of a language's reference, and letters that they have at most; ``js_words`` compares these words only.
TOP_WORDS, WORD_LETTERS = 200, 30


@cache
def _classes() -> np.ndarray:
    """Class of each code point: 0 neither letter nor digit, 1..5 vowel-like Latin, other Latin, accented, other script, digit."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind[0] == "N":
            out[c] = 5
        elif kind[0] == "L":
            out[c] = 4 if c >= 0x370 else 3 if c > 127 else 1 if chr(c) in "aeiou" else 2
    return out


def repeated_share(kept: np.ndarray, lengths: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Share of characters in a stretch of ``width`` that also starts earlier in the same document."""
    h, doc, pos = windows(kept, lengths, width)
    covered = np.zeros(len(lengths), np.int64)
    if len(h):
        own = h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        again = pos[order[1:][same]]
        mark = np.zeros(len(kept) + 1, np.int32)
        np.add.at(mark, again, 1)
        np.add.at(mark, again + width, -1)
        total = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)])
        ends = np.cumsum(lengths)
        covered = total[ends] - total[ends - lengths]
    return covered / np.maximum(lengths, 1)


def word_distance(counts: Counter, reference: dict[str, float]) -> float:
    """Jensen-Shannon distance (base 2) of a document's common words from the reference; words it lacks add half their share."""
    total = sum(counts.values())
    div, met = 0.0, 0.0
    for w, n in counts.items():
        p, q = n / total, reference[w]
        m = (p + q) / 2
        div += p * log2(p / m) + q * log2(q / m)
        met += q
    return sqrt(max(0.0, (div + 1 - met) / 2))


def _rows(texts: list[str | None], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Positions, kept characters, class histograms and repeated shares by chunk."""
    table = _classes()
    for at, own in chunks([None if t is None else t.lower() for t in texts]):
        flat = code_points("".join(own))
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        kind = table[flat]
        keep = kind > 0
        owner = np.repeat(np.arange(len(own)), lengths)[keep]
        count = np.bincount(owner, minlength=len(own))
        hist = np.bincount(owner * 6 + kind[keep], minlength=6 * len(own)).reshape(-1, 6)[:, 1:]
        yield np.asarray(at), count, hist, repeated_share(flat[keep], count, width)


#: Group of a language label: its first two letters, so that there are at most 26 * 26 + 1 groups.
def group(lang):
    two = F.substring(F.lower(F.trim(lang)), 1, 2)
    return F.when(two.rlike("^[a-z]{2}$"), two).otherwise(F.lit(""))


def word_counts(docs: DataFrame) -> DataFrame:
    """(grp, word, n) of the corpus; counted inside each batch first, so that few rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(WORDS).findall
        for b in batches:
            by: dict[str, Counter] = {}
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, Counter()).update(find(t.lower()))
            rows = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["grp", "word", "n"])

    return docs.where("text is not null").select("text", F.coalesce(group("lang"), F.lit("")).alias("grp")).mapInArrow(run, "grp string, word string, n long").groupBy("grp", "word").agg(F.sum("n").alias("n"))


def word_reference(docs: DataFrame, top: int = TOP_WORDS) -> dict[str, dict[str, float]]:
    """The ``top`` words of each label group with their share among these, over all documents; at most 677 * top entries."""
    w = Window.partitionBy("grp").orderBy(F.desc("n"), "word")
    best = word_counts(docs).where(f"length(word) <= {WORD_LETTERS}").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    out: dict[str, dict[str, float]] = {}
    for r in best.collect():
        out.setdefault(r.grp, {})[r.word] = r.n
    return {g: {w: n / sum(c.values()) for w, n in c.items()} for g, c in out.items()}


MEASURED = "id long, grp string, kept long, c1 long, c2 long, c3 long, c4 long, c5 long, js_words double, share double"


def measure(docs: DataFrame, reference: dict[str, dict[str, float]], width: int = WIDTH, least_words: int = LEAST_WORDS) -> DataFrame:
    """One pass over (id, text, lang): class histogram, distance of the common words, repeated share."""
    given = docs.sparkSession.sparkContext.broadcast(reference)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(WORDS).findall
        for b in batches:
            ids, texts, groups = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist(), b.column(2).to_pylist()
            for at, count, hist, share in _rows(texts, width):
                far: list[float | None] = []
                for i in at:
                    ref = given.value.get(groups[i], {})
                    counts = Counter(w for w in find(texts[i].lower()) if w in ref)
                    far.append(word_distance(counts, ref) if counts.total() >= least_words else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at], pa.int64()), pa.array([groups[i] for i in at], pa.string()), pa.array(count, pa.int64()), *(pa.array(hist[:, i].astype(np.int64), pa.int64()) for i in range(5)), pa.array(far, pa.float64()), pa.array(share, pa.float64())],
                    names=["id", "grp", "kept", "c1", "c2", "c3", "c4", "c5", "js_words", "share"],
                )

    return docs.where("id is not null and text is not null").select("id", "text", F.coalesce(group("lang"), F.lit("")).alias("grp")).mapInArrow(run, MEASURED)


def divergence(own: list, own_total, ref: list, ref_total):
    """Jensen-Shannon distance (base 2) of two histograms given as columns."""
    total = F.lit(0.0)
    for a, b in zip(own, ref, strict=True):
        p, q = a / own_total, b / ref_total
        m = (p + q) / 2
        total = total + F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def repetition(docs: DataFrame, width: int = WIDTH, least: int = LEAST_CHARS) -> DataFrame:
    """(id, kept, js_class, js_words, share) of each document (id, text, lang) whose text isn't null."""
    m = table(measure(docs, word_reference(docs), width), "measured")
    ref = m.groupBy("grp").agg(*(F.sum(f"c{i}").alias(f"r{i}") for i in range(1, 6)), F.sum("kept").alias("r"))  # at most 677 rows
    js = divergence([F.col(f"c{i}") for i in range(1, 6)], F.greatest("kept", F.lit(1)), [F.col(f"r{i}") for i in range(1, 6)], F.greatest("r", F.lit(1)))
    return m.join(F.broadcast(ref), "grp").select("id", "kept", F.when(F.col("kept") >= least, js).alias("js_class"), "js_words", "share")
