"""Language-model perplexity and the quantile split by it.

A scorer is a function (docs, text_col) -> docs with a column ``ppl``.  Two are native: a unigram model trained by grouped
aggregation, and a back-off n-gram model read from an ARPA text file.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import lookup, partitions as session_partitions
from ..functions.text import char_space, truncate_spaces, words
from ..store import table

#: (docs, text_col) -> docs with ``ppl``; scorers that meet documents again take ``id_col`` as a third argument.
Scorer = Callable[..., DataFrame]


def prepared(text, unit: str = "word", truncation: int | None = 1024):
    """Text as it is scored: spaced out for ``char``, then cut after ``truncation`` single-space tokens."""
    if unit not in ("word", "char"):
        raise ValueError("unit must be word or char")
    t = char_space(text) if unit == "char" else text
    return t if truncation is None else truncate_spaces(t, truncation)


def unigrams(docs: DataFrame, text_col: str = "text", unit: str = "word") -> DataFrame:
    """(word, n): counts of the training text."""
    return docs.select(F.explode(words(prepared(F.col(text_col), unit, None))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def unigram_scorer(counts: DataFrame, id_col: str = "doc_id") -> Scorer:
    """Add-one unigram perplexity: exp of the mean of -log((n + 1) / (N + V + 1)); null for a text without words.

    Words of a document are counted before they meet the model; frequent words are broadcast (``lookup``), so that no task has all
    documents of a word.  Documents are met again by ``id_col``, which must be unique.
    """
    counts = counts.select("word", "n")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    base = float(total.n + total.v + 1)

    def score(docs: DataFrame, text_col: str) -> DataFrame:
        if id_col not in docs.columns:
            raise ValueError(f"documents need a column {id_col}")
        tf = docs.select(F.col(id_col).alias("_k"), F.explode(words(F.col(text_col))).alias("word")).groupBy("_k", "word").agg(F.count("*").alias("f"))
        known = lookup(tf, counts.withColumn("c", F.col("n")), ["word"])
        logs = known.groupBy("_k").agg((-F.sum(F.col("f") * F.log((F.coalesce("c", F.lit(0)) + 1) / base)) / F.sum("f")).alias("_h"))
        return docs.join(logs, docs[id_col].eqNullSafe(logs["_k"]), "left").withColumn("ppl", F.exp("_h")).drop("_k", "_h")

    return score


class Arpa:
    """Back-off n-gram model of an ARPA text file (log10 probabilities)."""

    def __init__(self, grams: dict[tuple[str, ...], tuple[float, float]], order: int):
        self.grams, self.order = grams, order

    @classmethod
    def parse(cls, lines) -> Arpa:
        grams: dict[tuple[str, ...], tuple[float, float]] = {}
        order = 0
        for line in lines:
            line = line.rstrip("\n")
            if line.startswith("\\") and line.endswith("-grams:"):
                order = int(line[1:].split("-")[0])
            elif order and line and not line.startswith("\\"):
                parts = line.split("\t") if "\t" in line else line.split()
                gram = tuple(parts[1].split()) if "\t" in line else tuple(parts[1 : 1 + order])
                rest = parts[2:] if "\t" in line else parts[1 + order :]
                grams[gram] = (float(parts[0]), float(rest[0]) if rest else 0.0)
        if not grams:
            raise ValueError("no n-grams")
        return cls(grams, order)

    @classmethod
    def load(cls, path: str) -> Arpa:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f)

    def log10(self, gram: tuple[str, ...]) -> float:
        penalty = 0.0
        while True:
            found = self.grams.get(gram)
            if found is not None:
                return penalty + found[0]
            if len(gram) == 1:
                return penalty + self.grams.get(("<unk>",), (-100.0, 0.0))[0]
            penalty += self.grams.get(gram[:-1], (0.0, 0.0))[1]
            gram = gram[1:]

    def perplexity(self, text: str) -> float:
        """10 to the mean of -log10 over the words and the end of the sentence."""
        toks = ["<s>", *(w if (w,) in self.grams else "<unk>" for w in text.split()), "</s>"]
        total = sum(self.log10(tuple(toks[max(0, i - self.order + 1) : i + 1])) for i in range(1, len(toks)))
        return math.pow(10.0, -total / (len(toks) - 1))


@lru_cache(maxsize=4)
def _arpa(path: str) -> Arpa:
    return Arpa.load(path)


def arpa_scorer(path: str | None = None, text: str | None = None) -> Scorer:
    """Scorer of an ARPA file that every executor can read, loaded once for each Python worker, or of a small model given as text."""
    if (path is None) == (text is None):
        raise ValueError("give either a path or a text")

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _arpa(path) if text is None else Arpa.parse(text.split("\n"))
        for b in batches:
            yield b.map(model.perplexity, na_action="ignore").astype("float64")

    return lambda docs, text_col: docs.withColumn("ppl", run(F.col(text_col)))


def perplexity(docs: DataFrame, scorer: Scorer, text_col: str = "text", unit: str = "word", truncation: int | None = 1024) -> DataFrame:
    """Documents with ``ppl``; the text is only scored in its prepared form, not changed."""
    scored = scorer(docs.withColumn("_scored", prepared(F.col(text_col), unit, truncation)), "_scored")
    return scored.drop("_scored")


def global_rank(rows: DataFrame, by: list[str], partitions: int | None = None) -> DataFrame:
    """Rows with ``rank`` (from 1) in the order of ``by``, without bringing them together.

    Rows are sorted by range partitions and kept as a table; a row's rank is its place in its partition plus the rows before it.
    """
    parted = table(rows.repartitionByRange(partitions or session_partitions(rows), *by).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return parted.withColumn("_place", place).join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def split_by_quantile(rows: DataFrame, score: str = "ppl", q: float = 0.8, id_col: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Rows with ``rank`` and ``label``: the first int(n * q) by (score, id) are pos, the rest neg.  Rows without a score are left out."""
    if not 0 <= q <= 1:
        raise ValueError("q must lie between 0 and 1")
    known = rows.where(F.col(score).isNotNull() & ~F.isnan(score))
    ranked = table(global_rank(known, [score, id_col], partitions), "ranked")
    n = ranked.count()
    return ranked.withColumn("label", F.when(F.col("rank") <= int(n * q), "pos").otherwise("neg"))
