"""Entities of a dictionary in texts, and lexical diversity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_space, truncate_words, word_count


def _grams(tokens: Column, lengths: list[int], joiner: str) -> Column:
    """Distinct runs of tokens of the given lengths.  ``tokens`` must be a column of its own: it is read once for each run."""

    def runs_of(k: int) -> Column:
        starts = F.when(F.size(tokens) >= k, F.sequence(F.lit(1), F.size(tokens) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, k), joiner))

    return F.array_distinct(F.flatten(F.array(*map(runs_of, lengths))))


def mentions(docs: DataFrame, entities: DataFrame, unit: str = "word", id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """(id, entity): entities in each document, each once, case ignored.

    ``word``: the name stands between single spaces or the text's ends.  ``char``: the name is anywhere in the text, for scripts
    without spaces.  Texts become n-grams up to the longest name and meet the dictionary in an equi-join.
    """
    names = entities.select(F.lower("entity").alias("gram"), "entity").where(F.length("gram") > 1)
    if unit not in ("word", "char"):
        raise ValueError("unit must be word or char")
    sizes = names.groupBy((F.size(F.split("gram", " ")) if unit == "word" else F.length("gram")).alias("k")).agg(F.count("*").alias("n")).collect()  # a row for each length of a name
    if not sizes:
        return docs.select(F.col(id_col).alias("id"), F.lit("").alias("entity")).where("false")
    joiner = " " if unit == "word" else ""
    split = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.split(F.lower(F.col(text_col)), joiner).alias("tokens"))
    rows = split.select("id", F.explode(_grams(F.col("tokens"), sorted(r.k for r in sizes), joiner)).alias("gram"))
    names = F.broadcast(names) if sum(r.n for r in sizes) <= broadcast_rows else names
    return rows.join(names, "gram").select("id", "entity").distinct()


def leftmost_longest(docs: DataFrame, entities: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, entity) as a keyword processor finds them: the longest name at the leftmost place, and no name may share a space with the one before.

    Between single spaces, case ignored, each entity once a document.  The dictionary is sent to every worker; it is a list kept by hand.
    """
    names = {tuple(r.entity.lower().split(" ")): r.entity for r in entities.where(F.length("entity") > 1).collect()}
    longest = max(map(len, names), default=0)
    given = docs.sparkSession.sparkContext.broadcast(names)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def find(text: str) -> list[str]:
            known, tokens, out, i = given.value, text.lower().split(" "), {}, 0
            while i < len(tokens):
                for k in range(min(longest, len(tokens) - i), 0, -1):
                    name = known.get(tuple(tokens[i : i + k]))
                    if name is not None:
                        out[name] = None
                        i += k + 1
                        break
                else:
                    i += 1
            return list(out)

        return texts.map(find, na_action="ignore")

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(run(F.col(text_col))).alias("entity"))
    return rows


def segmented(docs: DataFrame, tokenizer, text_col: str = "text") -> DataFrame:
    """Documents with their text as words between single spaces, by an injected tokenizer (str -> list of str), for scripts without spaces."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(tokenizer(t)), na_action="ignore")

    return docs.withColumn(text_col, run(F.col(text_col)))


def entity_counts(found: DataFrame) -> DataFrame:
    """(entity, df): documents that hold each entity."""
    return found.groupBy("entity").agg(F.count("*").alias("df"))


def knowledge_density(docs: DataFrame, entities: DataFrame, unit: str = "word", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(mentions, size, density): document frequencies summed, by the words (or characters) of all texts plus 1e-9."""
    found = mentions(docs, entities, unit, id_col, text_col).select(F.lit(1).alias("m"), F.lit(0).cast("long").alias("s"))
    size = word_count(F.col(text_col)) if unit == "word" else F.length(text_col).cast("long")
    both = found.unionAll(docs.select(F.lit(0), F.coalesce(size, F.lit(0))))
    sums = both.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("mentions"), F.coalesce(F.sum("s"), F.lit(0)).alias("size"))
    return sums.withColumn("density", F.col("mentions") / (F.col("size") + F.lit(1e-9)))


def mtld_of(tokens: list[str], threshold: float = 0.72) -> float:
    """Mean of forward and backward tokens by factors; the last, unfinished factor counts by how far it has fallen to the threshold."""

    def one(seq: list[str]) -> float:
        factors, seen, n = 0.0, set(), 0
        for t in seq:
            n += 1
            seen.add(t)
            if len(seen) / n <= threshold:
                factors += 1
                seen, n = set(), 0
        if n:
            factors += (1 - len(seen) / n) / (1 - threshold)
        return len(seq) / factors if factors else float(len(seq))

    return (one(tokens) + one(tokens[::-1])) / 2 if tokens else 0.0


def mtld(docs: DataFrame, lang: str = "en", max_len: int | None = None, text_col: str = "text") -> DataFrame:
    """Documents with ``mtld`` of their whole text, or of its first ``max_len`` words (zh: characters) if that is given."""
    if lang not in ("en", "zh"):
        raise ValueError("lang must be en or zh")

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: mtld_of(t.lower().split()), na_action="ignore").astype("float64")

    text = F.col(text_col)
    if lang == "en":
        text = text if max_len is None else truncate_words(text, max_len)
    else:
        text = char_space(text if max_len is None else F.substring(text, 1, max_len))
    return docs.withColumn("mtld", run(text))
