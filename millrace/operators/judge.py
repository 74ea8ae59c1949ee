"""Labels from a judge that answers 1 (good) or 0 (bad) in free text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate_words

INSTRUCTION = "Answer with 1 if the text is good and with 0 if it is not."


def prompts(docs: DataFrame, prompt: str, truncation: int = 512, text_col: str = "text", instruction: str = INSTRUCTION) -> DataFrame:
    """Documents with ``prompt``: the question, the instruction and the text cut to words, in quotes."""
    quoted = F.concat(F.lit(f"{prompt}\n{instruction}\n'''"), truncate_words(F.col(text_col), truncation), F.lit("'''"))
    return docs.withColumn("prompt", quoted)


def ask(asked: DataFrame, fn: Callable[[str], str]) -> DataFrame:
    """Documents with ``response`` of an injected judge; null prompts have none.  There is no network access by default."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(fn, na_action="ignore")

    return asked.withColumn("response", run("prompt"))


def is_good(response: Column, strict: bool = True) -> Column:
    """Whether an answer says 1; ``strict`` also asks that it doesn't say 0."""
    r = F.coalesce(response, F.lit(""))
    return (r.contains("1") & ~r.contains("0")) if strict else r.contains("1")


def is_bad(response: Column, strict: bool = True) -> Column:
    r = F.coalesce(response, F.lit(""))
    return (r.contains("0") & ~r.contains("1")) if strict else r.contains("0")


def verdicts(answers: DataFrame, strict: bool = True, response_col: str = "response") -> DataFrame:
    """Answers with ``verdict`` pos or neg.  Not strict, an answer that says both has a row of each.  Answers that say neither are left out."""
    labels = F.array_compact(F.array(F.when(is_good(F.col(response_col), strict), "pos"), F.when(is_bad(F.col(response_col), strict), "neg")))
    return answers.withColumn("verdict", F.explode(labels))
