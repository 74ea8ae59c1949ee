"""Rule filters, their metrics, and contamination.

A rule is a function of one column to one column (preferred: it stays inside code generation), or a plain function str -> str,
which runs as an Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import uniform

Rule = Callable[[Column], Column]
RULES: dict[str, Rule] = {}


def rule(name: str) -> Callable[[Rule], Rule]:
    """Register a rule under a name."""

    def add(fn: Rule) -> Rule:
        if name in RULES:
            raise ValueError(f"rule {name} is registered already")
        RULES[name] = fn
        return fn

    return add


def python_rule(fn: Callable[[str], str]) -> Rule:
    """A plain function as a rule; nulls pass by it."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fn, na_action="ignore")

    return run


def resolve(r: Rule | str) -> Rule:
    return RULES[r] if isinstance(r, str) else r


@rule("strip_digits")
def strip_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "")


@rule("collapse_blank_lines")
def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{2,}", "\n")


def rewritten(docs: DataFrame, rules: list[Rule | str], text_col: str = "text") -> DataFrame:
    """Documents with the rules' text as ``_new`` beside the old one."""
    new = F.col(text_col)
    for r in rules:
        new = resolve(r)(new)
    return docs.withColumn("_new", new)


def apply_rules(docs: DataFrame, rules: list[Rule | str], text_col: str = "text") -> DataFrame:
    """Documents with the text rewritten by the rules, in order.  Dropped iff the result is empty (blanks stay) or null."""
    return rewritten(docs, rules, text_col).where(F.col("_new") != "").withColumn(text_col, F.col("_new")).drop("_new")


def rule_metrics(docs: DataFrame, rules: list[Rule | str], by: str | None = None, text_col: str = "text") -> DataFrame:
    """(line_count, write_count, edit_rate): rows, kept rows, and the sum of new over old lengths of kept rows by their number plus 1e-6."""
    r = rewritten(docs, rules, text_col)
    kept = F.col("_new") != ""
    share = F.sum(F.when(kept, F.length("_new") / F.length(text_col)).otherwise(0.0))
    aggs = [F.count("*").alias("line_count"), F.count_if(kept).alias("write_count"), (F.coalesce(share, F.lit(0.0)) / (F.count_if(kept) + F.lit(1e-6))).alias("edit_rate")]
    return (r.groupBy(by) if by else r.groupBy()).agg(*aggs)


def contaminate(docs: DataFrame, fn: Rule, p: float = 0.5, max_extra: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with ``fn`` applied 1 + k times and that number as ``n_rounds``.

    k is the number of leading draws, out of ``max_extra``, that are at most p; draws depend on the seed, the id and the round.
    """
    if max_extra < 0:
        raise ValueError("max_extra must not be negative")
    rounds = F.lit(1)
    goes_on = F.lit(True)
    for i in range(1, max_extra + 1):
        goes_on = goes_on & (uniform(F.lit(str(seed)), F.lit(str(i)), F.col(id_col).cast("string")) <= p)
        rounds = rounds + F.when(goes_on, 1).otherwise(0)
    out = docs.withColumn("n_rounds", rounds)
    text = F.col(text_col)
    for i in range(1, max_extra + 2):
        text = F.when(F.col("n_rounds") >= i, fn(text)).otherwise(text)
    return out.withColumn(text_col, text)
