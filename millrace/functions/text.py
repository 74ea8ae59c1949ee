"""Column functions on text.  All are built from Spark's own functions and stay inside code generation.

A null text gives null everywhere.  Lengths and positions count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of the 29 code points that separate words.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def para_count(text: Column) -> Column:
    """Lines after each pair of line breaks has become one, left to right, once."""
    return F.size(F.split(F.replace(text, F.lit("\n\n"), F.lit("\n")), "\n")).cast("long")


def truncate_words(text: Column, k: int) -> Column:
    """The first k words with single spaces between them."""
    return F.array_join(F.slice(words(text), 1, k), " ")


def truncate_spaces(text: Column, k: int) -> Column:
    """The text before its k-th single space; runs of spaces hold empty tokens, which count."""
    return F.substring_index(text, " ", k)


def char_space(text: Column) -> Column:
    """One space between any two code points."""
    return F.regexp_replace(text, "(?s)(.)(?=.)", "$1 ")


def char_truncate(text: Column, k: int) -> Column:
    return F.substring(text, 1, k)


def normalise_space(text: Column) -> Column:
    return F.array_join(words(text), " ")


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct n-grams of code points; none if the text is shorter than n."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}})).") if n > 1 else F.lit("(?s)(.)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays without repeats; null if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.try_divide(common.cast("double"), (F.size(a) + F.size(b) - common).cast("double"))


def jaccard_sim(a: Column, b: Column, n: int = 5) -> Column:
    return jaccard(shingles(a, n), shingles(b, n))


def recall_prob(similarity: Column, seeds: int, bands: int) -> Column:
    """Chance that a pair of that similarity shares a band."""
    rows = seeds // bands
    return 1 - F.pow(1 - F.pow(similarity, F.lit(float(rows))), F.lit(float(bands)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one of them is all zeros."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone: the first 7 hex digits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 7), 16, 10).cast("long") / float(1 << 28)
