"""Samples that depend on ids and a seed alone, not on files, partitions or order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import BROADCAST_KEYS
from ..functions.text import char_truncate


def sample(docs: DataFrame, n: int, seed: int = 0, id_col: str = "doc_id", mode: str = "hash") -> DataFrame:
    """min(n, N) documents, uniform without replacement: a bounded heap of ids in each partition, no full sort.  Texts stay where they are
    and meet the drawn ids (``id_col`` must be unique).

    ``hash`` takes the smallest MD5 of seed and id, ``rand`` Spark's generator, ``first`` just the first rows that come (fast, biased).
    """
    if n < 0:
        raise ValueError("n must not be negative")
    if mode == "hash":
        drawn = docs.select(id_col).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col))), id_col).limit(n)
        return docs.join(F.broadcast(drawn) if n <= BROADCAST_KEYS else drawn, id_col, "left_semi")
    if mode == "rand":
        return docs.orderBy(F.rand(seed)).limit(n)
    if mode == "first":
        return docs.limit(n)
    raise ValueError("mode must be hash, rand or first")


def sample_pairs(pairs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n pairs (i, j, ...) by the hash of both ids and the seed."""
    return pairs.orderBy(F.xxhash64("i", "j", F.lit(seed)), "i", "j").limit(n)


def sample_batches(docs: DataFrame, count: int, size: int, max_chars: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(batch, slot, text): ``count`` batches of at most ``size`` texts cut to ``max_chars`` characters.

    The first count * size documents by hash fill the slots; the next ones are appended, after an empty line, to the slots whose
    text is short, in turn and each slot at most once, and cut again.  Nulls are left out.
    """
    if count < 1 or size < 1:
        raise ValueError("count and size must be at least 1")
    order = Window.orderBy("_h", id_col)
    top = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col))).alias("_h"))
    # a bounded number of rows: the slots and as many fillers
    top = top.orderBy("_h", id_col).limit(2 * count * size).withColumn("_r", F.row_number().over(order) - 1)
    slots = top.where(F.col("_r") < count * size).select((F.col("_r") % count).alias("batch"), F.floor(F.col("_r") / count).alias("slot"), char_truncate(F.col("text"), max_chars).alias("text"))
    short = slots.where(F.length("text") < max_chars).withColumn("_k", F.row_number().over(Window.orderBy("slot", "batch")))
    filler = top.where(F.col("_r") >= count * size).select((F.col("_r") - count * size + 1).alias("_k"), F.col("text").alias("more"))
    more = short.join(filler, "_k").select("batch", "slot", "more")
    full = slots.join(more, ["batch", "slot"], "left")
    text = F.when(F.col("more").isNull(), F.col("text")).otherwise(char_truncate(F.concat_ws("\n\n", "text", "more"), max_chars))
    return full.select(F.col("batch").cast("long").alias("batch"), F.col("slot").cast("long").alias("slot"), text.alias("text"))
