"""Joins that hold when a key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys up to this many are broadcast whole.
BROADCAST_KEYS = 200_000
#: Of more keys, those with at least one row in so many are broadcast; there are at most that many.
HOT_KEYS = 10_000


def partitions(df: DataFrame) -> int:
    """As many partitions as the session shuffles into."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lookup(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str = "n", broadcast_keys: int = BROADCAST_KEYS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` left-joined to ``keyed``, which has one row a key and in ``weight`` the number of rows that will look it up.

    Few keys (counted, not guessed) are broadcast.  Of many, the frequent ones are, and only rows of rare keys are shuffled by key;
    the others are spread by a salt that meets nothing.  ``keyed`` is read several times, so it should be a table.  ``weight``
    isn't in the result.
    """
    values = [c for c in keyed.columns if c not in keys and c != weight]
    if keyed.count() <= broadcast_keys:
        return rows.join(F.broadcast(keyed.select(*keys, *values)), keys, "left")
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * hot_keys >= F.lit(total)
    hot = keyed.where(is_hot).select(*keys, *(F.col(v).alias(f"__{v}") for v in values), F.lit(True).alias("__hot"))
    rare = keyed.where(~is_hot).select(*keys, *values, F.lit(-1).alias("__salt"))
    seen = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(4096)).cast("int")).otherwise(F.lit(-1)))
    both = seen.join(rare, [*keys, "__salt"], "left")
    return both.select(*rows.columns, *(F.coalesce(f"__{v}", v).alias(v) for v in values))
