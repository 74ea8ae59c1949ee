"""Uniform sample of fixed size from data that arrives in pieces and whose size is not known before the end.

Pieces are staged as they arrive, each written once.  After the last one the rows of each staged file are counted, ``size``
distinct ranks are drawn uniformly below the total, and each rank is found as (file, row) by the prefix sums of the counts; only
the files that hold a drawn rank are read.  Every set of ``size`` rows is equally likely, whatever the sizes and the order of the
pieces.  Counts of files and the drawn ranks are on the driver, so ``size`` should be some millions at most.

A column named ``sample_rank`` gives way to the rank.  Fewer rows than ``size``: all are returned.  Null and empty texts are rows like others.  Repeated rows count each.  A piece
may be empty; without any rows the sample is empty.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import shared_dir

#: Ranks up to this many go to the executors by broadcast; beyond it they are joined by shuffle.
BROADCAST_RANKS = 200_000


def distinct_ranks(total: int, size: int, seed: int) -> np.ndarray:
    """``size`` different numbers below ``total``, every set equally likely: drawn until there are enough, or those to leave out are."""
    rng = np.random.default_rng(seed)
    few = min(size, total - size)
    found = np.zeros(0, np.int64)
    while len(found) < few:
        fresh = rng.integers(0, total, few - len(found))
        both = np.concatenate([found, fresh])
        found = both[np.sort(np.unique(both, return_index=True)[1])]
    if few == size:
        return np.sort(found)
    return np.setdiff1d(np.arange(total, dtype=np.int64), found)


class Stage:
    """Staged pieces in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
        self.schema = None

    def arrive(self, rows: DataFrame, piece: str | None = None) -> Stage:
        """Append a piece as it is; with ``piece``, several of them, told apart by that column, in one pass."""
        self.schema = self.schema or rows.schema
        if rows.schema != self.schema:
            raise ValueError("pieces must have the same columns")
        to = rows.write.mode("append").option("compression", "zstd")
        if piece is not None:
            to = rows.withColumn("__piece", F.col(piece)).write.mode("append").option("compression", "zstd").partitionBy("__piece")
        to.parquet(f"{self.path}/{uuid.uuid4().hex}")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)

    def counts(self) -> list[tuple[str, int]]:
        """Rows of each staged file, in a fixed order: one line a file."""
        found = self.rows().groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n")).collect()
        return sorted((r.file, r.n) for r in found)

    def sample(self, size: int, seed: int = 0) -> DataFrame:
        """``size`` rows, each set of rows equally likely, with their global rank as ``sample_rank``."""
        if size < 0:
            raise ValueError("size must not be negative")
        if self.schema is None:
            raise ValueError("no piece has arrived")
        counts = self.counts()
        ends = np.cumsum([n for _, n in counts], dtype=np.int64) if counts else np.zeros(0, np.int64)
        total = int(ends[-1]) if len(ends) else 0
        ranks = distinct_ranks(total, min(size, total), seed)
        file = np.searchsorted(ends, ranks, side="right")
        starts = np.concatenate([[0], ends])[file] if len(ranks) else ranks
        drawn = [(counts[f][0], int(r - s), int(r)) for f, r, s in zip(file, ranks, starts, strict=True)]
        wanted = self.spark.createDataFrame(drawn, "__file string, __row long, sample_rank long")
        own = [F.col(f"`{c}`") for c in self.schema.names if c not in ("sample_rank", "__file", "__row")]
        files = sorted({f for f, _, _ in drawn})
        if not files:
            return self.rows().where("false").select(*own, F.lit(0).cast("long").alias("sample_rank"))
        held = self.spark.read.schema(self.schema).parquet(*files)
        rows = held.select(*own, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        wanted = F.broadcast(wanted) if len(drawn) <= BROADCAST_RANKS else wanted
        return rows.join(wanted, ["__file", "__row"]).drop("__file", "__row")
