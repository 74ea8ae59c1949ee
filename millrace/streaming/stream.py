"""Streams of documents.  Rule filters are plain projections and run on a stream as they are; these add what needs state.

The reference jobs are batch jobs; these are an extension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.rules import Rule, apply_rules


def read_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_each: int = 16) -> DataFrame:
    """New files of a folder, as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).format(fmt).load(path)


def filter_stream(docs: DataFrame, rules: list[Rule | str], text_col: str = "text") -> DataFrame:
    return apply_rules(docs, rules, text_col)


def drop_repeats(docs: DataFrame, time_col: str, delay: str = "1 hour", text_col: str = "text") -> DataFrame:
    """Drop documents whose text was seen within the delay; state is a 16-byte hash a text and is cleared by the watermark."""
    keyed = docs.withColumn("_h", F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["_h"]).drop("_h")


def counts_by_window(docs: DataFrame, time_col: str, by: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(start, by, docs): documents in tumbling windows; late ones count until the watermark has passed."""
    w = F.window(time_col, window)
    return docs.withWatermark(time_col, delay).groupBy(w.alias("w"), by).agg(F.count("*").alias("docs")).select(F.col("w.start").alias("start"), by, "docs")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is there to a Parquet folder and stop."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start().awaitTermination()
