"""Reading and writing corpora of one JSON document a line, and Parquet tables.

A corpus is a folder tree in which every file at any depth is data.  Documents carry unknown fields through untouched: beside
the text, the raw line is kept as ``_raw``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_corpus(spark: SparkSession, path: str, text_col: str = "text", fmt: str = "json", strict: bool = True) -> DataFrame:
    """Documents of a corpus.

    JSON lines give (text, file, _raw); with ``strict`` a line that is no JSON object or has no text field fails the job, else
    its text is null.  Blank lines are skipped.  Parquet gives the table as it is.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt != "json":
        raise ValueError("fmt must be json or parquet")
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("value").alias("_raw"), F.col("_metadata.file_path").alias("file"))
    lines = lines.where(F.trim("_raw") != "")
    text = F.get_json_object("_raw", f"$['{text_col}']")
    if strict:
        text = F.coalesce(text, F.raise_error(F.concat(F.lit(f"no field {text_col} in: "), F.substring("_raw", 1, 200))).cast("string"))
    return lines.select(text.alias(text_col), "file", "_raw")


def file_index(docs: DataFrame, file_col: str = "file") -> DataFrame:
    """(file, lines, first_id): files by falling (lines, name) with the number of lines before them.  One row a file."""
    counts = docs.groupBy(F.col(file_col).alias("file")).agg(F.count("*").alias("lines"))
    before = Window.orderBy(F.desc("lines"), F.desc("file")).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first_id", F.coalesce(F.sum("lines").over(before), F.lit(0)).cast("long"))


def with_ids(docs: DataFrame, order: list[str], file_col: str = "file", id_col: str = "doc_id") -> DataFrame:
    """Documents with contiguous ids: the file's first id plus the place within the file by ``order``."""
    place = F.row_number().over(Window.partitionBy(file_col).orderBy(*order)) - 1
    index = file_index(docs, file_col).select(F.col("file").alias(file_col), "first_id")
    return docs.withColumn("_place", place).join(index, file_col).withColumn(id_col, F.col("first_id") + F.col("_place")).drop("first_id", "_place")


def write_corpus(docs: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """JSON lines with null fields kept; ``by`` makes a folder for each of its values."""
    w = docs.write.mode(mode).option("ignoreNullFields", False)
    (w.partitionBy(by) if by else w).json(path)


def write_raw(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The raw lines of documents, unchanged."""
    docs.select("_raw").write.mode(mode).text(path)


def write_mirrored(docs: DataFrame, source: str, path: str, file_col: str = "file", mode: str = "errorifexists") -> None:
    """The raw lines of documents as a tree like the one they were read from: a folder for each file of ``source``, under its own path.

    Spark writes a folder of parts where the source has a file; the folder's name is the file's path below ``source``.
    """
    below = F.regexp_replace(F.col(file_col), "^.*?" + re.escape(source.rstrip("/").split("://")[-1].lstrip("/")) + "/", "")
    docs.select("_raw", below.alias("file")).repartition("file").write.mode(mode).partitionBy("file").text(path)


def write_pairs(pairs: DataFrame, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "errorifexists") -> None:
    """Scored pairs (lo, hi, sim) as {text0, text1, pair, sim}."""
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    both = pairs.join(text.select(F.col("_id").alias("lo"), F.col("_text").alias("text0")), "lo").join(text.select(F.col("_id").alias("hi"), F.col("_text").alias("text1")), "hi")
    write_corpus(both.select("text0", "text1", F.array("lo", "hi").alias("pair"), "sim"), path, mode=mode)


def write_split(labelled: DataFrame, path: str, label_col: str = "label", mode: str = "errorifexists") -> None:
    """One folder for each label, such as pos and neg; with a column ``rank`` its files, read in the order of their names, rise by it."""
    if "rank" in labelled.columns:
        labelled = labelled.repartitionByRange(label_col, "rank").sortWithinPartitions(label_col, "rank")
    write_corpus(labelled, path, by=label_col, mode=mode)


def write_profile(profile: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A profile of one row as one JSON object."""
    profile.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)


def read_entities(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(entity) of an entity list with name_en and name_zh; names of one character are dropped."""
    rows = spark.read.schema("name_en string, name_zh string").option("mode", "FAILFAST").json(path)
    return entities(rows, lang)


def entities(rows: DataFrame, lang: str) -> DataFrame:
    if lang not in ("en", "zh"):
        raise ValueError("lang must be en or zh")
    return rows.select(F.col(f"name_{lang}").alias("entity")).where(F.length("entity") > 1).distinct()
