"""Queries of the training-data operators over the test tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cutoff, furniture, language, mixing, neardup, packing, pii, prose, repetition, sampling, tokens

from ..store import table

#: Table, id column and text column of the two corpora.
CORPORA = (("documents", "doc_id", "text"), ("corpus_lines", "line_id", "content"))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "site")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return furniture.furniture_lines(_pages(spark, folder)).withColumnRenamed("id", "doc_id")


def p1_bodies(spark: SparkSession, folder: str) -> DataFrame:
    bodies = furniture.main_bodies(_pages(spark, folder))
    return bodies.select(F.col("id").alias("doc_id"), F.md5("body").alias("body_md5"), F.length("body").cast("long").alias("body_chars"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return repetition.repetition(docs).where("share >= 0.3").select(F.col("id").alias("doc_id"))


def p2_profile(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return repetition.repetition(docs).withColumnRenamed("id", "doc_id")


SAMPLE_SIZE = 1000


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces are in one table here, so one pass stages them all; the sample is drawn after the last one."""
    stage = sampling.Stage(spark).arrive(read(spark, folder, "documents").select("doc_id", "text", "batch_no"), piece="batch_no")
    return stage.sample(SAMPLE_SIZE, seed=4).select("doc_id", "batch_no", "sample_rank", F.length("text").cast("long").alias("chars"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    jobs = [(r.job_name, r.capacity) for r in read(spark, folder, "pack_jobs").select("job_name", "capacity").collect()]  # a list kept by hand
    sized = table(tokens.token_counts(docs), "tokens")
    return packing.pack(sized, jobs).withColumnRenamed("id", "doc_id")


#: Domains of the test tables' sources.
DOMAINS = {
    "web": "webcrawl news forum blogs shops reviews",
    "reference": "encyclopedia howto government school minutes patents_like dictionary lectures",
    "culture": "recipes travel letters subtitles field_notes folklore",
}


def _mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "source", language.declared(F.col("lang")).alias("lang"))
    sized = table(tokens.token_counts(docs.where("text is not null"), keep=("source", "lang")), "tokens")
    return mixing.Mixture(sized, read(spark, folder, "mix_targets"), DOMAINS)


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).uses().withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).shares().withColumn("target_share", F.round("target_share", 6)).withColumn("actual_share", F.round("actual_share", 6))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "site", "url", F.col("lang").alias("label"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.cases(language.languages(_labelled(spark, folder))).withColumnRenamed("id", "doc_id")


def p3_languages(spark: SparkSession, folder: str) -> DataFrame:
    found = language.languages(_labelled(spark, folder))
    return found.select(F.col("id").alias("doc_id"), "lang", F.round("confidence", 6).alias("confidence"), F.transform("second", lambda p: p["x"]).alias("second"))


def p3_segments(spark: SparkSession, folder: str) -> DataFrame:
    found = language.segments(language.languages(_labelled(spark, folder)))
    return found.withColumnRenamed("id", "doc_id").withColumn("confidence", F.round("confidence", 6))


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    pages = _pages(spark, folder)
    measured = [
        prose.measure(pages, furniture.train(pages)).withColumn("rec_table", F.lit("documents")),
        prose.measure(read(spark, folder, "corpus_lines").select(F.col("line_id").alias("id"), F.col("content").alias("text"))).withColumn("rec_table", F.lit("corpus_lines")),
    ]
    both = table(measured[0].unionByName(measured[1]), "statistics")
    return prose.outliers(both, ["rec_table", "id"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records at the top of their language by layout score; one-liners of few words are ranked with the others, but are no cases."""
    junk = prose.outlying(table(_quality(spark, folder), "scored")).where("counted")
    return junk.select("rec_table", F.col("id").alias("rec_id"))


def p5_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _quality(spark, folder).withColumnRenamed("id", "rec_id")


def _cutoffs(spark: SparkSession, folder: str) -> cutoff.Cutoffs:
    """A stored tree that gets the lines in two batches, the earlier and the later ones, and is opened again between and after them."""
    lines, scores = read(spark, folder, "corpus_lines"), read(spark, folder, "ppl_scores")
    middle = lines.agg(F.expr("percentile_approx(ingested_at, 0.5)").alias("at")).first()["at"]
    early = F.coalesce(F.col("ingested_at") < F.lit(middle), F.lit(False)) if middle is not None else F.lit(False)
    path = cutoff.ScoreTree(spark).add(cutoff.scored_lines(lines.where(early), scores), "early").path
    cutoff.ScoreTree(spark, path).add(cutoff.scored_lines(lines.where(~early), scores), "late")
    return cutoff.Cutoffs(cutoff.ScoreTree(spark, path), read(spark, folder, "keep_targets"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cutoffs(spark, folder).dropped()


def p6_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    return _cutoffs(spark, folder).cuts.select("source", "n", "keep", "cut_ppl")


def _corpora(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame]]:
    return [(t, read(spark, folder, t).select(F.col(i).alias("id"), F.col(c).alias("text"))) for t, i, c in CORPORA]


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    each = [neardup.NearDuplicates(df).pairs().select(F.lit(t).alias("rec_table"), "id_lo", "id_hi") for t, df in _corpora(spark, folder)]
    return each[0].unionByName(each[1])


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    each = [neardup.NearDuplicates(df).classes().select(F.lit(t).alias("rec_table"), F.col("id").alias("rec_id"), "class_id", "copies") for t, df in _corpora(spark, folder)]
    return each[0].unionByName(each[1])


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    found = pii.mentions(docs, *(read(spark, folder, t) for t in ("name_lexicon", "entity_list")))
    return found.select(F.col("id").alias("doc_id"), "start_pos", "kind")


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return pii.redact(docs, *(read(spark, folder, t) for t in ("name_lexicon", "entity_list"))).select(F.col("id").alias("doc_id"), F.md5("text").alias("text_md5"), "n_masked")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_bodies, p2_found, p2_profile, p3_found, p3_languages, p3_segments, p4_sample, p5_found, p5_statistics, p6_found, p6_cutoffs, p7_found, p7_groups, p8_packed, p9_mixture, p9_shares, p10_found, p10_redacted)}

_SCORED = """
WITH good AS (SELECT line_id, ppl, scored_at FROM ppl_scores WHERE ppl > 0 AND ppl < 'infinity'::DOUBLE AND NOT isnan(ppl)),
latest AS (SELECT line_id, ppl FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY scored_at DESC NULLS LAST, ppl) AS r FROM good) WHERE r = 1),
scored AS (SELECT lower(trim(source)) AS source, line_id, ppl FROM corpus_lines JOIN latest USING (line_id) WHERE trim(source) <> ''),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.source ORDER BY ppl, line_id) AS r, (count(*) OVER (PARTITION BY s.source)) * keep_pct // 100 AS keep,
           count(*) OVER (PARTITION BY s.source) AS n FROM scored s JOIN keep_targets k ON lower(trim(k.source)) = s.source)
"""

SQL: dict[str, str] = {
    "p6_found": _SCORED + "SELECT source, line_id FROM ranked WHERE r > keep",
    "p6_cutoffs": _SCORED + "SELECT source, n, keep::BIGINT AS keep, max(CASE WHEN r = keep THEN ppl END) AS cut_ppl FROM ranked GROUP BY source, n, keep",
}
