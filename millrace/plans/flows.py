"""Whole jobs put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_space, para_count, word_count
from ..operators import dedup, judge, knowledge, lm, sampling, vectors
from ..settings import Settings
from ..sources import corpus
from ..store import table

def judged_split(docs: DataFrame, ask, instruction: str, n: int | None = None, strict: bool = True, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A sample of n documents (or all), asked about by an injected judge and split: (id, text, verdict), verdict pos or neg; what is neither is left out."""
    some = docs.where(F.col(text_col).isNotNull())
    some = some if n is None else sampling.sample(some, n, seed, id_col)
    said = judge.verdicts(judge.ask(judge.prompts(some, instruction, truncation=1_000_000, text_col=text_col), ask), strict=strict)
    return said.select(id_col, text_col, "verdict")


def batch_diversity(docs: DataFrame, fisher, batches: int = 50, size: int = 512, max_chars: int = 512, variance: str = "ci_0.95", seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pairs, mean, spread) of the distances between batches of sampled texts, each embedded by an injected function from texts to a vector."""
    drawn = sampling.sample_batches(docs, batches, size, max_chars, seed, id_col, text_col)
    return vectors.batch_diversity(table(vectors.batch_embeddings(drawn, fisher), "batches"), variance=variance)


def entity_cosines(docs: DataFrame, entities: DataFrame, embed, n: int | None = None, seed: int = 0, unit: str = "word", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, j, sim): cosines of a tenth of n * n pairs of the entities that occur in the documents, by an injected model of their names.

    ``n`` bounds the entities (the most frequent first); None takes all.
    """
    found = knowledge.entity_counts(knowledge.mentions(docs, entities, unit, id_col, text_col)).orderBy(F.desc("df"), "entity")
    found = table(found if n is None else found.limit(n), "entities")
    vecs = table(vectors.embed(found.select(F.xxhash64("entity").alias("id"), "entity"), embed, "id", "entity"), "entity-vectors")
    m = vecs.count()
    return vectors.pair_cosines(vecs, max(1, m * m // 10), seed)


METRICS = ("length", "mtld", "knowledge", "lm", "semantic", "cluster", "diversity")


def fuzzy_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, removed, pairs) of a corpus."""
    pairs = dedup.duplicates(docs, n=n, id_col=id_col, text_col=text_col, **options)
    kept, removed = dedup.deduplicate(docs, pairs, n=n, id_col=id_col, text_col=text_col)
    return kept, removed, pairs


def quality_split(docs: DataFrame, scorer: lm.Scorer, sample_size: int | None = None, q: float = 0.8, unit: str = "char", truncation: int | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """Documents, or a sample of them, with ``ppl``, ``rank`` and ``label`` pos or neg.  Whole texts are scored unless ``truncation`` is given."""
    some = docs if sample_size is None else sampling.sample(docs, sample_size, seed, id_col)
    return lm.split_by_quantile(lm.perplexity(some, scorer, text_col, unit, truncation), "ppl", q, id_col)


def length_profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words, paragraphs) of each document."""
    return docs.select(F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("words"), para_count(F.col(text_col)).alias("paragraphs"))


def _list(rows: DataFrame, order: str, *columns: str) -> DataFrame:
    """One row: a list of each column in the order of another.  For samples: a list is one cell."""

    def ordered(c: str):
        return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(c).alias("v")))), lambda p: p["v"]).alias(c)

    return rows.agg(*map(ordered, columns))


def profile(
    docs: DataFrame,
    metrics: list[str] | tuple[str, ...] = METRICS,
    n: int | None = 10_000,
    lang: str = "en",
    seed: int = 0,
    entities: DataFrame | None = None,
    scorer: lm.Scorer | None = None,
    embeddings: DataFrame | None = None,
    clusters: int = 100,
    embed=None,
    fisher=None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row with the metrics asked for, over a sample of n documents and n vectors by hash, or over all of them if n is None.  ``embeddings``: (vec_id, embedding[, label]).

    ``embed`` (a loader of a model from texts to vectors) adds ``list_sim_knowledge``, cosines of entities; ``fisher`` (texts to one
    vector) makes ``task2vec_div`` from sampled batches of texts instead of the stand-in over labelled vectors.

    Lists have an entry for each document and are one cell each, so their length bounds what None is good for.  ``list_sim_semantic`` has
    drawn pairs, a tenth as many as vectors; ``mean_sim_semantic`` is over all pairs.
    """
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    some = docs.where(F.col(text_col).isNotNull())
    some = some if n is None else sampling.sample(some, n, seed, id_col).cache()
    parts: list[DataFrame] = []
    if "length" in metrics:
        rows = length_profile(some, id_col, text_col)
        parts.append(_list(rows, "id", "words", "paragraphs").withColumnsRenamed({"words": "list_doc_length", "paragraphs": "list_para_count"}))
    if "mtld" in metrics:
        parts.append(_list(knowledge.mtld(some, lang, text_col=text_col), id_col, "mtld").withColumnRenamed("mtld", "list_mtld_score"))
    if "knowledge" in metrics and entities is not None:
        parts.append(knowledge.knowledge_density(some, entities, "word" if lang == "en" else "char", id_col, text_col).select(F.col("density").alias("knowledge_density")))
        if embed is not None:
            sims = entity_cosines(some, entities, embed, seed=seed, unit="word" if lang == "en" else "char", id_col=id_col, text_col=text_col)
            parts.append(sims.agg(F.array_sort(F.collect_list("sim")).alias("list_sim_knowledge")))
    if "diversity" in metrics and fisher is not None:
        parts.append(batch_diversity(docs, fisher, seed=seed, id_col=id_col, text_col=text_col).select(F.col("mean").alias("task2vec_div")))
    if "lm" in metrics:
        score = scorer or lm.unigram_scorer(table(lm.unigrams(docs, text_col), "unigrams"), id_col)
        ppl = lm.perplexity(some.withColumn(text_col, normalise_space(F.col(text_col))), score, text_col, "word" if lang == "en" else "char", None)
        parts.append(_list(ppl, id_col, "ppl").withColumnRenamed("ppl", "list_kenlm_ppl"))
    if embeddings is not None:
        vecs = embeddings.select("vec_id", "embedding")
        vecs = vecs if n is None else sampling.sample(vecs, n, seed, "vec_id")
        if "semantic" in metrics:
            sims = vectors.pair_cosines(vecs, max(1, vecs.count() // 10), seed)
            parts.append(sims.agg(F.array_sort(F.collect_list("sim")).alias("list_sim_semantic")))
            parts.append(vectors.mean_cosine(vecs).select(F.col("mean_cosine").alias("mean_sim_semantic")))
        if "cluster" in metrics:
            m, sims = vectors.cluster_profile(vectors.kmeans(vecs, clusters, seed=seed))
            parts.append(_list(m, "cluster", "size").withColumnRenamed("size", "list_cluster_size"))
            parts.append(sims.agg(F.array_sort(F.collect_list("sim")).alias("list_sim_cluster")))
        if "diversity" in metrics and fisher is None and "label" in embeddings.columns:
            parts.append(vectors.batch_diversity(vectors.hessians(embeddings)).select(F.col("mean").alias("task2vec_div")))
    if not parts:
        raise ValueError("none of the metrics can be computed from what is given")
    one = parts[0].withColumn("_k", F.lit(0))
    for p in parts[1:]:  # each part is one row
        one = one.join(p.withColumn("_k", F.lit(0)), "_k")
    return one.drop("_k")


JOBS = ("dedup", "quality", "profile")


def run_job(spark: SparkSession, job: str, settings: Settings, scorer: lm.Scorer | None = None, **given) -> DataFrame | tuple[DataFrame, DataFrame, DataFrame]:
    """A whole job over the corpus that the settings name, JSON lines or Parquet by its ending, with their options; ``given`` wins over them.

    Documents without an id get the contiguous ids of their files and lines.
    """
    if job not in JOBS:
        raise ValueError(f"job must be one of {JOBS}")
    text = settings.text_col
    fmt = "parquet" if settings.corpus.rstrip("/").endswith(".parquet") else "json"
    docs = corpus.read_corpus(spark, settings.corpus, text, fmt)
    if "doc_id" not in docs.columns:
        docs = table(corpus.with_ids(docs, ["_raw"]), "corpus")
    if job == "dedup":
        return fuzzy_dedup(docs, text_col=text, **({"n": settings.ngram, "threshold": settings.threshold, "seeds": settings.seeds, "bands": settings.bands, "seed": settings.seed} | given))
    if job == "quality":
        score = scorer or lm.unigram_scorer(table(lm.unigrams(docs, text, "char"), "unigrams"))
        return quality_split(docs, score, text_col=text, **({"q": settings.quantile, "truncation": settings.truncation, "seed": settings.seed} | given))
    return profile(docs, text_col=text, scorer=scorer, **({"n": settings.sample_size, "seed": settings.seed} | given))
