"""Similarity of sentence vectors, cluster medoids, and diversity of batches."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grams import mixed
from ..functions.text import cosine, norm
from ..store import table

DISTANCES = {}


def distance(name: str):
    """Register a distance of two structs (hessian, scale) under a name."""

    def add(fn):
        DISTANCES[name] = fn
        return fn

    return add


def embed(docs: DataFrame, load, id_col: str = "doc_id", text_col: str = "text", max_len: int | None = None) -> DataFrame:
    """(vec_id, embedding) by an injected model.

    ``load`` is called once in each Python worker and gives a function from a list of texts to as many vectors; nulls are left out.
    """

    def run(batches):
        import pandas as pd

        model = load()
        for b in batches:
            texts = [t if max_len is None else t[:max_len] for t in b["text"]]
            yield pd.DataFrame({"vec_id": b["id"].to_numpy(), "embedding": [list(map(float, v)) for v in model(texts)]})

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "vec_id long, embedding array<float>")


def batch_embeddings(batches: DataFrame, fisher) -> DataFrame:
    """(id, v) by an injected function from the texts of a batch, in the order of slots, to one vector.  Batches (batch, slot, text) are of bounded size."""

    def run(pdf):
        import pandas as pd

        texts = pdf.sort_values("slot")["text"].tolist()
        return pd.DataFrame({"id": [int(pdf["batch"].iloc[0])], "v": [list(map(float, fisher(texts)))]})

    return batches.groupBy("batch").applyInPandas(run, "id long, v array<double>")


def mean_cosine(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(vectors, pairs, mean_cosine) over all pairs i < j, in one pass: the squared length of the sum of unit vectors holds every pair twice.

    Zero vectors have cosine 0 with all others.
    """
    unit = vectors.select(F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("v")).withColumn("l", norm(F.col("v")))
    n = unit.agg(F.count("*").alias("n"), F.count_if(F.col("l") > 0).alias("m")).first()
    parts = unit.where("l > 0").select("l", F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x") / F.col("l")).alias("s"))
    whole = parts.agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)).alias("q"))
    pairs = n.n * (n.n - 1) // 2
    return whole.select(F.lit(n.n).cast("long").alias("vectors"), F.lit(pairs).cast("long").alias("pairs"), F.when(F.lit(pairs) > 0, (F.col("q") - F.lit(float(n.m))) / 2 / F.lit(float(max(1, pairs)))).alias("mean_cosine"))


def pair_cosines(vectors: DataFrame, k: int, seed: int = 0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(i, j, sim): ``k`` different pairs drawn uniformly from all pairs i < j, and only they, are compared.

    Vectors are numbered by rank of their id, pairs by a bijection of k numbers into all pairs' numbers, so that executors draw
    them and nothing but counts is on the driver: a keyed permutation of the next power of two, walked on until it is inside.
    """
    from .lm import global_rank

    ranked = table(global_rank(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), ["id"]).select((F.col("rank") - 1).alias("r"), "id", "v"), "numbered")
    n = ranked.count()
    total = n * (n - 1) // 2
    spark = vectors.sparkSession

    def run(batches):
        import pyarrow as pa

        for b in batches:
            a, c = pair_numbers(permuted(b.column(0).to_numpy(zero_copy_only=False), total, seed))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    wanted = spark.range(min(k, total)).mapInArrow(run, "a long, b long")
    left = ranked.select(F.col("r").alias("a"), F.col("id").alias("i"), F.col("v").alias("v0"))
    right = ranked.select(F.col("r").alias("b"), F.col("id").alias("j"), F.col("v").alias("v1"))
    return wanted.join(left, "a").join(right, "b").select("i", "j", cosine(F.col("v0"), F.col("v1")).alias("sim"))


def permuted(x: np.ndarray, total: int, seed: int) -> np.ndarray:
    """Places of numbers below ``total`` under a permutation of them that depends on the seed: four Feistel rounds, repeated while outside."""
    if total < 2:
        return x.astype(np.int64)
    half = max(1, ((total - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64((seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF) for i in range(4)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & low
        for key in keys:
            left, right = right, left ^ ((mixed(right ^ key) >> np.uint64(20)) & low)
        return (left << np.uint64(half)) | right

    out = once(x.astype(np.uint64))
    while (far := out >= np.uint64(total)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def pair_numbers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b), a < b, by number: x = b (b - 1) / 2 + a; for up to 2^31 vectors."""
    b = ((1 + np.sqrt(8.0 * x + 1)) / 2).astype(np.int64)
    b += (b + 1) * b // 2 <= x
    b -= b * (b - 1) // 2 > x
    return x - b * (b - 1) // 2, b


def medoids(assigned: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cluster_col: str = "cluster") -> DataFrame:
    """(cluster, medoid, size, dist): the member next to the mean of its cluster, the smallest id first.

    Means are summed by cluster and dimension with partial sums; no cluster is gathered.
    """
    flat = assigned.select(F.col(cluster_col).alias("cluster"), F.posexplode(vec_col).alias("d", "x"))
    centre = flat.groupBy("cluster", "d").agg(F.avg(F.col("x").cast("double")).alias("c"))
    centre = centre.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda p: p["c"]).alias("centre"))  # one entry a dimension
    far = assigned.select(F.col(id_col).alias("id"), F.col(cluster_col).alias("cluster"), F.col(vec_col).alias("v")).join(centre, "cluster")
    diff = F.zip_with("v", "centre", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    far = far.select("cluster", F.struct(F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x)).alias("dist"), F.col("id")).alias("m"))
    return far.groupBy("cluster").agg(F.min("m").alias("m"), F.count("*").alias("size")).select("cluster", F.col("m.id").alias("medoid"), "size", F.col("m.dist").alias("dist"))


def kmeans(vectors: DataFrame, k: int, max_iter: int = 400, seed: int = 0, vec_col: str = "embedding", start: list[list[float]] | None = None) -> DataFrame:
    """Vectors with ``cluster`` by k-means, from a drawn start or a given one of k centres.

    Input is persisted for the rounds (on disk where memory is short).  Of a given start every round is one aggregation by cluster
    and dimension; only the k centres reach the driver.  A cluster that becomes empty keeps its centre; ties go to the lower number.
    """
    from pyspark.storagelevel import StorageLevel

    if start is not None:
        return _lloyd(vectors, start, max_iter, vec_col)
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.withColumn("_f", array_to_vector(F.transform(F.col(vec_col), lambda x: x.cast("double")))).persist(StorageLevel.MEMORY_AND_DISK)
    model = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="_f", predictionCol="cluster").fit(data)
    out = table(model.transform(data).drop("_f"), "clusters")
    data.unpersist()
    return out


def nearest(v: Column, centres: list[list[float]]) -> Column:
    """Number of the nearest centre, the lowest of equal ones."""
    far = lambda c: F.aggregate(F.zip_with(v, F.lit(c), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    places = [far(c) for c in centres]
    return F.array_position(F.array(*places), F.array_min(F.array(*places))).cast("int") - 1


def _lloyd(vectors: DataFrame, start: list[list[float]], max_iter: int, vec_col: str) -> DataFrame:
    data = vectors.persist()
    centres = [list(map(float, c)) for c in start]
    for _ in range(max_iter):
        flat = data.select(nearest(F.col(vec_col), centres).alias("k"), F.posexplode(vec_col).alias("d", "x"))
        new = [list(c) for c in centres]
        for r in flat.groupBy("k", "d").agg(F.avg(F.col("x").cast("double")).alias("m")).collect():  # clusters times dimensions
            new[r.k][r.d] = r.m
        if new == centres:
            break
        centres = new
    out = table(data.withColumn("cluster", nearest(F.col(vec_col), centres)), "clusters")
    data.unpersist()
    return out


def cluster_profile(assigned: DataFrame, **names) -> tuple[DataFrame, DataFrame]:
    """Medoids with sizes, and the cosines between medoids (one row for each pair of clusters)."""
    m = medoids(assigned, **names)
    id_col, vec_col = names.get("id_col", "vec_id"), names.get("vec_col", "embedding")
    vec = assigned.select(F.col(id_col).alias("medoid"), F.col(vec_col).alias("v")).join(m.select("medoid", "cluster"), "medoid")
    return m, pairwise(vec.select(F.col("cluster").alias("id"), "v"), lambda a, b: cosine(a, b)).withColumnRenamed("value", "sim")


def pairwise(few: DataFrame, fn) -> DataFrame:
    """(i, j, value) for i < j of a short table (id, v): as many rows as clusters or batches, which their number bounds."""
    a, b = few.select(F.col("id").alias("i"), F.col("v").alias("v0")), few.select(F.col("id").alias("j"), F.col("v").alias("v1"))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", fn(F.col("v0"), F.col("v1")).alias("value"))


def hessians(rows: DataFrame, batch_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(id, v): mean square of each dimension over a batch; a stand-in for a model's Fisher information."""
    flat = rows.select(F.col(batch_col).alias("id"), F.posexplode(vec_col).alias("d", "x"))
    mean = flat.groupBy("id", "d").agg(F.avg(F.col("x").cast("double") * F.col("x").cast("double")).alias("h"))
    return mean.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "h"))), lambda p: p["h"]).alias("v"))


@distance("cosine")
def scaled_cosine(a: Column, b: Column) -> Column:
    """1 - cosine of both vectors divided by their sum plus 1e-8."""
    left = F.zip_with(a, b, lambda x, y: x / (x + y + 1e-8))
    right = F.zip_with(a, b, lambda x, y: y / (x + y + 1e-8))
    return 1 - cosine(left, right)


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t, by bisection on its distribution (Simpson's rule)."""

    def cdf(x: float) -> float:
        n, c = 2000, math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        f = lambda t: c * (1 + t * t / df) ** (-(df + 1) / 2)
        h = x / n
        return 0.5 + h / 3 * (f(0) + f(x) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, n)))

    lo, hi = 0.0, 1e3
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def batch_diversity(embeddings: DataFrame, metric: str = "cosine", variance: str = "ci_0.95") -> DataFrame:
    """(pairs, mean, spread) of the distances between batches (id, v) that are not 0.

    ``spread`` is the half width of the 95 % confidence interval of the mean, or the standard deviation for ``std``.
    """
    if variance not in ("ci_0.95", "std"):
        raise ValueError("variance must be ci_0.95 or std")
    d = pairwise(embeddings, DISTANCES[metric]).where("value <> 0")
    got = d.agg(F.count("*").alias("pairs"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    if variance == "std":
        return got.select("pairs", "mean", F.col("sd").alias("spread"))
    n = d.count()
    t = t_quantile(0.975, n - 1) if n > 1 else float("nan")
    return got.select("pairs", "mean", (F.lit(t) * F.col("sd") / F.sqrt("pairs")).alias("spread"))
