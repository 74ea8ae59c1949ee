"""Sets of character n-grams as sorted arrays of 64-bit hashes, and the joins over them.

Hashing, prefixes and verification run over Arrow batches with numpy, so that no n-gram becomes a row but those of a prefix.
Null texts and texts shorter than n have no n-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of token frequencies, in bits of a token's hash.
COUNTER_BITS = 20
#: One row in so many is looked at for keys that many rows share; those with so many (as estimated) are joined in blocks of BLOCK.
PROBE, HOT, BLOCK = 64, 4096, 1024
#: Rows of a batch that are worked on at a time.
SLICE = 256
#: Bytes of texts of a slice whose n-grams are held together.
SLICE_BYTES = 8 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their entropy over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Distinct hashes of the n-grams of code points, sorted."""
    if text is None or len(text) < n:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    m = len(points) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : k + m] + np.uint64(1)
    return np.unique(mixed(h))


def gram_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of ``gram_set``, one after the other, and their sizes."""
    raw = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    lengths = np.array([len(r) // 4 for r in raw], np.int64)
    points = np.frombuffer(b"".join(raw), np.uint32).astype(np.uint64)
    m = max(0, len(points) - n + 1)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : k + m] + np.uint64(1)
    h = mixed(h)
    ends = np.cumsum(lengths)
    sets = []
    for first, last in zip(ends - lengths, ends - n + 1, strict=True):
        own = np.sort(h[first : max(first, last)])
        sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array([len(s) for s in sets], np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices, halved until they have few bytes or one row."""
    for b in slices(batches):
        some = [b]
        while some:
            x = some.pop()
            if x.num_rows > 1 and x.nbytes > SLICE_BYTES:
                some += [x.slice(x.num_rows // 2), x.slice(0, x.num_rows // 2)]
            else:
                yield x


def verified(pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(lo, hi, sim) of the rows (lo, hi, t0, t1) whose n-gram sets have a Jaccard similarity strictly above the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            out: tuple[list, list, list] = ([], [], [])
            lo, hi, left, right = (c.to_pylist() for c in b.columns[:4])
            texts = list(dict.fromkeys(left + right))  # one that stands in several pairs of the slice is hashed once
            flat, sizes = gram_sets(texts, n)
            sets = dict(zip(texts, np.split(flat, np.cumsum(sizes)[:-1]), strict=True))
            for i in range(b.num_rows):
                own, other = sets[left[i]], sets[right[i]]
                common = overlap(own, other)
                sim = common / max(1, len(own) + len(other) - common)
                if sim > threshold:
                    for to, v in zip(out, (lo[i], hi[i], sim), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["lo", "hi", "sim"])

    return pairs.select(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "t0", "t1").mapInArrow(run, "lo long, hi long, sim double")


def frequencies(texts: DataFrame, n: int) -> np.ndarray:
    """Texts by token, for tokens of equal first bits together, over all rows (id, text): a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << COUNTER_BITS, np.int64)
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                np.add.at(count, (gram_set(text, n) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count[at], pa.int64())], names=["at", "n"])

    rows = texts.where("text is not null").select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << COUNTER_BITS, np.int64)
    for r in rows:
        out[r["at"]] = r.n
    return out


def prefixes(texts: DataFrame, n: int, threshold: float, orders: int = 1, shared: int = 1) -> DataFrame:
    """(key, id, grams, ord): of each text (id, text) the |x| - ceil(t |x|) + s first of its |x| tokens under each order, s = min(shared, ceil(t |x|)).

    All orders put rare tokens first (by classes of doubled frequency) and differ within a class.  Two sets above the threshold share
    s prefix tokens under every order, with the s of the smaller set.
    """
    level = np.ceil(np.log2(frequencies(texts, n) + 1)).astype(np.uint64)
    given = texts.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = gram_set(text, n)
                if not len(tokens):
                    continue
                least = int(np.ceil(threshold * len(tokens) - 1e-9))
                size = len(tokens) - least + min(shared, max(1, least))
                rare = given.value[(tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)] << np.uint64(58)
                for o in range(orders):
                    place = rare | (mixed(tokens ^ np.uint64(o * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(6))
                    first = tokens if size >= len(tokens) else tokens[np.argpartition(place, size - 1)[:size]]
                    for to, v in zip(cols, (first.view(np.int64), np.full(len(first), i), np.full(len(first), len(tokens), np.int32), np.full(len(first), o, np.int32)), strict=True):
                        to.append(v)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0), t) for c, t in zip(cols, types, strict=True)], names=["key", "id", "grams", "ord"])

    return texts.select(F.col("id").cast("long").alias("id"), "text").where("id is not null and text is not null").mapInArrow(run, "key long, id long, grams int, ord int")


def hot_keys(keyed: DataFrame) -> DataFrame | None:
    """(key, blocks) of keys that many rows share, estimated on one id in PROBE; None if there are none.  At most 100 000 keys."""
    seen = keyed.where(F.pmod(F.xxhash64("id"), F.lit(PROBE)) == 0).groupBy("key").agg(F.count("*").alias("n"))
    rows = seen.where(F.col("n") * PROBE >= HOT).orderBy(F.desc("n")).limit(100_000).collect()
    if not rows:
        return None
    return keyed.sparkSession.createDataFrame([(r.key, -(-r.n * PROBE // BLOCK)) for r in rows], "key long, blocks int")


def pair_up(keyed: DataFrame, threshold: float = 0.0, more: tuple[str, ...] = (), fits: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(lo, hi, least, *more) of rows (key, id, grams, *more) that share a key and whose sizes allow the threshold; repeats where they share several.

    ``fits`` (of the prefixes of both sides' columns) drops pairs where they are formed.

    ``keyed`` is read by both sides, so it should be a table.  Both sides of the join are the same rows, which are shuffled once; rows of
    hot keys alone go in blocks, so that no task has all pairs of such a key.
    """
    t = F.lit(float(threshold))

    def joined(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        a, b = a.alias("a"), b.alias("b")
        both = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*on, *more]])
        fit = (F.col("a.id") < F.col("b.id")) & (F.col("a.grams") >= t * F.col("b.grams")) & (F.col("b.grams") >= t * F.col("a.grams"))
        return both.where(fit if fits is None else fit & fits("a.", "b.")).select(F.col("a.id").alias("lo"), F.col("b.id").alias("hi"), F.least("a.grams", "b.grams").alias("least"), *(F.col(f"a.{c}").alias(c) for c in more))

    hot = hot_keys(keyed)
    if hot is None:
        return joined(keyed, keyed, ["key"])
    calm = keyed.join(F.broadcast(hot.select("key")), "key", "left_anti")
    busy = keyed.join(F.broadcast(hot), "key").withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = busy.withColumnRenamed("own", "p").withColumn("q", every)
    right = busy.withColumnRenamed("own", "q").withColumn("p", every)
    return joined(calm, calm, ["key"]).unionByName(joined(left, right, ["key", "p", "q"]))
