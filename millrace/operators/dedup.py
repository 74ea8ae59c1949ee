"""Fuzzy deduplication: candidates by MinHash bands or by an exact filter, verified similarity, removal.

The bands are the way at scale and the default; a pair at similarity s is found with probability 1 - (1 - s^rows)^bands, and
dropped before verification (``sketch``) with less than 1e-7.  The exact filter (``bitmaps``) loses none, needs little space and compares each
text with all of similar size and kind.  The prefix filter loses none either, and takes a fifth of all shingles as rows, and all pairs that share one.
Candidates are written once; texts, not their shingles, are moved to verify them.

Null texts, and texts shorter than n, have no shingles and are never duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps, grams
from ..functions.text import shingles
from ..store import drop, table

PRIME = (1 << 31) - 1
#: Prefix shingles that candidates of the exact filter must share.
SHARED = 8


def coefficients(seeds: int, seed: int = 0) -> list[tuple[int, int]]:
    """Factors of the hash family h -> (a h + b) mod 2^31 - 1; 0 < a < 2^31 - 1."""
    x, out = (seed * 2654435761 + 88172645463325252) % (1 << 64) or 1, []
    for _ in range(seeds):
        pair = []
        for _ in range(2):
            x ^= (x << 13) % (1 << 64)
            x ^= x >> 7
            x ^= (x << 17) % (1 << 64)
            pair.append(x % (PRIME - 1) + 1)
        out.append((pair[0], pair[1]))
    return out


def shingle_rows(docs: DataFrame, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, g): one row for each distinct shingle of each document."""
    return docs.select(F.col(id_col).alias("id"), F.explode(shingles(F.col(text_col), n)).alias("g"))


def minhash(docs: DataFrame, seeds: int = 100, n: int = 5, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", method: str = "arrow") -> DataFrame:
    """(id, fp): ``seeds`` minima over the shingles of each document that has any.

    ``arrow`` hashes slices of batches with numpy and moves nothing, by multiplication and shift; ``sql`` takes the first 7 hex digits of the MD5 of a shingle and
    minima in an aggregation, which other engines can repeat, but is slow for many seeds.
    """
    if method == "arrow":
        return _minhash_arrow(docs, seeds, n, seed, id_col, text_col)
    if method != "sql":
        raise ValueError("method must be arrow or sql")
    h = F.conv(F.substring(F.md5("g"), 1, 7), 16, 10).cast("long")
    rows = shingle_rows(docs, n, id_col, text_col).select("id", h.alias("h"))
    mins = [F.min((F.lit(a) * F.col("h") + F.lit(b)) % F.lit(PRIME)).alias(f"m{i}") for i, (a, b) in enumerate(coefficients(seeds, seed))]
    return rows.groupBy("id").agg(*mins).select("id", F.array(*(f"m{i}" for i in range(seeds))).alias("fp"))


def _minhash_arrow(docs: DataFrame, seeds: int, n: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    family = coefficients(seeds, seed)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        # h -> the upper 31 bits of a h + b modulo 2^64, a odd: a multiplication and an addition, no remainder
        factor = np.array([a << 33 | b << 2 | 1 for a, b in family], np.uint64)[:, None]
        shift = np.array([b << 33 | a for a, b in family], np.uint64)[:, None]
        for b in grams.slices(batches):
            ids, rows = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = grams.gram_set(text, n)
                if not len(h):
                    continue
                least = np.full(seeds, np.uint64(0xFFFFFFFFFFFFFFFF))
                for at in range(0, len(h), 2048):  # bounded memory for very long texts
                    part = factor * h[None, at : at + 2048]
                    part += shift
                    np.minimum(least, part.min(1), out=least)
                ids.append(i)
                rows.append((least >> np.uint64(33)).astype(np.int64))
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            fps = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, seeds), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), fps], names=["id", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return own.mapInArrow(run, "id long, fp array<bigint>")


def lsh_bands(fingerprints: DataFrame, bands: int = 20, seeds: int | None = None) -> DataFrame:
    """(id, band, bucket) of fingerprints; the number of seeds must be a multiple of the number of bands."""
    if seeds is None:
        first = fingerprints.select(F.size("fp")).first()
        seeds = first[0] if first else bands
    if bands < 1 or seeds % bands:
        raise ValueError("seeds must be a multiple of bands")
    rows = seeds // bands
    parts = F.array(*(F.struct(F.lit(b).alias("band"), F.xxhash64(F.slice("fp", b * rows + 1, rows)).alias("bucket")) for b in range(bands)))
    return fingerprints.select("id", F.explode(parts).alias("p")).select("id", "p.band", "p.bucket")


def lsh_candidates(bands: DataFrame) -> DataFrame:
    """(lo, hi): distinct pairs that share a bucket; buckets of many texts go in blocks.  Equal texts should be collapsed before.

    A row has the smaller keys of its text along, so that a pair comes out at the smallest key it shares and no pairs have to be moved.
    """
    own = bands.select("id", F.xxhash64("band", "bucket").alias("key")).groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    keyed = own.select("id", "keys", F.posexplode("keys").alias("at", "key")).select("key", "id", F.lit(1).alias("grams"), F.slice("keys", F.lit(1), F.col("at")).alias("prior"))
    return grams.pair_up(table(keyed, "keyed"), fits=lambda a, b: ~F.arrays_overlap(f"{a}prior", f"{b}prior")).select("lo", "hi")


def sketches(fingerprints: DataFrame, seeds: int) -> DataFrame:
    """(id, fp, w0, ...): the lowest four bits of each minimum beside the fingerprint, 15 of them in a long."""
    starts = range(0, seeds, 15)
    return fingerprints.select("id", "fp", *(F.aggregate(F.slice("fp", at + 1, 15), F.lit(0).cast("long"), lambda t, x: t * 16 + x.bitwiseAND(F.lit(15))).alias(f"w{at}") for at in starts))


def likely(threshold: float, seeds: int, sigmas: float = 6.0):
    """Whether the sketches of two rows agree in as many places as those of a pair at the threshold do, less six deviations.

    Equal minima always agree in four bits, so that no more pairs are lost than by whole minima.
    """
    least = seeds * threshold - sigmas * (seeds * threshold * (1 - threshold)) ** 0.5

    def fits(left: str, right: str):
        def unequal(at: int):
            x = F.col(f"{left}w{at}").bitwiseXOR(F.col(f"{right}w{at}"))
            any_bit = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
            return F.bit_count(any_bit.bitwiseAND(F.lit(int("1" * 15, 16))))

        return F.lit(seeds) - sum(map(unequal, range(0, seeds, 15)), F.lit(0)) >= F.lit(float(least))

    return fits


def _banded(fingerprints: DataFrame, bands: int, seeds: int, threshold: float, sketched: bool) -> DataFrame:
    """Candidates of fingerprints; their sketches go along with the rows of the bands, so that no pair has to meet them again."""
    rows = seeds // bands
    if bands < 1 or seeds % bands:
        raise ValueError("seeds must be a multiple of bands")
    if not sketched:
        return lsh_candidates(lsh_bands(fingerprints, bands, seeds))
    keys = F.array(*(F.xxhash64(F.lit(b), F.slice("fp", b * rows + 1, rows)) for b in range(bands)))
    own = table(sketches(fingerprints, seeds).select("id", *(f"w{at}" for at in range(0, seeds, 15)), keys.alias("keys")), "banded")
    keyed = own.select(F.explode("keys").alias("key"), "id", F.lit(1).alias("grams"), *(f"w{at}" for at in range(0, seeds, 15)))
    return grams.pair_up(keyed, fits=likely(threshold, seeds)).select("lo", "hi").distinct()


def prefix_candidates(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(lo, hi): a superset of all pairs above the threshold, without loss.

    Shingles are ordered by rising document frequency, hash last; two sets above the threshold share ``SHARED`` of the first
    k - ceil(threshold * k) + SHARED of their k shingles, and their sizes differ by the threshold at most.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pairs = grams.pair_up(table(grams.prefixes(texts, n, threshold, shared=SHARED), "prefixes"), threshold).groupBy("lo", "hi").agg(F.count("*").alias("k"), F.min("least").alias("least"))
    need = F.least(F.lit(SHARED), F.greatest(F.lit(1), F.ceil(F.lit(float(threshold)) * F.col("least") - 1e-9)))
    return pairs.where(F.col("k") >= need).select("lo", "hi")


def both_orders(pairs: DataFrame) -> DataFrame:
    """Every pair twice, as (lo, hi) and as (hi, lo)."""
    ends = F.array(F.struct("lo", "hi"), F.struct(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
    rest = [c for c in pairs.columns if c not in ("lo", "hi")]
    return pairs.select(F.explode(ends).alias("_p"), *rest).select("_p.lo", "_p.hi", *rest)  # the pairs are found once


def verify_pairs(pairs: DataFrame, docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(lo, hi, sim) of the pairs whose similarity is strictly above the threshold.

    Texts are moved rather than their shingles, which take many times the space.
    """
    pairs = table(pairs.select("lo", "hi"), "candidates")
    wanted = pairs.select(F.explode(F.array("lo", "hi")).alias("_id")).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(wanted, "_id", "left_semi")
    both = pairs.join(texts.select(F.col("_id").alias("hi"), F.col("_t").alias("t1")), "hi").join(texts.select(F.col("_id").alias("lo"), F.col("_t").alias("t0")), "lo")
    return grams.verified(both, n, threshold)


def candidate_pairs(docs: DataFrame, method: str = "lsh", threshold: float = 0.8, n: int = 5, seeds: int = 100, bands: int = 20, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", sketch: bool = True) -> DataFrame:
    """Candidates by ``lsh`` (recall by seeds and bands), ``exact`` (none lost) or ``prefix`` (none lost; for texts whose rare shingles are in few others).  ``sketch`` drops pairs whose fingerprints agree too little."""
    if method == "lsh":
        # both sides of the pairing read the fingerprints, so they are kept
        return _banded(table(minhash(docs, seeds, n, seed, id_col, text_col), "fingerprints"), bands, seeds, threshold, sketch)
    if method == "exact":
        return bitmaps.close_pairs(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), n, threshold)
    if method == "prefix":
        return prefix_candidates(docs, threshold, n, id_col, text_col)
    raise ValueError("method must be lsh, exact or prefix")


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with different texts, each under its largest id, and (id, rep) of all others."""
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("_t is not null").select("_id", F.md5("_t").alias("_m"), F.length("_t").alias("_n"))
    last = keyed.groupBy("_m").agg(F.max("_id").alias("rep"), F.count("*").alias("copies"))
    spare = keyed.join(last.where("copies > 1"), "_m").where("_id <> rep").select(F.col("_id").alias("id"), "rep", F.col("_n").alias("chars"))
    return docs.join(spare.select(F.col("id").alias(id_col)), id_col, "left_anti"), spare


def removed_ids(pairs: DataFrame, keep: str = "last") -> DataFrame:
    """Ids removed by going through the pairs in rising order and removing one end wherever both are still there.

    With (lo, hi) in order that is every lo that has a pair at all (``last``), or every hi (``first``).
    """
    if keep not in ("last", "first"):
        raise ValueError("keep must be last or first")
    return pairs.select(F.col("lo" if keep == "last" else "hi").alias("id")).distinct()


def duplicates(docs: DataFrame, method: str = "lsh", threshold: float = 0.8, n: int = 5, seeds: int = 100, bands: int = 20, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", sketch: bool = True) -> DataFrame:
    """(lo, hi, sim) between different texts, each text under its largest id; a table, which all that follows reads."""
    own, _ = collapsed(docs, id_col, text_col)
    return table(verify_pairs(candidate_pairs(own, method, threshold, n, seeds, bands, seed, id_col, text_col, sketch), own, threshold, n, id_col, text_col), "links")


def deduplicate(docs: DataFrame, pairs: DataFrame | None = None, n: int = 5, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """Kept and removed documents: of equal texts the largest id stays, of links between texts the larger end."""
    pairs = duplicates(docs, n=n, id_col=id_col, text_col=text_col, **options) if pairs is None else pairs
    _, spare = collapsed(docs, id_col, text_col)
    gone = removed_ids(pairs).unionByName(spare.where(F.col("chars") >= n).select("id")).distinct().select(F.col("id").alias(id_col))
    return docs.join(gone, id_col, "left_anti"), docs.join(gone, id_col, "left_semi")


def kept_ratio(total: DataFrame, kept: DataFrame) -> DataFrame:
    """(total, kept, ratio, ratio_compat); the last divides by one more."""
    marks = total.select(F.lit(0).alias("k")).unionAll(kept.select(F.lit(1).alias("k")))
    counts = marks.agg(F.count_if(F.col("k") == 0).alias("total"), F.count_if(F.col("k") == 1).alias("kept"))
    return counts.select("total", "kept", F.try_divide("kept", "total").alias("ratio"), (F.col("kept") / (F.col("total") + 1)).alias("ratio_compat"))


def components(pairs: DataFrame, max_rounds: int = 30) -> DataFrame:
    """(id, root) of every id in a pair: the smallest id of its connected group."""
    both = table(both_orders(pairs.select("lo", "hi")).distinct(), "edges")
    label = both.groupBy("lo").agg(F.least(F.min("hi"), F.first("lo")).alias("root")).select(F.col("lo").alias("id"), "root")
    last = None
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("id").alias("hi"), F.col("root").alias("r")), "hi").groupBy("lo").agg(F.min("r").alias("r"))
        low = label.join(near, label["id"] == near["lo"]).select("id", F.col("root").alias("was"), F.least("root", "r").alias("low"))
        up = label.select(F.col("id").alias("low"), F.col("root").alias("up"))
        new = table(low.join(up, "low", "left").select("id", "was", F.least("low", F.coalesce("up", "low")).alias("root")), "labels")
        label = new.select("id", "root")
        settled = not new.where("root <> was").limit(1).count()
        if last is not None:
            drop(last)
        if settled:
            return label
        last = new
    raise RuntimeError("components did not settle")
