"""Near-duplicate records: pairs of texts whose sets of distinct character n-grams have a Jaccard similarity above a threshold.

Candidates come from multiple-global-order filtering.  A hash function puts all n-grams into one global order; two sets
of similarity J have the same first n-gram under a random order with probability J.  ``ORDERS`` such orders are used in
groups of ``DEPTH``: a candidate must share its prefix token under *every* order of some group, so the filters of a group
are intersected by a single equi-join on the group's key, and no pair is formed for a token that is merely frequent.
Each candidate is then held against a bit sketch of all orders, and verified on the whole n-gram sets.

A prefix is one token here, not the 0.2 |x| tokens of the lossless filter: that needs hundreds of index rows a text.  A
pair at the threshold 0.8 itself is missed with probability (1 - 0.8^6)^32 = 6e-5, at 0.85 with 6e-8, and by the sketch with
less than 1e-7.  ``exact=True`` loses none: whole prefixes under ``EXACT_ORDERS`` orders, all of them rare tokens first (token
frequencies are counted over all texts in a table of fixed size) but otherwise different; a candidate must share
``EXACT_SHARED`` prefix tokens under each order, and no sketch is held against it.

An order over a large set is a range partition of another order: with ``bins`` bins, the first token of each bin of one hash
stands for ``bins`` orders, each over its own share of the n-grams.  Small sets use few bins and many hashes, so that a bin
has about eight n-grams; a text near the edge of a size class also appears in the next smaller class.

Keys that many texts share (found on a sample of the texts, which decides about the plan only) are joined in blocks.

``classes`` doesn't need the links: in each key's bucket every text is first verified against the smallest id alone, and only
texts of buckets that then still hold several classes are paired, across classes.  So a template of many texts costs as many
verifications as it has texts, though all its pairs are links.

Nulls and texts shorter than n characters have no n-grams and take part in no pair.  Equal texts are collapsed before
pairing and, where pairs of records are wanted, expanded at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks, code_points, mix64, windows
from ..operators.grams import pair_up, prefixes
from ..store import table

DEPTH = 6
GROUPS = 32
ORDERS = DEPTH * GROUPS
#: Size classes: (least number of distinct n-grams, bins, hashes); bins * hashes = ORDERS.
CLASSES = [(0, 3, 64), (48, 6, 32), (96, 12, 16), (192, 24, 8), (384, 48, 4), (768, 96, 2), (1536, 192, 1)]
_FLOORS = np.array([c[0] for c in CLASSES])
#: Sketch bits that may differ: at similarity s, (1 - s) / 2 of ORDERS differ on average; six deviations are granted.
SIGMAS = 6.0
#: Orders of the exact mode, and prefix tokens that must be shared under each.
EXACT_ORDERS, EXACT_SHARED = 2, 8


def sketch_limit(threshold: float) -> int:
    p = (1 - threshold) / 2
    return int(ORDERS * p + SIGMAS * math.sqrt(ORDERS * p * (1 - p))) + 1


def size_classes(n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Own class and the class of the smallest set that can be similar."""
    own = np.searchsorted(_FLOORS, n, side="right") - 1
    low = np.searchsorted(_FLOORS, np.floor(n * threshold), side="right") - 1
    return own, low


def first_tokens(tokens: np.ndarray, doc: np.ndarray, docs: int, klass: int) -> np.ndarray:
    """(docs, ORDERS) array: the first token of each document under each order of a class."""
    _, bins, hashes = CLASSES[klass]
    out = np.full((docs, ORDERS), np.uint64(0xFFFFFFFFFFFFFFFF))
    flat = out.reshape(-1)
    base = doc * ORDERS
    for k in range(hashes):
        h = mix64(tokens ^ np.uint64((k + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        at = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(flat, base + (at + k * bins), h)
    return out


def signatures(texts: list[str | None], n: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk: positions, set sizes, classes, group keys (rows x GROUPS) and sketches (rows x 3) of the texts."""
    for at, own in chunks(texts):
        flat = code_points("".join(own))
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        h, doc, _ = windows(flat, lengths, n)
        if not len(h):
            continue
        # distinct n-grams of each document: 48 hash bits beside the document's number (a chunk has under 2^16 documents)
        for lo in range(0, len(own), 1 << 16):
            sel = slice(*np.searchsorted(doc, [lo, lo + (1 << 16)]))
            key = np.sort((h[sel] >> np.uint64(16)) | ((doc[sel] - lo).astype(np.uint64) << np.uint64(48)))
            if not len(key):
                continue
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            d = (key >> np.uint64(48)).astype(np.int64)
            count = np.bincount(d, minlength=min(len(own) - lo, 1 << 16))
            mine, low = size_classes(count, threshold)
            tokens = key & np.uint64((1 << 48) - 1)
            for klass in range(len(CLASSES)):
                chosen = (count > 0) & ((mine == klass) | (low == klass))
                if not chosen.any():
                    continue
                new = np.cumsum(chosen) - 1
                keep = chosen[d]
                first = first_tokens(tokens[keep], new[d[keep]], int(chosen.sum()), klass)
                rows = np.flatnonzero(chosen)
                mixed = mix64(first)
                bits = np.packbits((mixed >> np.uint64(63)).astype(np.uint8), axis=1).view(np.int64)
                keys = np.zeros((len(rows), GROUPS), np.uint64)
                for j in range(DEPTH):
                    keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + mixed[:, j * GROUPS : (j + 1) * GROUPS] + np.uint64(j + 1))
                keys = mix64(keys + (np.arange(GROUPS, dtype=np.uint64) + np.uint64(GROUPS * klass + 1)) * np.uint64(0xD6E8FEB86659FD93))
                yield np.asarray(at)[rows + lo], count[rows], np.full(len(rows), klass), keys.view(np.int64), bits


SIGNED = "id long, twin binary, grams int, klass int, keys array<bigint>, s0 long, s1 long, s2 long"


def signed(records: DataFrame, n: int, threshold: float) -> DataFrame:
    """Signature rows of ``records`` (id, text); one or two rows for each text of at least n characters."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, SLICE):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            texts = b.column(1).to_pylist()
            for at, grams, klass, keys, bits in signatures(texts, n, threshold):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at], pa.int64()),
                        pa.array([hashlib.md5(texts[i].encode("utf-8", "surrogatepass")).digest() for i in at], pa.binary()),
                        pa.array(grams, pa.int32()),
                        pa.array(klass, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, GROUPS), pa.int32()), pa.array(np.ascontiguousarray(keys).reshape(-1), pa.int64())),
                        *(pa.array(np.ascontiguousarray(bits[:, i]), pa.int64()) for i in range(3)),
                    ],
                    names=["id", "twin", "grams", "klass", "keys", "s0", "s1", "s2"],
                )

    return records.select("id", "text").where("id is not null and text is not null").mapInArrow(run, SIGNED)


#: Texts of a batch that are worked on at a time.
SLICE = 1000


def parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of at most so many rows, so that a worker's arrays stay small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def gram_set(text: str, n: int) -> np.ndarray:
    h, _, _ = windows(code_points(text), np.array([len(text)]), n)
    return np.unique(h)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def verify(pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """Exact similarity of (lo, hi, text_lo, text_hi), strictly above the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, SLICE // 4):
            lo, hi = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            left, right = b.column(2), b.column(3)
            out: tuple[list, list, list] = ([], [], [])
            seen, own = None, None
            for i in range(b.num_rows):
                if lo[i] != seen:
                    seen, own = lo[i], gram_set(left[i].as_py(), n)
                other = gram_set(right[i].as_py(), n)
                common = overlap(own, other)
                sim = common / max(1, len(own) + len(other) - common)
                if sim > threshold:
                    for to, v in zip(out, (lo[i], hi[i], sim), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["lo", "hi", "sim"])

    return pairs.select("lo", "hi", "text_lo", "text_hi").mapInArrow(run, "lo long, hi long, sim double")


class NearDuplicates:
    """Links of one table of records (id, text).

    ``links``: (lo, hi, sim) between representatives of different texts; ``members``: (id, rep, copies) of every record that has
    n-grams; the representative of equal texts is the smallest id.  ``exact`` loses no link, at the cost of whole prefixes.
    """

    def __init__(self, records: DataFrame, n: int = 5, threshold: float = 0.8, exact: bool = False):
        if not 0 < threshold < 1:
            raise ValueError("threshold must lie between 0 and 1")
        if n < 1:
            raise ValueError("n must be at least 1")
        self.records, self.n, self.threshold, self.exact = records, n, threshold, exact
        self.base = table(signed(records, n, threshold), "signatures")
        ids = self.base.select("id", "twin").distinct()
        reps = ids.groupBy("twin").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        self.members = ids.join(reps, "twin").select("id", "rep", "copies")
        self.spare = reps.where("copies > 1").join(ids, "twin").where("id <> rep").select("id")
        self.own = self.base.join(self.spare, "id", "left_anti")
        self._found: DataFrame | None = None

    @property
    def links(self) -> DataFrame:
        if self._found is None:
            self._found = table(self._verified(self.candidates()), "links")
        return self._found

    def _texts(self) -> DataFrame:
        return self.records.where("id is not null and text is not null").select("id", "text")

    def _keyed(self) -> DataFrame:
        return self.own.select(F.explode("keys").alias("key"), "id", "grams")

    def candidates(self) -> DataFrame:
        """(lo, hi) of all candidates, before they are verified."""
        if self.exact:
            keyed = table(prefixes(self._texts().join(self.spare, "id", "left_anti"), self.n, self.threshold, EXACT_ORDERS, EXACT_SHARED), "prefixes")
            shared = pair_up(keyed, self.threshold, ("ord",)).groupBy("lo", "hi", "ord").agg(F.count("*").alias("k"), F.min("least").alias("least"))
            need = F.least(F.lit(EXACT_SHARED), F.greatest(F.lit(1), F.ceil(F.lit(self.threshold) * F.col("least") - 1e-9)))
            return shared.where(F.col("k") >= need).groupBy("lo", "hi").agg(F.count("*").alias("k")).where(f"k = {EXACT_ORDERS}").select("lo", "hi")
        return self._sketched(pair_up(self._keyed(), self.threshold))

    def _sketched(self, pairs: DataFrame) -> DataFrame:
        """Pairs (lo, hi, least) whose sketches of the smaller set's class are near enough."""
        # the class follows from the smaller set
        klass = sum((F.when(F.col("least") >= c[0], 1).otherwise(0) for c in CLASSES[1:]), F.lit(0))
        c = pairs.select(klass.alias("klass"), "lo", "hi").distinct()
        sketch = self.own.select("id", "klass", "s0", "s1", "s2")
        for side in ("lo", "hi"):
            c = c.join(sketch.select("klass", F.col("id").alias(side), *(F.col(s).alias(f"{s}_{side}") for s in ("s0", "s1", "s2"))), ["klass", side])
        differ = sum((F.expr(f"bit_count(s{i}_lo ^ s{i}_hi)") for i in range(3)), F.lit(0))
        return c.where(differ <= sketch_limit(self.threshold)).select("lo", "hi").distinct()

    def _verified(self, candidates: DataFrame) -> DataFrame:
        c = table(candidates, "candidates")
        wanted = c.select(F.explode(F.array("lo", "hi")).alias("id")).distinct()
        texts = self._texts().join(wanted, "id", "left_semi")
        both = c.join(texts.select(F.col("id").alias("hi"), F.col("text").alias("text_hi")), "hi").join(texts.select(F.col("id").alias("lo"), F.col("text").alias("text_lo")), "lo")
        return verify(both, self.n, self.threshold)

    def pairs(self) -> DataFrame:
        """Every pair of records (id_lo, id_hi): links expanded by the copies of both ends, and the copies themselves."""
        m = self.members
        twins = m.where("copies > 1").select("rep", "id")
        same = twins.join(twins.select("rep", F.col("id").alias("other")), "rep").where("id < other").select(F.col("id").alias("id_lo"), F.col("other").alias("id_hi"))
        ends = self.members.select("id", "rep")
        wide = (
            self.links.join(ends.select(F.col("rep").alias("lo"), F.col("id").alias("a")), "lo")
            .join(ends.select(F.col("rep").alias("hi"), F.col("id").alias("b")), "hi")
            .select(F.least("a", "b").alias("id_lo"), F.greatest("a", "b").alias("id_hi"))
        )
        return same.unionByName(wide)

    def _joined(self) -> DataFrame:
        """(lo, hi): verified links enough to connect what all links connect."""
        if self.exact:
            return self.links
        keyed = self._keyed()
        first = keyed.groupBy("key").agg(F.min(F.struct("id", "grams")).alias("f"), F.count("*").alias("m")).where("m > 1").select("key", F.col("f.id").alias("lo"), F.col("f.grams").alias("g"))
        t = F.lit(self.threshold)
        star = keyed.join(first, "key").where((F.col("id") > F.col("lo")) & (F.col("grams") > t * F.col("g")) & (F.col("g") > t * F.col("grams")))
        near = table(self._verified(self._sketched(star.select("lo", F.col("id").alias("hi"), F.least("grams", "g").alias("least")))), "stars").select("lo", "hi")
        root = components(both_ways(near))
        classed = keyed.join(root, F.col("id") == F.col("rep"), "left").select("key", "id", "grams", F.coalesce("root", "id").alias("klass_id"))
        # buckets that still hold several classes: pairs of classes first, then their texts
        mixed = classed.groupBy("key").agg(F.min("klass_id").alias("a"), F.max("klass_id").alias("b")).where("a <> b").select("key")
        rest = table(classed.join(mixed, "key", "left_semi"), "mixed")
        kinds = rest.select("key", "klass_id").distinct()
        pairs = kinds.select("key", F.col("klass_id").alias("x")).join(kinds.select("key", F.col("klass_id").alias("y")), "key").where("x < y")
        side = lambda k, i, g: rest.select("key", F.col("klass_id").alias(k), F.col("id").alias(i), F.col("grams").alias(g))
        both = pairs.join(side("x", "i", "g"), ["key", "x"]).join(side("y", "j", "h"), ["key", "y"]).where((F.col("g") > t * F.col("h")) & (F.col("h") > t * F.col("g")))
        across = self._verified(self._sketched(both.select(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.least("g", "h").alias("least"))))
        return near.unionByName(across.select("lo", "hi"))

    def classes(self) -> DataFrame:
        """One row for each record: (id, class_id, copies).  A class is a connected group, its id the smallest record id;
        ``copies`` counts the records of the very same text."""
        root = components(both_ways(self._joined()))
        return self.members.join(root, "rep", "left").select("id", F.coalesce("root", "rep").alias("class_id"), "copies")


def both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("lo").alias("rep"), F.col("hi").alias("other")).unionByName(links.select(F.col("hi").alias("rep"), F.col("lo").alias("other")))


def components(both: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of an undirected graph given with both directions (rep, other): (rep, root).

    Labels fall to the smallest neighbour's label and jump to their label's label, so rounds grow with the logarithm of a
    component's diameter.  Every round is a table in the shared folder; only the number of changed labels reaches the driver.
    """
    edges = table(both, "edges")
    label = table(edges.groupBy("rep").agg(F.min("other").alias("m")).select("rep", F.least("rep", "m").alias("root")), "labels")
    for _ in range(max_rounds):
        near = edges.join(label.select(F.col("rep").alias("other"), F.col("root").alias("r")), "other").groupBy("rep").agg(F.min("r").alias("r"))
        low = label.join(near, "rep").select("rep", F.col("root").alias("was"), F.least("root", "r").alias("low"))
        jump = label.select(F.col("rep").alias("low"), F.col("root").alias("up"))
        new = table(low.join(jump, "low", "left").select("rep", "was", F.least("low", F.coalesce("up", "low")).alias("root")), "labels")
        changed = new.where("root <> was").count()
        label = new.select("rep", "root")
        if not changed:
            return label
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
