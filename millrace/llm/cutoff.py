"""Score cutoffs that keep a target share of each source.

Scores are coded as integers of ``BITS`` bits that keep their order.  A count tree over the codes holds, for each source, the
number of scores below every dyadic node, as rows (source, depth, node, n).  It is kept in a folder (``ScoreTree``): each batch
appends its node counts and its scored lines under its name, a batch written again under the same name replaces itself, a batch
can be taken out, and the folder is opened again by its path.  The cutoff of a source is found by descending from the root: left
if the left child holds the target rank, else right with the rank less the left child's count.  The leaf that is reached is
refined to its distinct scores by the same descent over the bits of the scores, and equal scores at the cutoff to line ids by
descent over id codes.

No step gathers the rows of a source: leaves are counted map-side, and a tree has at most 2^(BITS + 1) nodes a source.  Lines of
different batches are taken to be different lines.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import shared_dir, table

BITS = 14


def score_code(score: Column, bits: int = BITS, low: float = -4.0, high: float = 28.0) -> Column:
    """Order-keeping code: 0 below 2^low, the last code above 2^high, between them linear in log2."""
    cells = 1 << bits
    return F.least(F.lit(cells - 1), F.greatest(F.lit(0), F.floor((F.log2(score) - low) / (high - low) * cells))).cast("long")


def tree(coded: DataFrame, bits: int = BITS) -> DataFrame:
    """Count tree (source, depth, node, n) of rows (source, code)."""
    leaves = coded.groupBy("source", "code").agg(F.count("*").alias("n"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(bits)))
    return leaves.select("source", "code", "n", levels.alias("depth")).groupBy("source", "depth", F.expr(f"shiftright(code, {bits} - depth)").alias("node")).agg(F.sum("n").alias("n"))


def add(persistent: DataFrame, batch: DataFrame, sign: int = 1) -> DataFrame:
    """Tree with another batch's node counts added (sign 1) or taken out (sign -1)."""
    both = persistent.unionByName(batch.withColumn("n", F.col("n") * sign))
    return both.groupBy("source", "depth", "node").agg(F.sum("n").alias("n")).where("n <> 0")


def descend(counts: DataFrame, ranks: DataFrame, bits: int = BITS) -> DataFrame:
    """(source, leaf, left) for ranks (source, rank): the leaf that holds the rank-th score and the rank within it.

    A rank is 1-based; ranks below 1 or beyond the source's count give no row.
    """

    def run(key, tree_rows: pd.DataFrame, rank_rows: pd.DataFrame) -> pd.DataFrame:
        n = dict(zip(zip(tree_rows.depth, tree_rows.node, strict=True), tree_rows.n, strict=True))
        out = []
        for rank in rank_rows["rank"]:
            if not 1 <= rank <= n.get((0, 0), 0):
                continue
            node, left = 0, int(rank)
            for depth in range(1, bits + 1):
                node *= 2
                below = n.get((depth, node), 0)
                if left > below:
                    node, left = node + 1, left - below
            out.append((key[0], node, left))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pd.DataFrame({"source": pd.Series(columns[0], dtype=object), "leaf": np.array(columns[1], np.int64), "left": np.array(columns[2], np.int64)})

    left = counts.select(F.col("source").alias("own"), "depth", "node", "n")
    right = ranks.select(F.col("source").alias("wanted"), "rank")
    return left.groupBy("own").cogroup(right.groupBy("wanted")).applyInPandas(run, "source string, leaf long, left long")


def clean_source(c: Column) -> Column:
    """Lower case without outer blanks; blank is null."""
    s = F.lower(F.trim(c))
    return F.when(s != "", s)


def latest_scores(scores: DataFrame) -> DataFrame:
    """(line_id, ppl): the latest finite score above 0 of each line.  Equal times: the smaller score; no time: before all others."""
    good = scores.where("line_id is not null and ppl > 0 and ppl < double('infinity') and not isnan(ppl)")
    return good.groupBy("line_id").agg((-F.max(F.struct("scored_at", (-F.col("ppl")).alias("p")))["p"]).alias("ppl"))


def scored_lines(lines: DataFrame, scores: DataFrame) -> DataFrame:
    """(source, line_id, ppl, code) of the lines that have a score and a source."""
    own = lines.select("line_id", clean_source(F.col("source")).alias("source")).where("source is not null and line_id is not null")
    return own.join(latest_scores(scores), "line_id").withColumn("code", score_code(F.col("ppl")))


DIGIT = 13


def ranked_ids(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """(source, cut): the rank-th smallest line_id among a source's rows, by one descent for each digit of 13 bits.

    Ids are moved by the smallest one, so that as few digits are used as their range needs.
    """
    lo, hi = rows.agg(F.min("line_id"), F.max("line_id")).first()
    if lo is None:
        return ranks.select("source", F.lit(None).cast("long").alias("cut")).where("false")
    digits = max(1, -(-(hi - lo).bit_length() // DIGIT))
    # ids as unsigned distances from the smallest: 64 bits are enough for any two longs
    rows = rows.select("source", F.expr(f"shiftright(line_id, 1) - {lo >> 1}L").alias("half"), F.expr(f"(line_id & 1)").alias("odd")) if hi - lo >= 1 << 63 else rows.select("source", F.expr(f"line_id - ({lo}L)").alias("u"))
    if "half" in rows.columns:  # the range needs the sign bit: first the upper 63 bits, then the last
        top = ranked_ids(rows.select("source", F.col("half").alias("line_id"), "odd"), ranks)
        at = rows.join(top.join(ranks, "source"), "source")
        size = at.groupBy("source").agg((F.first("rank") - F.sum((F.col("half") < F.col("cut")).cast("long"))).alias("left"), F.sum(((F.col("half") == F.col("cut")) & (F.col("odd") == 0)).cast("long")).alias("even"), F.first("cut").alias("cut"))
        return size.select("source", F.expr(f"(cut + {lo >> 1}L) * 2 + if(left > even, 1, 0)").alias("cut"))
    found = ranks.select("source", "rank", F.lit(0).cast("long").alias("prefix"))
    for i in reversed(range(digits)):
        here = rows.join(found.select("source", "prefix"), "source").where(F.expr(f"shiftright(u, {DIGIT * (i + 1)})" if DIGIT * (i + 1) < 64 else "0L") == F.col("prefix"))
        counts = tree(here.select("source", F.expr(f"shiftright(u, {DIGIT * i}) & {(1 << DIGIT) - 1}").alias("code")), DIGIT)
        leaf = descend(counts, found.select("source", "rank"), DIGIT)
        found = table(found.drop("rank").join(leaf, "source").select("source", F.col("left").alias("rank"), F.expr(f"shiftleft(prefix, {DIGIT}) | leaf").alias("prefix")), "digits")
    return found.select("source", F.expr(f"prefix + ({lo}L)").alias("cut"))


def double_bits(c: Column) -> Column:
    """The 64 bits of a double as a long."""

    @F.pandas_udf("long")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(v.to_numpy(np.float64).view(np.int64))

    return run(c)


def cutoffs(scored: DataFrame, targets: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(source, n, keep, cut_ppl, cut_line_id): the last kept line of each source by (ppl, line_id).

    Kept are the first floor(n * keep_pct / 100).  A share of 0 or less keeps none, 100 or more all.  Where none is kept both
    cuts are null.  A source without target, or with a null one, has no row.  Of several targets of a source the largest holds.
    """
    goal = targets.where("keep_pct is not null").select(clean_source(F.col("source")).alias("source"), F.greatest(F.lit(0), F.least(F.lit(100), F.col("keep_pct"))).cast("long").alias("pct"))
    goal = goal.where("source is not null").groupBy("source").agg(F.max("pct").alias("pct"))
    counts = tree(scored.select("source", "code")) if counts is None else counts
    size = counts.where("depth = 0").select("source", "n").join(goal, "source").withColumn("keep", F.expr("n * pct div 100"))
    leaf = descend(counts, size.where("keep > 0").select("source", F.col("keep").alias("rank")))
    # refine the leaf to distinct scores: the bits of positive doubles have their order
    inside = table(scored.join(F.broadcast(leaf.withColumnRenamed("leaf", "code")), ["source", "code"]).select("source", double_bits(F.col("ppl")).alias("bits"), "ppl"), "leaf")
    least = inside.groupBy("source").agg(F.min("bits").alias("low"))  # so that the range is a leaf's and few digits are needed
    moved = inside.join(F.broadcast(least), "source").select("source", (F.col("bits") - F.col("low")).alias("line_id"))
    at = ranked_ids(moved, leaf.select("source", F.col("left").alias("rank"))).join(least, "source").select("source", (F.col("cut") + F.col("low")).alias("cut_bits")).join(leaf.select("source", "left"), "source")
    cut = inside.join(F.broadcast(at), "source").groupBy("source").agg(F.max(F.when(F.col("bits") == F.col("cut_bits"), F.col("ppl"))).alias("cut_ppl"), (F.first("left") - F.count_if(F.col("bits") < F.col("cut_bits"))).alias("rank"), F.count_if(F.col("bits") == F.col("cut_bits")).alias("m"))
    return size.join(cut, "source", "left").select("source", "n", "keep", "cut_ppl", "rank", "m")


def with_ties(scored: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cutoffs with cut_line_id: the last kept id among the lines that have exactly the cutoff score."""
    split = cuts.where("rank < m").select("source", "cut_ppl", "rank")
    tied = table(scored.join(split.select("source", F.col("cut_ppl").alias("ppl")), ["source", "ppl"]).select("source", "line_id"), "tied")
    ids = ranked_ids(tied, split.select("source", "rank")).withColumnRenamed("cut", "cut_line_id")
    whole = F.lit((1 << 63) - 1).cast("long")
    return cuts.join(ids, "source", "left").select("source", "n", "keep", "cut_ppl", F.when(F.col("cut_ppl").isNotNull(), F.coalesce("cut_line_id", whole)).alias("cut_line_id"))


def dropped(scored: DataFrame, cuts: DataFrame) -> DataFrame:
    """(source, line_id) of the lines behind the cutoff of their source."""
    behind = F.col("cut_ppl").isNull() | (F.col("ppl") > F.col("cut_ppl")) | ((F.col("ppl") == F.col("cut_ppl")) & (F.col("line_id") > F.col("cut_line_id")))
    return scored.join(cuts, "source").where(behind).select("source", "line_id")


class ScoreTree:
    """A count tree with its scored lines in a folder; ``path`` opens one that is there, or starts one."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/score-tree-{uuid.uuid4().hex}"

    def add(self, scored: DataFrame, batch: str) -> ScoreTree:
        """Node counts and lines of a batch (source, line_id, ppl, code).  The lines are written first: counts are made of what was stored."""
        if not batch or "/" in batch:
            raise ValueError("a batch needs a name without slashes")
        scored.select("source", "line_id", "ppl", "code").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/lines/{batch}")
        lines = self.spark.read.parquet(f"{self.path}/lines/{batch}")
        tree(lines.select("source", "code")).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/nodes/{batch}")
        return self

    def take_out(self, batch: str) -> ScoreTree:
        """The tree without a batch: its lines and counts become empty."""
        none = self.spark.createDataFrame([], "source string, line_id long, ppl double, code long")
        return self.add(none, batch)

    def lines(self) -> DataFrame:
        return self.spark.read.schema("source string, line_id long, ppl double, code long").option("recursiveFileLookup", True).parquet(f"{self.path}/lines")

    def counts(self) -> DataFrame:
        """(source, depth, node, n) summed over the batches."""
        nodes = self.spark.read.schema("source string, depth int, node long, n long").option("recursiveFileLookup", True).parquet(f"{self.path}/nodes")
        return add(nodes, nodes.where("false"))


class Cutoffs:
    """Cutoffs of a stored tree: ``scored`` are its lines, ``cuts`` has one row a source.

    Lines without source, id or valid score are in none of them; empty tables give empty results.
    """

    def __init__(self, stored: ScoreTree, targets: DataFrame):
        self.scored = stored.lines()
        self.tree = table(stored.counts(), "count-tree")
        self.cuts = table(with_ties(self.scored, table(cutoffs(self.scored, targets, self.tree), "cuts")), "cutoffs")

    @classmethod
    def of(cls, lines: DataFrame, scores: DataFrame, targets: DataFrame) -> Cutoffs:
        """Cutoffs of lines that come as one batch."""
        return cls(ScoreTree(lines.sparkSession).add(scored_lines(lines, scores), "all"), targets)

    def dropped(self) -> DataFrame:
        return dropped(self.scored, self.cuts)
