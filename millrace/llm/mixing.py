"""Mixing sources to target weights of the mixture's tokens.

Leaves of a tree (domain, source, language) hold documents.  The total budget runs down the tree in proportion to weights; a
child takes no more than its documents times the repeats allowed.  What a child can't take goes to its siblings by their
weights, and only what all of them can't take to the siblings of an ancestor.  The source is the unit that has a weight; a
source's languages share it as its tokens do.

A leaf's budget is filled from seeded epochs: whole epochs use every document once, the last one the documents of a prefix of
a seeded order whose tokens fit.  A document's uses never exceed its source's repeats.

Documents of sources without a weight, without a source, and with null texts have no part.  Documents without tokens are used
in whole epochs only as the others are.  Weights need not sum to 1.  Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cutoff import clean_source
from ..store import table

BUCKETS = 4096


@dataclass
class Node:
    weight: float = 0.0
    room: int = 0
    children: dict[str, Node] = field(default_factory=dict)
    budget: int = 0


def water_fill(budget: int, weights: list[float], rooms: list[int]) -> list[int]:
    """Shares of a budget in proportion to weights, none above its room; what is cut off goes to the others by weight.

    Whole tokens: shares are rounded down and the rest goes one each to the largest remainders that still have room.
    """
    share = [0.0] * len(rooms)
    open_ = {i for i, (w, r) in enumerate(zip(weights, rooms, strict=True)) if w > 0 and r > 0}
    left = float(min(budget, sum(rooms[i] for i in open_)))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= rooms[i] - share[i]]
        if not full:
            for i in open_:
                share[i] += left * weights[i] / total
            break
        for i in full:
            left -= rooms[i] - share[i]
            share[i] = float(rooms[i])
            open_.discard(i)
    out = [min(r, int(s + 1e-9)) for s, r in zip(share, rooms, strict=True)]
    rest = min(budget, sum(r for w, r in zip(weights, rooms, strict=True) if w > 0)) - sum(out)
    for i in sorted(range(len(out)), key=lambda i: (out[i] - share[i], i)):
        if rest <= 0:
            break
        if weights[i] > 0 and out[i] < rooms[i]:
            out[i] += 1
            rest -= 1
    return out


def allocate(node: Node, budget: int) -> None:
    """Run a budget down the tree."""
    node.budget = budget
    names = sorted(node.children)
    shares = water_fill(budget, [node.children[n].weight for n in names], [node.children[n].room for n in names])
    for n, s in zip(names, shares, strict=True):
        allocate(node.children[n], s)


def build(leaves: list[tuple[tuple[str, ...], float, int]]) -> Node:
    """Tree of leaves (path, weight, room)."""
    root = Node()
    for path, weight, room in leaves:
        node = root
        node.weight += weight
        node.room += room
        for name in path:
            node = node.children.setdefault(name, Node())
            node.weight += weight
            node.room += room
    return root


def leaf_budgets(leaves: list[tuple[tuple[str, ...], float, int]], budget: int) -> dict[tuple[str, ...], int]:
    root = build(leaves)
    allocate(root, min(budget, sum(r for _, w, r in leaves if w > 0)))
    out = {}
    for path, _, _ in leaves:
        node = root
        for name in path:
            node = node.children[name]
        out[path] = node.budget
    return out


def domain_of(source: str, domains: dict[str, str]) -> str:
    """The domain whose members (in one string, with blanks between) include the source; a source that no domain names is one of its own."""
    return next((name for name, members in domains.items() if source in members.split()), source)


class Mixture:
    """Mixture of documents (id, tokens, source, lang) to targets (source, weight, max_repeats).

    ``budget``: tokens of the mixture; by default those of all documents whose source has a weight.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, domains: dict[str, str], budget: int | None = None, seed: int = 0):
        spark = docs.sparkSession
        goal = targets.select(clean_source(F.col("source")).alias("source"), "weight", "max_repeats").where("source is not null and weight > 0 and max_repeats > 0")
        goal = goal.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
        own = docs.select("id", "tokens", clean_source(F.col("source")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang")).where("source is not null")
        self.docs = own.join(goal.select("source"), "source", "left_semi")
        # at most one row for each target and language
        sizes = self.docs.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()
        self.targets = {r.source: (r.weight, r.max_repeats) for r in goal.collect()}
        total: dict[str, int] = {}
        for r in sizes:
            total[r.source] = total.get(r.source, 0) + r.tokens
        leaves = [((domain_of(r.source, domains), r.source, r.lang), self.targets[r.source][0] * r.tokens / total[r.source], r.tokens * self.targets[r.source][1]) for r in sizes if r.tokens > 0]
        self.budget = sum(total.values()) if budget is None else budget
        budgets = leaf_budgets(leaves, self.budget) if leaves else {}
        tokens = {(r.source, r.lang): r.tokens for r in sizes}
        rows = [(s, x, b, *divmod(b, tokens[s, x])) for (_, s, x), b in sorted(budgets.items())]
        self.leaves = spark.createDataFrame(rows, "source string, lang string, leaf_budget long, epochs long, rest long")
        self.seed = seed

    def uses(self) -> DataFrame:
        """(id, source, lang, tokens, uses) of the documents that are used."""
        rows = self.docs.join(F.broadcast(self.leaves), ["source", "lang"])
        rows = rows.withColumn("key", F.xxhash64("id", "epochs", F.lit(self.seed))).withColumn("bucket", F.expr(f"shiftrightunsigned(key, {64 - BUCKETS.bit_length() + 1})"))
        sums = rows.groupBy("source", "lang", "bucket", "rest").agg(F.sum("tokens").alias("t"))  # at most BUCKETS a leaf
        upto = F.sum("t").over(Window.partitionBy("source", "lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        # the first bucket that doesn't fit whole
        edge = sums.withColumn("upto", upto).where("upto > rest").groupBy("source", "lang").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("t")).alias("before"))).alias("e"))
        rows = rows.join(F.broadcast(edge.select("source", "lang", F.col("e.bucket").alias("edge"), F.col("e.before").alias("before"))), ["source", "lang"], "left")
        inside = rows.where("edge is null or bucket < edge").select("id", F.lit(1).alias("more"))
        order = Window.partitionBy("source", "lang").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
        last = rows.where("bucket = edge").withColumn("upto", F.col("before") + F.sum("tokens").over(order)).where("upto <= rest").select("id", F.lit(1).alias("more"))
        more = inside.where("more = 1").unionByName(last)
        return rows.join(more, "id", "left").select("id", "source", "lang", "tokens", (F.col("epochs") + F.when(F.col("rest") > 0, F.coalesce("more", F.lit(0))).otherwise(0)).alias("uses")).where("uses > 0")

    def shares(self) -> DataFrame:
        """(source, target_share, docs, tokens, max_uses, actual_share): what each source was to have and has."""
        total = sum(w for w, _ in self.targets.values())
        want = self.docs.sparkSession.createDataFrame([(s, w / total, r) for s, (w, r) in sorted(self.targets.items())], "source string, target_share double, max_repeats int")
        have = self.uses().groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("max_uses"))
        have = table(have, "shares")
        all_ = have.agg(F.sum("tokens")).first()[0]
        joined = want.join(have, "source", "left")
        zero = F.lit(0).cast("long")
        return joined.select("source", "target_share", "max_repeats", F.coalesce("docs", zero).alias("docs"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("max_uses", zero).alias("max_uses"), (F.coalesce("tokens", zero) / F.lit(float(all_ or 1))).alias("actual_share"))
