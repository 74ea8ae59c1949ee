"""Filling containers of several permitted lengths with documents, by best fit over counts of equal sizes.

Items of one size are alike, so the plan is made on the counts of sizes, at most as many as the largest capacity, and not on
items: sizes in falling order go one a bin into the open bins with the least sufficient room; what is left opens bins of the
length whose cost for each token of copies of that size is least.  In the end each bin is cut down to the shortest permitted
length that holds its contents.  Bins of equal contents are one range of numbers, so a plan has a few ranges for each size.

Items get their place by their rank within their size.  Ranks are counted within salted groups and added up over the
groups, so that a size which a third of the items share is spread out.

A document longer than the capacity is cut into pieces of the capacity and a rest; others are never split.  Documents without
tokens (null and empty texts) are in no container: their container is null.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import table

#: Cost of a bin beside its length, in tokens.
OVERHEAD = 16
#: Items that a group of one size and salt has on average, where one size has all items.
GROUP_ROWS = 100_000


def opening(size: int, lengths: list[int], overhead: int = OVERHEAD) -> int:
    """Permitted length of least cost for each token of copies of ``size``; of equal ones the longest."""
    fit = [x for x in lengths if x >= size]
    return min(fit, key=lambda x: ((x + overhead) / (x // size * size), -x))


class Plan:
    """Where the items of each size go.

    ``moves``: (size, first rank, items, first bin, items a bin); ``bins``: (first bin, bins, tokens in each, length).
    """

    def __init__(self, counts: dict[int, int], lengths: list[int], overhead: int = OVERHEAD):
        self.lengths = sorted(lengths)
        top = self.lengths[-1]
        if any(not 0 < s <= top for s in counts):
            raise ValueError("sizes must be above 0 and at most the largest length")
        self.moves: list[tuple[int, int, int, int, int]] = []
        rooms: list[int] = []  # rooms of open bins, sorted
        open_: dict[int, list[tuple[int, int, int]]] = {}  # room -> ranges (first bin, bins, tokens in each)
        done: list[tuple[int, int, int]] = []
        next_bin = 0

        def put(room: int, first: int, n: int, filled: int) -> None:
            if room == 0:
                done.append((first, n, filled))
                return
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((first, n, filled))

        for size in sorted(counts, reverse=True):
            left, rank = counts[size], 0
            while left:
                at = bisect_left(rooms, size)
                if at < len(rooms):
                    room = rooms[at]
                    first, n, filled = open_[room].pop()
                    each = room // size  # best fit returns to the bin it has just used while there is room
                    use = min(n, -(-left // each))
                    if use < n:
                        open_[room].append((first + use, n - use, filled))
                else:
                    room = opening(size, self.lengths, overhead)
                    each = room // size
                    use = -(-left // each)
                    first, n, filled = next_bin, use, 0
                    next_bin += use
                if room in open_ and not open_[room]:
                    del open_[room]
                    rooms.pop(bisect_left(rooms, room))
                placed = min(left, use * each)
                self.moves.append((size, rank, placed, first, each))
                whole, rest = divmod(placed, each)
                if whole:
                    put(room - each * size, first, whole, filled + each * size)
                if rest:
                    put(room - rest * size, first + whole, 1, filled + rest * size)
                rank += placed
                left -= placed
        for ranges in open_.values():
            done += ranges
        self.bins = [(a, n, f, self.lengths[bisect_left(self.lengths, f)]) for a, n, f in sorted(done)]

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Moves sorted by (size, rank) and bins by number, for search."""
        moves = np.array(sorted(self.moves), np.int64).reshape(-1, 5)
        return moves, np.array(self.bins, np.int64).reshape(-1, 4)

    @staticmethod
    def place(moves: np.ndarray, bins: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bins and their lengths of items given by size and rank (from 0)."""
        span = np.int64(1) << np.int64(44)
        at = np.searchsorted(moves[:, 0] * span + moves[:, 1], size * span + rank, side="right") - 1
        bin_ = moves[at, 3] + (rank - moves[at, 1]) // moves[at, 4]
        return bin_, bins[np.searchsorted(bins[:, 0], bin_, side="right") - 1, 3]


def pieces(sized: DataFrame, jobs: list[tuple[str, int]]) -> DataFrame:
    """(job_name, capacity, id, piece, start, tokens): every document for every job, cut where it exceeds the capacity."""
    spec = F.array(*(F.struct(F.lit(n).alias("job_name"), F.lit(c).cast("long").alias("capacity")) for n, c in jobs))
    rows = sized.select("id", F.col("tokens").alias("size"), F.explode(spec).alias("j")).select("j.*", "id", "size")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("greatest(0, (size - 1) div capacity)"))))
    return rows.select("job_name", "capacity", "id", "piece", F.expr("least(capacity, size - piece * capacity)").alias("tokens"))


def pack(sized: DataFrame, jobs: list[tuple[str, int]], overhead: int = OVERHEAD, salts: int | None = None) -> DataFrame:
    """(job_name, id, piece, tokens, container_id, container_size) of documents (id, tokens).

    A job may use every capacity of ``jobs`` up to its own.  Without ``salts`` their number follows from the number of documents and
    the tokens in them, so that a group has about GROUP_ROWS items however large the corpus is.
    """
    if not jobs or any(c < 1 for _, c in jobs):
        raise ValueError("there must be a job, and capacities must be at least 1")
    if len({n for n, _ in jobs}) < len(jobs):
        raise ValueError("names of jobs must differ")
    if salts is None:
        most = sized.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
        salts = max(8, -(-(most.n + most.t // min(c for _, c in jobs)) // GROUP_ROWS))
    # pieces of one document too go to different groups
    items = pieces(sized, jobs).withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    order = Window.partitionBy("job_name", "tokens", "salt").orderBy("id", "piece")
    ranked = table(items.withColumn("r", F.row_number().over(order).cast("long") - 1), "ranked")
    groups = ranked.groupBy("job_name", "tokens", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("job_name", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = groups.withColumn("before", F.coalesce(before, F.lit(0)))
    counts: dict[str, dict[int, int]] = {n: {} for n, _ in jobs}
    for r in groups.where("tokens > 0").groupBy("job_name", "tokens").agg(F.sum("n").alias("n")).collect():  # at most one row for each size of each job
        counts[r.job_name][r.tokens] = r.n
    capacities = [c for _, c in jobs]
    plans = {n: Plan(counts[n], sorted({x for x in capacities if x <= c}), overhead).arrays() for n, c in jobs}
    given = sized.sparkSession.sparkContext.broadcast(plans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            job = np.array(b.column(0).to_pylist(), object)
            size, rank = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            bins, lengths = np.zeros(len(job), np.int64), np.zeros(len(job), np.int64)
            for name, (moves, ranges) in given.value.items():
                own = (job == name) & (size > 0)
                if own.any():
                    bins[own], lengths[own] = Plan.place(moves, ranges, size[own], rank[own])
            none = size <= 0
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(bins, pa.int64(), mask=none), pa.array(lengths, pa.int64(), mask=none)], names=["job_name", "id", "piece", "tokens", "container_id", "container_size"])

    placed = ranked.join(offsets.select("job_name", "tokens", "salt", "before"), ["job_name", "tokens", "salt"])
    rows = placed.select("job_name", "id", "piece", "tokens", (F.col("r") + F.col("before")).alias("rank"))
    return rows.mapInArrow(run, "job_name string, id long, piece long, tokens long, container_id long, container_size long")
