"""The exact filter by bitmaps: no pair is lost, however texts fall into groups, tiles and shares; and little is written."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import store
from millrace.operators import bitmaps, dedup, grams
from millrace.plans import queries


def texts(seed: int, n: int, alphabet: str = "abcdefghijkl ") -> list[tuple[int, str]]:
    rng, rows = random.Random(seed), []
    for k in range(n):
        base = "".join(rng.choice(alphabet) for _ in range(rng.choice([5, 7, 30, 110, 400, 1700])))
        other = list(base)
        for _ in range(rng.randint(0, 1 + len(base) // 30)):
            other[rng.randrange(len(other))] = rng.choice("xyz")
        rows += [(2 * k, base), (2 * k + 1, "".join(other))]
    return rows


def brute(rows, threshold):
    sets = {i: {t[j : j + 5] for j in range(len(t) - 4)} for i, t in rows}
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) > threshold * len(sets[a] | sets[b])}


def test_sets_of_many_texts_equal_those_of_one():
    some = ["", None, "abcd", "abcde", "aaaaaaaaa", "naïve \U0001f600 smile", "x\ud800yzabc", "the end of the end"]
    flat, sizes = grams.gram_sets(some, 5)
    assert [list(x) for x in (flat[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(some)))] == [list(grams.gram_set(t, 5)) for t in some]
    assert len(grams.gram_sets([], 5)[0]) == 0


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.95])
@pytest.mark.parametrize("side", [3, 512])
def test_no_pair_is_lost_by_tiles_and_shares(spark, monkeypatch, threshold, side):
    monkeypatch.setattr(bitmaps, "SHARE_BYTES", 40_000 if side == 3 else 1 << 30)
    monkeypatch.setattr(bitmaps, "LEFT", side)
    rows = texts(7, 120) + [(1000 + i, "one and the same text") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = dedup.candidate_pairs(docs, "exact", threshold)
    assert found.count() == found.distinct().count()
    want = brute(rows, threshold)
    assert {(r.lo, r.hi): r.sim for r in dedup.verify_pairs(found, docs, threshold).collect()} == want and len(want) > 60


def test_texts_that_share_all_rare_shingles_write_little(spark, monkeypatch, tmp_path):
    """Of shingles that many texts share, the prefix filter writes all pairs of texts; here each text is written once, as a bitmap."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(store, "shared_dir", lambda _: f"{tmp_path}/shared")
    assert dedup.candidate_pairs(docs, "exact").count() < 600
    written = sum(f.stat().st_size for f in (tmp_path / "shared").rglob("*.parquet"))
    assert written < 200_000 and not list((tmp_path / "shared").glob("prefixes-*"))


def test_banded_pairs_come_out_once_without_moving_pairs(spark):
    rng = random.Random(9)
    rows = [(i, b, rng.randrange(4)) for i in range(60) for b in range(5)]
    own = {i: {(b, k) for j, b, k in rows if j == i} for i in range(60)}
    got = dedup.lsh_candidates(spark.createDataFrame(rows + rows[:50], "id long, band int, bucket long"))
    assert sorted((r.lo, r.hi) for r in got.collect()) == [(a, b) for a in range(60) for b in range(a + 1, 60) if own[a] & own[b]]
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dedup_ratio", "jaccard_both_orders", "dedup_counts", "dedup_removed", "jaccard_pairs", "dedup_kept"])
def test_exact_queries_write_no_shared_shingles(spark, monkeypatch, tmp_path, name):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(50))) for i in range(200)]
    rows += [(200 + i, t[:-9] + "other end") for i, t in rows[:40]] + [(300 + i, t) for i, t in rows[:7]] + [(400, None), (401, ""), (402, "abc"), (403, "abc")]
    spark.createDataFrame(rows, "line_id long, content string").repartition(3).write.parquet(f"{tmp_path}/corpus_lines.parquet")
    monkeypatch.setattr(store, "shared_dir", lambda _: f"{tmp_path}/shared")
    got = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW corpus_lines AS SELECT * FROM '{tmp_path}/corpus_lines.parquet/*.parquet'")
    want = con.sql(queries.SQL[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert sum(f.stat().st_size for f in (tmp_path / "shared").rglob("*.parquet")) < 100_000 and not list((tmp_path / "shared").glob("prefixes-*"))
