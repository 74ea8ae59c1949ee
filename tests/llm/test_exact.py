"""Operators with an exact result, against brute force on small tables."""

import random
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import grams
from millrace.llm import cutoff, mixing, neardup, packing, prose, repetition, sampling

WORDS = "river stone lamp harbour printer garden weekly museum quarry ledger copper window sailor meadow".split()
LONG = "harbour ledger " * 20_000
NASTY = [(1, None), (2, ""), (3, "   \n \n"), (4, "abcd"), (5, LONG), (6, "x" * 5000), (7, "\U0001f600" * 30), (8, "same text, same text"), (9, "same text, same text")]


def docs(spark, rows, **extra):
    d = spark.createDataFrame(rows, "id long, text string")
    # columns whose names the operators use themselves
    for c in ("lang", "site", "url", "label", "key", "n", "rank", "share", "klass", "grams", "tail", "score"):
        d = d.withColumn(c, F.lit(extra.get(c)).cast("string"))
    return d


def random_texts(rng, n):
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 12, 60, 300]))) for _ in range(n)]
    out = list(base)
    for t in base:
        w = t.split()
        for _ in range(max(1, len(w) // 40)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w))
    return out + base[:3]


def true_pairs(rows, threshold=0.8, n=5):
    sets = {i: {t[k : k + n] for k in range(len(t) - n + 1)} for i, t in rows if t is not None}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > threshold}


def test_near_duplicates(spark):
    rng = random.Random(5)
    rows = list(enumerate(random_texts(rng, 40))) + [(i + 1000, t) for i, t in NASTY]
    found = neardup.NearDuplicates(docs(spark, rows))
    want = true_pairs(rows)
    assert {(r.id_lo, r.id_hi) for r in found.pairs().collect()} == want
    roots = {}
    for i, t in rows:
        if t is not None and len(t) >= 5:
            roots[i] = i
    for _ in rows:
        for x, y in want:
            roots[x] = roots[y] = min(roots[x], roots[y])
    copies = Counter(t for _, t in rows)
    text = dict(rows)
    assert {r.id: (r.class_id, r.copies) for r in found.classes().collect()} == {i: (c, copies[text[i]]) for i, c in roots.items()}
    assert {(r.id_lo, r.id_hi) for r in neardup.NearDuplicates(docs(spark, rows), exact=True).pairs().collect()} == want


def test_exact_prefixes_lose_no_pair_at_the_threshold(spark):
    rng = random.Random(21)
    rows = []
    for k in range(60):  # pairs whose similarity is just above or below the threshold
        base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.choice([30, 90, 400])))
        rows += [(2 * k, base), (2 * k + 1, base[: len(base) * 89 // 100] + "".join(rng.choice("qrstuv") for _ in range(rng.randint(0, len(base) // 8))))]
    want = true_pairs(rows)
    assert 5 < len(want) < 60
    for t in (0.8, 0.5):
        found = neardup.NearDuplicates(docs(spark, rows), threshold=t, exact=True)
        assert {(r.id_lo, r.id_hi) for r in found.pairs().collect()} == true_pairs(rows, t)


def test_one_template_of_many_texts(spark):
    """Every pair is a link, but classes are found with about one verification a text; and links by blocks, where a key is hot."""
    rng = random.Random(22)
    base = [rng.choice(WORDS) for _ in range(300)]

    def filled(i):
        return " ".join(base[:150]) + f" no {i:06d} " + " ".join(base[150:])

    rows = [(i, filled(i)) for i in range(1500)] + [(5000 + i, " ".join(rng.choice(WORDS) + str(rng.random()) for _ in range(40))) for i in range(20)]
    began = time.perf_counter()
    got = {r.id: r.class_id for r in neardup.NearDuplicates(docs(spark, rows)).classes().collect()}
    assert got == {i: 0 if i < 1500 else i for i, _ in rows} and time.perf_counter() - began < 60


def test_hot_keys_are_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(grams, "PROBE", 2)
    monkeypatch.setattr(grams, "HOT", 20)
    monkeypatch.setattr(grams, "BLOCK", 7)
    rows = [(k, i, 10) for k, n in ((1, 40), (2, 3), (3, 60)) for i in range(n)]
    keyed = spark.createDataFrame(rows, "key long, id long, grams int")
    assert {r.key for r in grams.hot_keys(keyed).collect()} == {1, 3}
    got = Counter((r.lo, r.hi) for r in grams.pair_up(keyed, 0.8).collect())
    assert got == Counter((a, b) for k, n in ((1, 40), (2, 3), (3, 60)) for a in range(n) for b in range(a + 1, n))


def test_near_duplicates_of_nothing(spark):
    found = neardup.NearDuplicates(docs(spark, []))
    assert found.pairs().count() == 0 and found.classes().count() == 0
    with pytest.raises(ValueError):
        neardup.NearDuplicates(docs(spark, []), threshold=1.0)


def test_candidates_emit_no_pairs_of_copies(spark):
    rows = [(i, "the same long text of many copies") for i in range(60)]
    found = neardup.NearDuplicates(docs(spark, rows))
    assert found.links.count() == 0
    assert {r.class_id for r in found.classes().collect()} == {0} and found.pairs().count() == 60 * 59 // 2


def share(text, width=20):
    s = "".join(c for c in text.lower() if unicodedata.category(c)[0] in "LN")
    seen, covered = set(), [False] * len(s)
    for i in range(len(s) - width + 1):
        g = s[i : i + width]
        if g in seen:
            covered[i : i + width] = [True] * width
        seen.add(g)
    return sum(covered) / max(1, len(s))


def test_repeated_share(spark):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(random_texts(rng, 15))] + [(i + 500, t) for i, t in NASTY] + [(900, "İstanbul Ⅳ ½ " * 9), (None, "no id")]
    got = {r.id: r["share"] for r in repetition.repetition(docs(spark, rows, lang="en")).collect()}
    assert got == {i: pytest.approx(share(t)) for i, t in rows if t is not None and i is not None}
    assert repetition.repetition(docs(spark, [])).count() == 0


def test_word_distance():
    ref = {"a": 0.5, "b": 0.5}
    assert repetition.word_distance(Counter(a=2, b=2), ref) == pytest.approx(0)
    assert 0 < repetition.word_distance(Counter(a=4), ref) < 1


def scores(spark, rows):
    return spark.createDataFrame(rows, "line_id long, ppl double, scored_at timestamp")


def test_cutoffs(spark):
    import datetime

    rng = random.Random(9)
    at = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k)
    lines = [(i, rng.choice([" News", "news", "Blogs ", None, "", "alone", "rare"])) for i in range(-50, 400)]
    rows = [(i, rng.choice([1.0, 2.5, 2.5, 30.0, float("nan"), float("inf"), -1.0, None, 1e-300, 1e300]), at(rng.randrange(3)) if rng.random() < 0.9 else None) for i in range(-60, 400) for _ in range(2)]
    goals = [("NEWS", 50), ("blogs", 100), ("rare", 0), ("rare", None)]
    got = cutoff.Cutoffs.of(
        spark.createDataFrame(lines, "line_id long, source string").withColumn("ppl", F.lit(1)).withColumn("code", F.lit("x")),
        scores(spark, rows),
        spark.createDataFrame(goals, "source string, keep_pct int"),
    )
    best: dict = {}
    for i, p, t in rows:
        if p is not None and 0 < p < float("inf"):
            key = (t is not None, t or at(0), -p)
            best[i] = max(best.get(i, key), key)
    by: dict = {}
    for i, s in lines:
        s = (s or "").strip().lower()
        if s and i in best:
            by.setdefault(s, []).append((-best[i][2], i))
    pct = {"news": 50, "blogs": 100, "rare": 0}
    want = {(s, i) for s, v in by.items() if s in pct for _, i in sorted(v)[len(v) * pct[s] // 100 :]}
    assert {(r.source, r.line_id) for r in got.dropped().collect()} == want


def test_cutoffs_of_nothing(spark):
    got = cutoff.Cutoffs.of(spark.createDataFrame([], "line_id long, source string"), scores(spark, []), spark.createDataFrame([("a", 5)], "source string, keep_pct int"))
    assert got.dropped().count() == 0 and got.cuts.count() == 0


def test_tree_adds_and_takes_out_batches(spark):
    a = spark.createDataFrame([("s", 3), ("s", 3), ("s", 9)], "source string, code long")
    b = spark.createDataFrame([("s", 1), ("t", 2)], "source string, code long")
    both = cutoff.add(cutoff.tree(a, 4), cutoff.tree(b, 4))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(both) == rows(cutoff.tree(a.union(b), 4))
    assert rows(cutoff.add(both, cutoff.tree(b, 4), -1)) == rows(cutoff.tree(a, 4))
    leaf = cutoff.descend(both, spark.createDataFrame([("s", 3), ("t", 5)], "source string, rank long"), 4).collect()
    assert [tuple(r) for r in leaf] == [("s", 3, 2)]


def test_ranked_ids_over_the_whole_range(spark):
    ids = [-(1 << 63), -5, -4, 0, 7, 8, (1 << 63) - 1, 1 << 40]
    rows = spark.createDataFrame([("s", i) for i in ids], "source string, line_id long")
    for k in (1, 3, 4, 7, 8):
        got = cutoff.ranked_ids(rows, spark.createDataFrame([("s", k)], "source string, rank long")).first()
        assert got.cut == sorted(ids)[k - 1]


def test_stored_tree_is_opened_again_and_fed_in_batches(spark, tmp_path):
    rng = random.Random(11)
    rows = [(s, i, rng.choice([0.01, 3.5, 1e9, 2e9, 3e9, 7.25, rng.uniform(2, 2.01)])) for i in range(400) for s in ["ab"[i % 2]]]
    coded = lambda part: spark.createDataFrame(part, "source string, line_id long, ppl double").withColumn("code", cutoff.score_code(F.col("ppl")))
    goal = spark.createDataFrame([("A ", 37), ("b", 80)], "source string, keep_pct int")

    def want(part):
        out = {}
        for s, pct in (("a", 37), ("b", 80)):
            own = sorted((p, i) for x, i, p in part if x == s)
            keep = len(own) * pct // 100
            out[s] = (len(own), keep, own[keep - 1][0] if keep else None)
        return out

    path = str(tmp_path / "tree")
    for name, part in (("one", rows[:150]), ("two", rows[150:]), ("two", rows[150:])):  # the second twice: a retry
        cutoff.ScoreTree(spark, path).add(coded(part), name)
    got = cutoff.Cutoffs(cutoff.ScoreTree(spark, path), goal)
    assert {r.source: (r.n, r.keep, r.cut_ppl) for r in got.cuts.collect()} == want(rows)
    left = {(r.source, r.line_id) for r in got.dropped().collect()}
    assert left == {(s, i) for s, pct in (("a", 37), ("b", 80)) for _, i in sorted((p, i) for x, i, p in rows if x == s)[sum(x == s for x, _, _ in rows) * pct // 100 :]}
    cutoff.ScoreTree(spark, path).take_out("two")
    assert {r.source: (r.n, r.keep, r.cut_ppl) for r in cutoff.Cutoffs(cutoff.ScoreTree(spark, path), goal).cuts.collect()} == want(rows[:150])


@pytest.mark.parametrize("total, size", [(10, 0), (10, 3), (10, 7), (10, 10), (1000, 400), (1, 1), (0, 0)])
def test_distinct_ranks(total, size):
    got = sampling.distinct_ranks(total, size, 3)
    assert len(set(got.tolist())) == size and all(0 <= x < total for x in got)


def test_every_rank_is_as_likely():
    seen = Counter(x for seed in range(3000) for x in sampling.distinct_ranks(12, 5, seed).tolist())
    assert all(1100 < seen[x] < 1400 for x in range(12))


def test_pieces_staged_in_one_pass(spark):
    rows = docs(spark, [(i, f"t{i}") for i in range(90)]).withColumn("piece", F.when(F.col("id") % 10 > 0, F.col("id") % 3))
    stage = sampling.Stage(spark).arrive(rows, piece="piece").arrive(rows.where("id < 5"))
    assert sum(n for _, n in stage.counts()) == 95 and {r.piece for r in stage.sample(95).collect()} == {None, 0, 1, 2}
    drawn = stage.sample(20, 1)
    assert drawn.count() == 20 and len({r.sample_rank for r in drawn.collect()}) == 20 and drawn.columns == [*rows.columns, "sample_rank"]
    with pytest.raises(ValueError):
        stage.arrive(rows.drop("text"))


def test_layout_scores_decide_by_rank(spark):
    rng = random.Random(13)
    rows = [(i, "en" if i % 3 else "de", rng.choice([0.0, 0.5, 1.0]), rng.choice([0.0, 0.0, 0.2, 0.6, 0.9])) for i in range(300)] + [(900, "", 0.0, 0.0), (901, "pt", 1.0, 0.0)]
    names = "id long, lang string, end_share double, junk_share double"
    measured = spark.createDataFrame(rows, names)
    for c in set(prose.STATISTICS) - {"end_share", "junk_share"}:
        measured = measured.withColumn(c, F.lit(1))
    scored = prose.table(prose.outliers(measured.withColumn("score", F.lit("mine")), ["id"]), "scored")
    by = {}
    for lang in ("en", "de", "pt"):
        own = [(i, e, j) for i, x, e, j in rows if x == lang]
        for i, e, j in own:
            low, high = sum(y <= e for _, y, _ in own) / len(own), sum(y >= j for _, _, y in own) / len(own)
            by[i] = (lang, -np.log(low) - np.log(high), j)
    got = {r.id: r.layout_score for r in scored.collect()}
    assert got[900] == float("inf") and {i: got[i] for i in by} == pytest.approx({i: v[1] for i, v in by.items()})
    want = {900}
    for lang in ("en", "de", "pt"):
        own = sorted((round(s, 9) for x, s, _ in by.values() if x == lang), reverse=True)
        k = sum(x == lang and j > 0.5 for x, _, j in by.values())
        want |= {i for i, (x, s, _) in by.items() if x == lang and k and round(s, 9) >= own[k - 1]}
    assert {r.id for r in prose.outlying(scored).collect()} == want
    assert prose.outlying(scored.where("false")).count() == 0


def test_exact_ranks(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), "s", float(rng.randrange(30))) for _ in range(500)]
    got = prose.exact_ranks(spark.createDataFrame(rows, "grp string, stat string, value double")).collect()
    for r in got:
        own = [v for g, _, v in rows if g == r.grp]
        assert (r.n, r.upto, r.total) == (own.count(r.value), sum(v <= r.value for v in own), len(own))
    assert len(got) == len(set(rows))
    assert prose.exact_ranks(spark.createDataFrame([], "grp string, stat string, value double")).count() == 0


def test_sample(spark):
    hits: Counter = Counter()
    for seed in range(40):
        stage = sampling.Stage(spark)
        at = 0
        for size in (3, 0, 11, 1, 5):
            stage.arrive(docs(spark, [(i, None if i % 4 else "t") for i in range(at, at + size)]).withColumn("sample_rank", F.lit("mine")))
            at += size
        got = [r.id for r in stage.sample(5, seed).collect()]
        assert len(got) == len(set(got)) == 5
        hits.update(got)
        if not seed:
            assert sorted(r.id for r in stage.sample(99).collect()) == list(range(20)) and stage.sample(0).count() == 0
    # each of 20 rows is drawn with probability 1/4; chi-square with 19 degrees of freedom
    assert sum((hits[i] - 10) ** 2 / 10 for i in range(20)) < 44
    assert sampling.Stage(spark).arrive(docs(spark, [])).sample(3).count() == 0


def check_packing(rows, sizes, jobs):
    caps = sorted(c for _, c in jobs)
    for name, cap in jobs:
        own = [r for r in rows if r.job_name == name]
        total = Counter()
        for r in own:
            total[r.id] += r.tokens
        assert total == Counter(dict(sizes)) and {r.id for r in own} == {i for i, _ in sizes}
        for i, s in sizes:
            assert sum(r.id == i for r in own) == (1 if s <= cap else -(-s // cap))
        bins: dict = {}
        for r in own:
            if r.tokens:
                bins.setdefault(r.container_id, []).append(r)
            else:
                assert r.container_id is None
        for b in bins.values():
            held, length = sum(r.tokens for r in b), {r.container_size for r in b}
            assert len(length) == 1 and length <= {c for c in caps if c <= cap}
            assert length == {min(c for c in caps if c >= held)}


def test_packing(spark):
    rng = random.Random(8)
    sizes = [(i, rng.choice([0, 1, 7, 7, 7, 7, 30, 64, 65, 100, 257, 1000, rng.randrange(1, 120)])) for i in range(400)]
    jobs = [("a", 64), ("b", 100), ("c", 256)]
    d = spark.createDataFrame(sizes, "id long, tokens long").withColumn("rank", F.lit(1)).withColumn("salt", F.lit(2))
    rows = packing.pack(d, jobs).collect()
    check_packing(rows, sizes, jobs)
    used = {r.container_id: r.container_size for r in rows if r.job_name == "c" and r.tokens}
    assert sum(s for _, s in sizes) / sum(used.values()) > 0.97
    assert packing.pack(spark.createDataFrame([], "id long, tokens long"), jobs).count() == 0
    with pytest.raises(ValueError):
        packing.pack(d, [])


@pytest.mark.parametrize("seed", range(20))
def test_plan_places_every_item_once(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 200): rng.randrange(1, 60) for _ in range(rng.randrange(1, 40))}
    moves, bins = packing.Plan(counts, [50, 120, 199]).arrays()
    held: Counter = Counter()
    for size, n in counts.items():
        at, length = packing.Plan.place(moves, bins, np.full(n, size), np.arange(n))
        for b, x in zip(at.tolist(), length.tolist(), strict=True):
            held[b] += size
            assert size <= x
    told = {b: (f, x) for a, n, f, x in bins.tolist() for b in range(a, a + n)}
    assert held == Counter({b: f for b, (f, _) in told.items()}) and all(f <= x for f, x in told.values())


def test_water_fill():
    assert mixing.water_fill(100, [1, 1, 2], [1000, 1000, 1000]) == [25, 25, 50]
    assert mixing.water_fill(100, [1, 1, 2], [1000, 1000, 10]) == [45, 45, 10]
    assert mixing.water_fill(100, [1, 0], [10, 50]) == [10, 0]
    assert sum(mixing.water_fill(101, [1, 1, 1], [50, 50, 50])) == 101
    assert mixing.water_fill(5, [], []) == []


def test_shortage_goes_to_siblings_first():
    leaves = [(("d", "a"), 1.0, 10), (("d", "b"), 1.0, 500), (("e", "c"), 2.0, 500)]
    assert mixing.leaf_budgets(leaves, 400) == {("d", "a"): 10, ("d", "b"): 190, ("e", "c"): 200}


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(0, 50), rng.choice(["News", "news ", "blogs", "tiny" if i < 40 else "news", None, "other"]), rng.choice(["en", "de", None])) for i in range(500)]
    d = spark.createDataFrame(rows, "id long, tokens long, source string, lang string").withColumn("weight", F.lit(3)).withColumn("rest", F.lit("x"))
    goals = spark.createDataFrame([("news", 0.3, 1), ("blogs", 0.5, 3), ("tiny", 0.2, 2), ("gone", 0.1, 2), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    m = mixing.Mixture(d, goals, {"web": "a b"}, budget=9000)
    used = m.uses().collect()
    most = {"news": 1, "blogs": 3, "tiny": 2}
    assert all(r.source in most and 0 < r.uses <= most[r.source] for r in used)
    total = sum(r.tokens * r.uses for r in used)
    assert 9000 - 6 * 50 <= total <= 9000
    again = {(r.id, r.uses) for r in mixing.Mixture(d.repartition(7), goals, {"web": "a b"}, budget=9000).uses().collect()}
    assert again == {(r.id, r.uses) for r in used}
    shares = {r.source: r for r in m.shares().collect()}
    assert shares["gone"].tokens == 0 and sum(r.actual_share for r in shares.values()) == pytest.approx(1)
    assert mixing.Mixture(d.where("false"), goals, {}).shares().count() == 4 and mixing.Mixture(d, goals.where("false"), {}).uses().count() == 0
