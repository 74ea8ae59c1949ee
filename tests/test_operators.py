import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup, judge, knowledge, lm, rules, sampling, vectors
from millrace.plans import flows
from millrace.sources import corpus
from millrace.streaming import stream


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def pairs(spark, rows):
    return spark.createDataFrame(rows, "lo long, hi long")


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


@pytest.mark.parametrize("edges, gone", [([(0, 1), (0, 2)], [0]), ([(0, 1), (1, 2)], [0, 1]), ([(0, 1), (0, 2), (1, 2)], [0, 1]), ([], [])])
def test_removed_ids(spark, edges, gone):
    assert ids(dedup.removed_ids(pairs(spark, edges))) == gone


def test_removal_equals_greedy_loop(spark):
    rng = random.Random(3)
    for _ in range(3):
        edges = sorted({tuple(sorted(rng.sample(range(9), 2))) for _ in range(8)})
        gone: set[int] = set()
        for a, b in edges:
            if a not in gone and b not in gone:
                gone.add(a)
        assert ids(dedup.removed_ids(pairs(spark, edges))) == sorted(gone)


def brute(rows, th=0.8, n=5):
    sets = {i: {t[k : k + n] for k in range(len(t) - n + 1)} for i, t in rows if t is not None}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > th:
                out.add((a, b))
    return out


def corpus_rows():
    rng = random.Random(1)
    words = ["river", "stone", "lamp", "harbour", "printer", "garden", "weekly", "museum", "quarry", "ledger"]
    base = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(12)]
    rows = list(enumerate(base))
    for k, t in enumerate(base[:6]):
        w = t.split()
        w[rng.randrange(40)] = "altered"
        rows.append((100 + k, " ".join(w)))
    rows += [(200, base[0]), (201, base[0]), (202, None), (203, ""), (204, "abc"), (205, "abcdefgh"), (206, "abcdefghi")]
    return rows


@pytest.mark.parametrize("method", ["exact", "lsh"])
def test_pairs_equal_brute_force(spark, method):
    rows = corpus_rows()
    d = docs(spark, rows)
    found = dedup.verify_pairs(dedup.candidate_pairs(d, method), d)
    assert {(r.lo, r.hi) for r in found.collect()} == brute(rows)
    kept, removed = dedup.deduplicate(d, method=method)
    gone = {a for a, _ in brute(rows)}
    assert set(ids(removed, "doc_id")) == gone
    assert set(ids(kept, "doc_id")) == {i for i, _ in rows} - gone


def test_dedup_of_nothing(spark):
    kept, removed = dedup.deduplicate(docs(spark, []))
    assert kept.count() == 0 and removed.count() == 0
    r = dedup.kept_ratio(docs(spark, [(i, "x") for i in range(4)]), docs(spark, [(i, "x") for i in range(3)])).first()
    assert (r.total, r.kept, r.ratio, r.ratio_compat) == (4, 3, 0.75, 0.6)


def test_no_cartesian_product_and_no_row_udf(spark):
    d = docs(spark, corpus_rows())
    plan = dedup.prefix_candidates(d)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_bands_must_divide(spark):
    with pytest.raises(ValueError):
        dedup.lsh_bands(dedup.minhash(docs(spark, [(1, "abcdef")]), 10), 3, 10)


def test_components(spark):
    got = {r.id: r.root for r in dedup.components(pairs(spark, [(1, 2), (2, 3), (3, 9), (5, 6)])).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5}


@pytest.mark.parametrize("n, q, pos", [(10, 0.8, 8), (100, 0.57, 56), (1, 0.8, 0), (0, 0.8, 0)])
def test_quantile_cut(spark, n, q, pos):
    rows = spark.createDataFrame([(i, float(i % 3)) for i in range(n)], "doc_id long, ppl double")
    got = lm.split_by_quantile(rows, q=q).orderBy("rank").collect()
    assert sum(r.label == "pos" for r in got) == pos
    assert [(r.ppl, r.doc_id) for r in got] == sorted((r.ppl, r.doc_id) for r in got)
    assert [r["rank"] for r in got] == list(range(1, n + 1))


def test_arpa(spark, tmp_path):
    path = tmp_path / "m.arpa"
    path.write_text("\\data\\\n\n\\1-grams:\n-1.0\t<unk>\n-99\t<s>\t-0.3\n-0.5\t</s>\n-0.7\ta\t-0.2\n\n\\2-grams:\n-0.1\t<s> a\n-0.2\ta </s>\n\n\\end\\\n")
    got = lm.perplexity(docs(spark, [(1, "a"), (2, "b"), (3, None)]), lm.arpa_scorer(str(path))).orderBy("doc_id").collect()
    assert got[0].ppl == pytest.approx(10 ** (0.3 / 2))
    assert got[1].ppl == pytest.approx(10 ** ((0.3 + 1.0 + 0.5) / 2))
    assert got[2].ppl is None


def test_rules(spark):
    d = docs(spark, [(1, "a1"), (2, "12"), (3, " 1"), (4, None), (5, "")])
    kept = rules.apply_rules(d, ["strip_digits"])
    assert [(r.doc_id, r.text) for r in kept.orderBy("doc_id").collect()] == [(1, "a"), (3, " ")]
    m = rules.rule_metrics(docs(spark, [(1, "x" * 10), (2, "y" * 10), (3, "9")]), [lambda t: F.when(t == "9", "").when(t.startswith("x"), F.substring(t, 1, 5)).otherwise(t)]).first()
    assert (m.line_count, m.write_count) == (3, 2) and m.edit_rate == pytest.approx(1.5 / (2 + 1e-6))
    assert rules.apply_rules(d, [rules.python_rule(str.strip)]).count() == 3


@pytest.mark.parametrize("p, rounds", [(0.0, 1), (1.0, 4)])
def test_contamination_rounds(spark, p, rounds):
    got = rules.contaminate(docs(spark, [(1, "a"), (2, None)]), lambda t: F.concat(t, F.lit("!")), p, 3).orderBy("doc_id").collect()
    assert got[0].n_rounds == rounds and got[0].text == "a" + "!" * rounds and got[1].text is None


def test_contamination_stops_at_first_high_draw(spark):
    d = docs(spark, [(i, "") for i in range(2000)])
    counts = {r.n_rounds: r["count"] for r in rules.contaminate(d, lambda t: F.concat(t, F.lit("!")), 0.5, 3).groupBy("n_rounds").count().collect()}
    assert abs(counts[1] - 1000) < 120 and abs(counts[2] - 500) < 100 and abs(counts[4] - 250) < 80


@pytest.mark.parametrize("answer, strict, written", [("1", ["pos"], ["pos"]), ("0", ["neg"], ["neg"]), ("10", [], ["neg", "pos"]), ("good", [], []), (None, [], []), ("", [], [])])
def test_verdicts(spark, answer, strict, written):
    a = spark.createDataFrame([(answer,)], "response string")
    assert ids(judge.verdicts(a), "verdict") == strict
    assert ids(judge.verdicts(a, strict=False), "verdict") == written


def test_sample(spark):
    d = docs(spark, [(i, "t") for i in range(50)])
    one = ids(sampling.sample(d, 20), "doc_id")
    assert len(one) == 20 and one == ids(sampling.sample(d.repartition(7), 20), "doc_id")
    assert sampling.sample(d, 80).count() == 50 and sampling.sample(d, 0).count() == 0


def test_sample_batches(spark):
    d = docs(spark, [(i, "x" * (3 + i % 9)) for i in range(40)])
    got = sampling.sample_batches(d, 3, 4, 6).collect()
    assert len({(r.batch, r.slot) for r in got}) == len(got) == 12 and all(len(r.text) <= 6 for r in got)


def test_entities_and_density(spark):
    d = docs(spark, [(1, "at Old Mill today"), (2, "Old Mill, closed"), (3, None), (4, "old mill")])
    e = spark.createDataFrame([("Old Mill",), ("x",)], "entity string")
    assert {(r.id, r.entity) for r in knowledge.mentions(d, e).collect()} == {(1, "Old Mill"), (4, "Old Mill")}
    r = knowledge.knowledge_density(d, e).first()
    assert (r.mentions, r.size) == (2, 9)
    zh = knowledge.mentions(docs(spark, [(1, "我们在月岚港"), (2, "港")]), spark.createDataFrame([("月岚港",)], "entity string"), "char")
    assert [(r.id, r.entity) for r in zh.collect()] == [(1, "月岚港")]


def test_mtld():
    assert knowledge.mtld_of([]) == 0.0
    assert knowledge.mtld_of(["a"] * 10) == pytest.approx(2.0)
    assert knowledge.mtld_of(list("abcdefghij")) == 10.0


def vecs(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, cluster int, embedding array<float>")


def test_medoid_ties_and_mean_cosine(spark):
    v = vecs(spark, [(1, 0, [0.0, 1.0]), (2, 0, [0.0, -1.0]), (3, 1, [1.0, 0.0])])
    m = {r.cluster: (r.medoid, r["size"]) for r in vectors.medoids(v).collect()}
    assert m == {0: (1, 2), 1: (3, 1)}
    r = vectors.mean_cosine(v).first()
    assert (r.vectors, r.pairs) == (3, 3) and r.mean_cosine == pytest.approx(-1 / 3)
    assert vectors.pair_cosines(v, 10).count() == 3


def test_batch_diversity_leaves_out_equal_batches(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 1.0])], "id long, v array<double>")
    assert vectors.batch_diversity(few).first().pairs == 2
    assert vectors.t_quantile(0.975, 10) == pytest.approx(2.2281, abs=1e-3)


def test_json_corpus(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.jsonl").write_text('{"content": "one", "x": {"y": 1}}\n\n{"content": "two"}\n')
    (tmp_path / "in/sub/_b").write_text('{"content": "three"}\n')
    d = corpus.read_corpus(spark, str(tmp_path / "in/*"), "content")
    assert {r.content for r in d.collect()} >= {"one", "two"}
    with_id = corpus.with_ids(corpus.read_corpus(spark, str(tmp_path / "in/a.jsonl"), "content"), ["_raw"])
    assert ids(with_id, "doc_id") == [0, 1]
    corpus.write_raw(d, str(tmp_path / "raw"))
    assert '{"content": "one", "x": {"y": 1}}' in [r.value for r in spark.read.text(str(tmp_path / "raw")).collect()]
    (tmp_path / "bad.jsonl").write_text('{"text": "x"}\n')
    with pytest.raises(Exception, match="no field content"):
        corpus.read_corpus(spark, str(tmp_path / "bad.jsonl"), "content").collect()


def test_sinks(spark, tmp_path):
    d = docs(spark, [(1, "abcdef"), (2, "abcdef")])
    corpus.write_pairs(pairs(spark, [(1, 2)]).withColumn("sim", F.lit(1.0)), d, str(tmp_path / "pairs"))
    assert spark.read.json(str(tmp_path / "pairs")).first().asDict() == {"text0": "abcdef", "text1": "abcdef", "pair": [1, 2], "sim": 1.0}
    corpus.write_split(d.withColumn("label", F.lit("pos")), str(tmp_path / "split"))
    assert (tmp_path / "split/label=pos").is_dir()
    corpus.write_profile(flows.profile(d, ["length"]), str(tmp_path / "profile"))
    line = next(p for p in (tmp_path / "profile").iterdir() if p.name.endswith(".json")).read_text()
    assert json.loads(line)["list_doc_length"] == [1, 1]


def test_profile_asks_for_known_metrics(spark):
    with pytest.raises(ValueError):
        flows.profile(docs(spark, [(1, "a")]), ["colour"])


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a1", "2024-01-01 00:00:00"), (2, "a1", "2024-01-01 00:01:00"), (3, "7", "2024-01-01 00:02:00")], "doc_id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(str(tmp_path / "in"))
    live = stream.drop_repeats(stream.filter_stream(stream.read_stream(spark, str(tmp_path / "in"), rows.schema), ["strip_digits"]), "at")
    stream.run_once(live, str(tmp_path / "out"), str(tmp_path / "state"))
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]


def test_leftmost_longest(spark):
    d = docs(spark, [(1, "at old mill road old mill lamp"), (2, "old mill lamp"), (3, None)])
    e = spark.createDataFrame([("Old Mill",), ("Old Mill Road",), ("lamp",)], "entity string")
    assert {(r.id, r.entity) for r in knowledge.leftmost_longest(d, e).collect()} == {(1, "Old Mill Road"), (1, "lamp"), (2, "Old Mill")}
    assert knowledge.segmented(docs(spark, [(1, "ab")]), list).first().text == "a b"


def test_injected_models(spark):
    d = docs(spark, [(1, "abc"), (2, None), (3, "de")])
    got = {r.vec_id: r.embedding for r in vectors.embed(d, lambda: lambda texts: [[len(t), 1] for t in texts]).collect()}
    assert got == {1: [3.0, 1.0], 3: [2.0, 1.0]}
    b = spark.createDataFrame([(0, 1, "b"), (0, 0, "a"), (1, 0, "c")], "batch long, slot long, text string")
    assert {r.id: r.v for r in vectors.batch_embeddings(b, lambda texts: [len(texts), ord(texts[0])]).collect()} == {0: [2.0, 97.0], 1: [1.0, 99.0]}


def test_settings():
    from millrace.settings import Settings

    assert Settings().having(ngram=3, seeds=None) == Settings(ngram=3)
    with pytest.raises(ValueError):
        Settings().having(colour=1)


@pytest.mark.parametrize("broadcast_keys, hot_keys", [(100, 5), (0, 5), (0, 1), (0, 1000)])
def test_lookup_of_hot_and_rare_keys(spark, broadcast_keys, hot_keys):
    from millrace.operators.joins import lookup

    rows = [(i, None if i % 11 == 0 else "hot" if i % 2 else f"k{i % 7}") for i in range(300)]
    keyed = [("hot", 150, 1.5), ("k1", 20, 2.5), ("k2", 20, None), ("k3", 5, 3.5), ("never", 0, 9.0)]
    got = lookup(spark.createDataFrame(rows, "id long, key string"), spark.createDataFrame(keyed, "key string, n long, value double"), ["key"], "n", broadcast_keys, hot_keys)
    values = {k: v for k, _, v in keyed}
    assert sorted(got.columns) == ["id", "key", "value"] and {r.id: r.value for r in got.collect()} == {i: values.get(k) for i, k in rows} and got.count() == 300


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_exact_filter_loses_no_pair(spark, threshold):
    rng = random.Random(41)
    rows = [(-1, None), (-2, ""), (-3, "abcd"), (-4, "abcde"), (-5, "abcde")]
    for k in range(80):
        base = "".join(rng.choice("abcdefghij ") for _ in range(rng.choice([6, 9, 30, 200])))
        rows += [(2 * k, base), (2 * k + 1, base[: int(len(base) * rng.uniform(0.6, 1))] + "".join(rng.choice("klmno") for _ in range(rng.randint(0, 1 + len(base) // 8))))]
    sets = {i: {t[j : j + 5] for j in range(len(t) - 4)} for i, t in rows if t}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > threshold}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup.verify_pairs(dedup.candidate_pairs(docs, "exact", threshold), docs, threshold)
    assert {(r.lo, r.hi) for r in got.collect()} == want and len(want) > 10
    assert dedup.verify_pairs(dedup.candidate_pairs(docs.where("false"), "exact"), docs).count() == 0


def test_bucket_of_many_texts_goes_in_blocks(spark, monkeypatch):
    from millrace.operators import grams

    monkeypatch.setattr(grams, "PROBE", 2)
    monkeypatch.setattr(grams, "HOT", 20)
    monkeypatch.setattr(grams, "BLOCK", 7)
    rows = [(i, b, k) for b, k, n in ((0, 1, 40), (0, 2, 3), (1, 1, 30)) for i in range(n)]
    got = dedup.lsh_candidates(spark.createDataFrame(rows, "id long, band int, bucket long"))
    assert {(r.lo, r.hi) for r in got.collect()} == {(a, b) for a in range(40) for b in range(a + 1, 40)} and got.count() == 780


def test_permutation_of_pair_numbers():
    import numpy as np

    for total in (1, 2, 3, 10, 45, 1000):
        got = vectors.permuted(np.arange(total), total, 5)
        assert sorted(got.tolist()) == list(range(total))
    a, b = vectors.pair_numbers(np.arange(4950))
    assert {(int(x), int(y)) for x, y in zip(a, b)} == {(x, y) for y in range(100) for x in range(y)}
    big = np.array([2**60 + 12345])
    a, b = vectors.pair_numbers(big)
    assert 0 <= a[0] < b[0] and int(b[0]) * (int(b[0]) - 1) // 2 + int(a[0]) == int(big[0])


def test_drawn_pairs_are_spread_and_differ_by_seed(spark):
    vecs = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(50)], "vec_id long, embedding array<float>")
    one, two = ({(r.i, r.j) for r in vectors.pair_cosines(vecs, 300, s).collect()} for s in (1, 2))
    assert len(one) == len(two) == 300 and one != two and all(i < j for i, j in one | two)
    assert len({(r.i, r.j) for r in vectors.pair_cosines(vecs, 10_000).collect()}) == 1225
    assert vectors.pair_cosines(vecs.where("false"), 5).count() == 0


def test_kmeans_of_a_given_start(spark):
    rows = [(i, [float(i), 0.0]) for i in (0, 1, 2, 10, 11, 12)]
    got = {r.vec_id: r.cluster for r in vectors.kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 2, 0, start=[[1.0, 0.0], [1.0, 0.0]]).collect()}
    assert got == dict.fromkeys((0, 1, 2, 10, 11, 12), 0)
    got = {r.vec_id: r.cluster for r in vectors.kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 2, start=[[0.0, 0.0], [3.0, 0.0]]).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 10: 1, 11: 1, 12: 1}


def test_scores_of_an_other_id_column(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x x z"), ("c", None)], "key string, text string")
    got = {r.key: r.ppl for r in lm.unigram_scorer(lm.unigrams(docs), "key")(docs, "text").collect()}
    base = 5 + 3 + 1
    assert got["c"] is None and got["b"] == pytest.approx((4 / base * 2 / base) ** -0.5) and got["a"] == pytest.approx((4 / base * 4 / base * 2 / base) ** (-1 / 3))
    with pytest.raises(ValueError):
        lm.unigram_scorer(lm.unigrams(docs))(docs, "text")


def test_judge_of_a_corpus(spark):
    docs = spark.createDataFrame([(i, None if i == 7 else "good" if i % 3 else "bad words") for i in range(30)], "doc_id long, text string")
    got = flows.judged_split(docs, lambda p: "1" if "'''good'''" in p else "0", "Is it good?").collect()
    assert len(got) == 29 and all((r.verdict == "pos") == (r.text == "good") for r in got)
    assert flows.judged_split(docs, lambda p: "1", "Is it good?", n=10).count() == 10


def test_profile_with_models(spark):
    docs = spark.createDataFrame([(i, f"the Old Mill and the New Port {'x' * (i % 5)}") for i in range(60)], "doc_id long, text string")
    entities = spark.createDataFrame([("Old Mill",), ("New Port",), ("Nowhere",)], "entity string")
    embed = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    fisher = lambda texts: [1.0 + len(texts), sum(map(len, texts)) + 1.0]
    got = flows.profile(docs, ["knowledge", "diversity"], n=None, entities=entities, embed=embed, fisher=fisher).first()
    assert got.list_sim_knowledge == pytest.approx([1.0]) and got.knowledge_density > 0 and got.task2vec_div is not None


def test_mirrored_tree_and_rising_split(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    for name in ("a/x.jsonl", "y.jsonl"):
        (tmp_path / "in" / name).write_text("".join(json.dumps({"text": f"{name} {i}"}) + "\n" for i in range(3)))
    docs = corpus.read_corpus(spark, str(tmp_path / "in"))
    corpus.write_mirrored(docs, str(tmp_path / "in"), str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out")).collect()
    assert {r.file for r in back} == {"a/x.jsonl", "y.jsonl"} and len(back) == 6 and all(json.loads(r.value)["text"].startswith(r.file) for r in back)
    split = lm.split_by_quantile(spark.createDataFrame([(i, float(i * 37 % 100)) for i in range(100)], "doc_id long, ppl double"))
    corpus.write_split(split, str(tmp_path / "split"))
    rows = [json.loads(x)["ppl"] for f in sorted((tmp_path / "split" / "label=pos").glob("*.json")) for x in f.read_text().splitlines()]
    assert rows == sorted(rows) and len(rows) == 80


def test_store_asks_for_a_shared_folder_off_one_machine(spark):
    from types import SimpleNamespace

    from millrace import store

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        store.shared_dir(far)
    t = store.table(spark.range(5), "dropped")
    files = [f.replace("file://", "") for f in t.inputFiles()]
    assert t.count() == 5 and files
    store.drop(t)
    import os

    assert not any(os.path.exists(f) for f in files)


def test_jobs_take_their_options_from_settings(spark, tmp_path):
    from millrace.settings import Settings

    texts = ["the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dog!", "something else that is long enough"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("".join(json.dumps({"content": t}) + "\n" for t in texts))
    own = Settings().having(corpus=str(tmp_path / "in"), text_col="content", quantile=0.5)
    kept, removed, pairs = flows.run_job(spark, "dedup", own)
    assert kept.count() == 2 and removed.count() == 1 and pairs.count() == 1
    assert flows.run_job(spark, "dedup", own.having(threshold=0.999), method="exact")[1].count() == 0
    assert sorted(r.label for r in flows.run_job(spark, "quality", own).collect()) == ["neg", "neg", "pos"]
    assert len(flows.run_job(spark, "profile", own, metrics=["length"]).first().list_doc_length) == 3
    with pytest.raises(ValueError):
        flows.run_job(spark, "other", own)
