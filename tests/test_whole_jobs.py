"""Registered queries do the whole job: on tables whose texts and ids a cut would tell apart."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from millrace.operators import knowledge, sampling
from millrace.plans import flows, queries


def lay(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_quality_split_ranks_whole_lines(spark, tmp_path):
    texts = {1: "ab " * 500 + "xyzxyz" * 300, 2: "ab " * 700, 3: "ba" * 40, 4: "xyz"}
    lay(spark, tmp_path, "corpus_lines", list(texts.items()), "line_id long, content string")
    counts = {i: Counter("".join(t.split())) for i, t in texts.items()}
    model = sum(counts.values(), Counter())
    base = sum(model.values()) + len(model) + 1
    want = {i: math.exp(-sum(f * math.log((model[w] + 1) / base) for w, f in c.items()) / sum(c.values())) for i, c in counts.items()}
    got = {r.doc_id: r for r in entry.queries()["quality_split"](spark, str(tmp_path)).collect()}
    assert {i: r.ppl for i, r in got.items()} == pytest.approx(want, abs=1e-4)
    assert sorted(got, key=lambda i: got[i]["rank"]) == sorted(want, key=lambda i: (want[i], i))


def test_mtld_measures_whole_documents(spark, tmp_path):
    rare = [f"w{k}" for k in range(512)]
    texts = {1: " ".join(rare + ["same"] * 400), 2: "\n".join(rare[:500] * 3), 3: "one two one"}
    lay(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.mtld for r in entry.queries()["mtld"](spark, str(tmp_path)).collect()}
    assert got == {i: round(knowledge.mtld_of(t.split()), 6) for i, t in texts.items()}
    zh = spark.createDataFrame([("月岚港" * 300,)], "text string")
    assert knowledge.mtld(zh, "zh").first().mtld == pytest.approx(knowledge.mtld_of(list("月岚港" * 300)))
    assert knowledge.mtld(zh, "zh", 9).first().mtld == pytest.approx(knowledge.mtld_of(list("月岚港" * 3)))


def test_corpus_profile_has_all_documents_and_vectors(spark, tmp_path):
    rng = random.Random(2)
    n = 600
    lay(spark, tmp_path, "documents", [(i, "word " * (i + 1)) for i in range(n)] + [(n, None)], "doc_id long, text string")
    lay(spark, tmp_path, "entity_list", [("word", "字词")], "name_en string, name_zh string")
    vecs = [(i, [rng.gauss(0, 1) + (i >= 500) for _ in range(4)], i % 3) for i in range(n)]
    lay(spark, tmp_path, "embeddings", vecs, "vec_id long, embedding array<float>, label int")
    got = entry.queries()["corpus_profile"](spark, str(tmp_path)).first()
    assert got.list_doc_length == [i + 1 for i in range(n)] and len(got.list_mtld_score) == len(got.list_kenlm_ppl) == n
    assert got.list_mtld_score[599] == pytest.approx(knowledge.mtld_of(["word"] * 600))
    assert sum(got.list_cluster_size) == n and len(got.list_cluster_size) > 50 and len(got.list_sim_semantic) == n // 10
    unit = np.array([v for _, v, _ in vecs])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert got.mean_sim_semantic == pytest.approx((unit @ unit.T)[np.triu_indices(n, 1)].mean(), abs=1e-5)


def test_profile_draws_vectors_by_hash(spark):
    vecs = spark.createDataFrame([(i, [1.0, 0.0] if i < 40 else [-1.0, 0.1]) for i in range(400)], "vec_id long, embedding array<float>")
    got = flows.profile(spark.createDataFrame([(1, "a")], "doc_id long, text string"), ["semantic"], n=40, embeddings=vecs).first()
    drawn = {r.vec_id for r in sampling.sample(vecs, 40, 0, "vec_id").collect()}
    few = sum(i < 40 for i in drawn)
    assert few < 40 and got.mean_sim_semantic == pytest.approx((few * (few - 1) / 2 + (40 - few) * (39 - few) / 2 - few * (40 - few) / 1.01**0.5) / 780, abs=1e-5)


def test_batches_have_all_slots_filled_up(spark):
    rng = random.Random(4)
    rows = [(i, None if i % 17 == 0 else chr(97 + i % 26) * rng.choice([3, 20, 60])) for i in range(90)]
    drawn = [t for _, t in sorted((hashlib.md5(f"0:{i}".encode()).hexdigest(), t) for i, t in rows if t is not None)]
    want = {(r % 4, r // 4): t[:30] for r, t in enumerate(drawn[:20])}
    spare = iter(drawn[20:40])
    for slot, batch in sorted((s, b) for b, s in want):
        if len(want[batch, slot]) < 30 and (more := next(spare, None)) is not None:
            want[batch, slot] = f"{want[batch, slot]}\n\n{more}"[:30]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.batch, r.slot): r.text for r in sampling.sample_batches(docs, 4, 5, 30).collect()} == want
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert {(b, s): h for b, s, h in con.sql(queries._batches_sql(4, 5, 30)).fetchall()} == {k: hashlib.md5(t.encode()).hexdigest() for k, t in want.items()}


def test_sample_batches_filled_keeps_short_texts(spark, tmp_path):
    lay(spark, tmp_path, "documents", [(i, "short" if i % 2 else "long " * 200) for i in range(60)], "doc_id long, text string")
    got = entry.queries()["sample_batches_filled"](spark, str(tmp_path)).collect()
    assert len(got) == 60 and sum(r.text_md5 == hashlib.md5(b"short").hexdigest() for r in got) == 30


def test_lsh_pairs_have_links_and_members(spark, tmp_path):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(300)) for _ in range(3)]
    rows = [(1, base[0]), (2, base[0]), (3, base[0] + " end"), (4, base[0] + " end"), (5, base[1]), (6, base[1]), (7, base[2]), (8, "abc"), (9, "abc"), (10, None), (11, None)]
    lay(spark, tmp_path, "documents", rows, "doc_id long, text string")
    got = {(r.lo, r.hi): r for r in entry.queries()["lsh_pairs"](spark, str(tmp_path)).collect()}
    assert {k for k, r in got.items() if r["copy"]} == {(1, 2), (3, 4), (5, 6)} and all(r.sim == 1 for r in got.values() if r["copy"])
    assert {k for k, r in got.items() if not r["copy"]} == {(2, 4)} and 0.8 < got[2, 4].sim < 1
