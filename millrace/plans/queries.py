"""Queries of the corpus operators over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, judge, knowledge, lm, rules, sampling, vectors
from ..sources import corpus
from ..store import shared_dir, table
from ..streaming import stream
from . import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "corpus_lines").select(F.col("line_id").alias("doc_id"), F.col("content").alias("text"))


_W = r"'[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'"
_WORDS = f"list_filter(string_split_regex(text, {_W}), lambda x: x <> '')"
_PARAS = "len(string_split(replace(text, chr(10) || chr(10), chr(10)), chr(10)))"


@query(f"SELECT doc_id, len({_WORDS})::BIGINT AS words FROM documents")
def doc_word_count(spark, folder):
    return read(spark, folder, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query(f"SELECT doc_id, {_PARAS}::BIGINT AS paragraphs FROM documents")
def doc_para_count(spark, folder):
    return read(spark, folder, "documents").select("doc_id", T.para_count(F.col("text")).alias("paragraphs"))


@query(f"SELECT doc_id AS id, len({_WORDS})::BIGINT AS words, {_PARAS}::BIGINT AS paragraphs FROM documents")
def length_profile(spark, folder):
    return flows.length_profile(read(spark, folder, "documents"))


@query(f"WITH t AS (SELECT quantile_cont(len({_WORDS})::BIGINT, [0, 0.25, 0.5, 0.75, 1]) AS q FROM documents WHERE text IS NOT NULL) SELECT q[1] AS p0, q[2] AS p25, q[3] AS p50, q[4] AS p75, q[5] AS p100 FROM t")
def length_percentiles(spark, folder):
    p = read(spark, folder, "documents").agg(F.percentile(T.word_count(F.col("text")), F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("p"))
    return p.select(*(F.col("p")[i].alias(f"p{x}") for i, x in enumerate((0, 25, 50, 75, 100))))


@query(f"SELECT lower(trim(source)) AS source, count(*) AS docs, sum(length(text))::BIGINT AS chars, sum(len({_WORDS}))::BIGINT AS words FROM documents GROUP BY 1")
def corpus_totals(spark, folder):
    d = read(spark, folder, "documents")
    return d.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"), F.sum(T.word_count(F.col("text"))).alias("words"))


def _md5_of(fn):
    def run(spark, folder):
        return read(spark, folder, "documents").select("doc_id", F.md5(fn(F.col("text"))).alias("text_md5"))

    return run


for _name, _fn, _sql in (
    ("truncate_words", lambda t: T.truncate_words(t, 20), f"array_to_string(({_WORDS})[1:20], ' ')"),
    ("truncate_single_space", lambda t: T.truncate_spaces(t, 20), "array_to_string(string_split(text, ' ')[1:20], ' ')"),
    ("char_space", T.char_space, "regexp_replace(regexp_replace(text, '(?s)(.)', '\\1 ', 'g'), '(?s) $', '')"),
    ("char_truncate", lambda t: T.char_truncate(t, 100), "left(text, 100)"),
    ("normalise_space", T.normalise_space, f"array_to_string({_WORDS}, ' ')"),
):
    QUERIES[_name] = _md5_of(_fn)
    SQL[_name] = f"SELECT doc_id, md5({_sql}) AS text_md5 FROM documents"

_GRAMS = """WITH t AS (SELECT line_id AS doc_id, content AS text FROM corpus_lines WHERE content IS NOT NULL),
g AS (SELECT DISTINCT doc_id, substr(text, i::INT, 5) AS g FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text) - 3, 1))) AS i FROM t)),
k AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
pairs AS (SELECT lo, hi, c / (a.n + b.n - c) AS sim FROM (SELECT x.doc_id AS lo, y.doc_id AS hi, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
  JOIN k a ON a.doc_id = lo JOIN k b ON b.doc_id = hi WHERE c / (a.n + b.n - c) > 0.8::DOUBLE)
"""


@query("SELECT line_id AS doc_id, len(list_distinct([substr(content, i::INT, 5) for i in range(1, greatest(length(content) - 3, 1))]))::BIGINT AS shingles FROM corpus_lines WHERE content IS NOT NULL")
def shingle_count(spark, folder):
    return _lines(spark, folder).where("text is not null").select("doc_id", F.size(T.shingles(F.col("text"))).cast("long").alias("shingles"))


@query(_GRAMS + "SELECT lo, hi, round(sim, 6) AS sim FROM pairs")
def jaccard_pairs(spark, folder):
    lines = _lines(spark, folder)
    found = dedup.verify_pairs(dedup.candidate_pairs(lines, "exact"), lines)
    return found.select("lo", "hi", F.round("sim", 6).alias("sim"))


@query(_GRAMS + "SELECT lo, hi FROM pairs UNION ALL SELECT hi, lo FROM pairs")
def jaccard_both_orders(spark, folder):
    lines = _lines(spark, folder)
    return dedup.both_orders(dedup.verify_pairs(dedup.candidate_pairs(lines, "exact"), lines)).select("lo", "hi")


@query(_GRAMS + "SELECT DISTINCT lo AS doc_id FROM pairs")
def dedup_removed(spark, folder):
    return dedup.deduplicate(_lines(spark, folder), method="exact")[1].select("doc_id")


@query(_GRAMS + "SELECT line_id AS doc_id FROM corpus_lines WHERE line_id NOT IN (SELECT lo FROM pairs)")
def dedup_kept(spark, folder):
    return dedup.deduplicate(_lines(spark, folder), method="exact")[0].select("doc_id")


@query(_GRAMS + ", r AS (SELECT count(DISTINCT lo) AS gone FROM pairs), n AS (SELECT count(*) AS total FROM corpus_lines) SELECT total, total - gone AS kept, round((total - gone) / total, 6) AS ratio, round((total - gone) / (total + 1), 6) AS ratio_compat FROM r, n")
def dedup_ratio(spark, folder):
    lines = _lines(spark, folder)
    r = dedup.kept_ratio(lines, dedup.deduplicate(lines, method="exact")[0])
    return r.select("total", "kept", F.round("ratio", 6).alias("ratio"), F.round("ratio_compat", 6).alias("ratio_compat"))


@query(_GRAMS + "SELECT count(*) AS pairs, count(DISTINCT lo) AS removed FROM pairs")
def dedup_counts(spark, folder):
    lines = _lines(spark, folder)
    p = dedup.verify_pairs(dedup.candidate_pairs(lines, "exact"), lines)
    return p.agg(F.count("*").alias("pairs"), F.countDistinct("lo").alias("removed"))


@query(_GRAMS.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + """, both_ways AS (SELECT lo AS a, hi AS b FROM pairs UNION SELECT hi, lo FROM pairs), reach AS (SELECT a AS id, a AS low FROM both_ways UNION SELECT e.b, r.low FROM reach r JOIN both_ways e ON e.a = r.id AND r.low < e.b)
SELECT id, min(low) AS root FROM reach GROUP BY id""")
def dedup_components(spark, folder):
    lines = _lines(spark, folder)
    return dedup.components(dedup.verify_pairs(dedup.candidate_pairs(lines, "exact"), lines))


@query(_GRAMS + "SELECT lo, hi, round(sim, 6) AS sim FROM pairs")
def lsh_recall(spark, folder):
    """All pairs by the bands at their defaults, copies not collapsed: equal to the exact pairs where none is missed."""
    lines = _lines(spark, folder)
    return dedup.verify_pairs(dedup.candidate_pairs(lines), lines).select("lo", "hi", F.round("sim", 6).alias("sim"))


@query()
def lsh_pairs(spark, folder):
    """Default path at scale: 100 seeds in 20 bands, copies collapsed, similarity verified.

    Links between representatives, and with ``copy`` the membership of every other record: (id, rep) of equal texts that have shingles.
    """
    own, spare = dedup.collapsed(read(spark, folder, "documents"))
    links = dedup.verify_pairs(dedup.candidate_pairs(own, "lsh"), own).select("lo", "hi", F.round("sim", 6).alias("sim"), F.lit(False).alias("copy"))
    return links.unionByName(spare.where("chars >= 5").select(F.col("id").alias("lo"), F.col("rep").alias("hi"), F.lit(1.0).alias("sim"), F.lit(True).alias("copy")))


_SEEDS, _BANDS = 12, 4


def _lsh_sql() -> str:
    mins = ", ".join(f"min(({a}::BIGINT * h + {b}) % 2147483647) AS m{i}" for i, (a, b) in enumerate(dedup.coefficients(_SEEDS)))
    rows = _SEEDS // _BANDS
    bands = " UNION ALL ".join(f"SELECT doc_id, {b} AS band, " + " || ',' || ".join(f"m{b * rows + i}" for i in range(rows)) + " AS bucket FROM f" for b in range(_BANDS))
    return (
        "WITH t AS (SELECT line_id AS doc_id, content AS text FROM corpus_lines WHERE content IS NOT NULL),"
        " g AS (SELECT DISTINCT doc_id, substr(text, i::INT, 5) AS g FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text) - 3, 1))) AS i FROM t)),"
        " h AS (SELECT doc_id, ('0x' || substr(md5(g), 1, 7))::BIGINT AS h FROM g),"
        f" f AS (SELECT doc_id, {mins} FROM h GROUP BY 1), b AS ({bands})"
        " SELECT DISTINCT x.doc_id AS lo, y.doc_id AS hi FROM b x JOIN b y ON x.band = y.band AND x.bucket = y.bucket AND x.doc_id < y.doc_id"
    )


@query(_lsh_sql())
def lsh_candidates(spark, folder):
    return dedup.lsh_candidates(dedup.lsh_bands(dedup.minhash(_lines(spark, folder), _SEEDS, method="sql"), _BANDS, _SEEDS))


@query("SELECT j / 20.0::DOUBLE AS similarity, round(1 - pow(1 - pow(j / 20.0::DOUBLE, 20), 10), 6) AS s200_b10, round(1 - pow(1 - pow(j / 20.0::DOUBLE, 10), 15), 6) AS s150_b15, round(1 - pow(1 - pow(j / 20.0::DOUBLE, 5), 20), 6) AS s100_b20 FROM range(0, 21) r(j)")
def recall_curve(spark, folder):
    s = (F.col("id") / 20.0).alias("similarity")
    curve = spark.range(21).select(s)
    return curve.select("similarity", *(F.round(T.recall_prob(F.col("similarity"), n, b), 6).alias(f"s{n}_b{b}") for n, b in ((200, 10), (150, 15), (100, 20))))


@query("SELECT file_path AS file, count(*) AS lines, (coalesce(sum(count(*)) OVER (ORDER BY count(*) DESC, file_path DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first_id FROM corpus_lines GROUP BY file_path")
def file_index(spark, folder):
    return corpus.file_index(read(spark, folder, "corpus_lines"), "file_path")


@query("SELECT doc_id FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 500")
def sample_hash(spark, folder):
    return sampling.sample(read(spark, folder, "documents"), 500).select("doc_id")


@query("WITH t AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) - 1 AS r FROM documents WHERE text IS NOT NULL) SELECT (r % 8)::BIGINT AS batch, (r // 8)::BIGINT AS slot, md5(left(text, 200)) AS text_md5 FROM t WHERE r < 128 AND length(text) >= 200")
def sample_batches(spark, folder):
    b = sampling.sample_batches(read(spark, folder, "documents"), 8, 16, 200)
    whole = read(spark, folder, "documents").where("length(text) >= 200").select(F.md5(F.substring("text", 1, 200)).alias("text_md5")).distinct()
    return b.select("batch", "slot", F.md5("text").alias("text_md5")).join(whole, "text_md5", "left_semi").select("batch", "slot", "text_md5")


def _batches_sql(count: int, size: int, chars: int) -> str:
    slots = count * size
    return (
        "WITH t AS (SELECT text, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) - 1 AS r FROM documents WHERE text IS NOT NULL),"
        f" s AS (SELECT r % {count} AS batch, r // {count} AS slot, left(text, {chars}) AS text FROM t WHERE r < {slots}),"
        f" k AS (SELECT batch, slot, row_number() OVER (ORDER BY slot, batch) AS k FROM s WHERE length(text) < {chars}),"
        f" m AS (SELECT batch, slot, t.text AS more FROM k JOIN t ON t.r = {slots} + k.k - 1 WHERE t.r < {2 * slots})"
        f" SELECT batch::BIGINT AS batch, slot::BIGINT AS slot, md5(CASE WHEN more IS NULL THEN s.text ELSE left(s.text || chr(10) || chr(10) || more, {chars}) END) AS text_md5"
        " FROM s LEFT JOIN m USING (batch, slot)"
    )


@query(_batches_sql(50, 512, 512))
def sample_batches_filled(spark, folder):
    """All slots, those that were filled up too, at the reference's 50 batches of 512 texts of 512 characters."""
    return sampling.sample_batches(read(spark, folder, "documents"), 50, 512, 512).select("batch", "slot", F.md5("text").alias("text_md5"))


_RULED = "SELECT doc_id, source, text, regexp_replace(regexp_replace(text, '[0-9]+', '', 'g'), '\n{2,}', chr(10), 'g') AS t FROM documents"


@query(f"SELECT doc_id, md5(t) AS text_md5 FROM ({_RULED}) WHERE t <> ''")
def rule_filter(spark, folder):
    return rules.apply_rules(read(spark, folder, "documents"), ["strip_digits", "collapse_blank_lines"]).select("doc_id", F.md5("text").alias("text_md5"))


@query(f"SELECT source, count(*) AS line_count, count(*) FILTER (t <> '') AS write_count, round(coalesce(sum(CASE WHEN t <> '' THEN length(t) / length(text) END), 0) / (count(*) FILTER (t <> '') + 1e-6::DOUBLE), 6) AS edit_rate FROM ({_RULED}) GROUP BY source")
def rule_metrics(spark, folder):
    m = rules.rule_metrics(read(spark, folder, "documents"), ["strip_digits", "collapse_blank_lines"], by="source")
    return m.withColumn("edit_rate", F.round("edit_rate", 6))


@query(f"SELECT source, min(len({_WORDS}))::BIGINT AS least FROM documents WHERE len({_WORDS}) >= 5 GROUP BY source")
def python_rule_filter(spark, folder):
    """A plain function as a rule: texts of fewer than five words become empty and are dropped."""
    long_ = rules.python_rule(lambda t: t if len(t.split()) >= 5 else "")
    kept = rules.apply_rules(read(spark, folder, "documents"), [long_])
    return kept.groupBy("source").agg(F.min(T.word_count(F.col("text"))).alias("least"))


def _uniform_sql(i: int) -> str:
    return f"('0x' || substr(md5('0:{i}:' || line_id), 1, 7))::BIGINT / 268435456.0::DOUBLE"


_K = f"1 + CASE WHEN {_uniform_sql(1)} > 0.5 THEN 0 WHEN {_uniform_sql(2)} > 0.5 THEN 1 WHEN {_uniform_sql(3)} > 0.5 THEN 2 ELSE 3 END"


@query(f"SELECT line_id, ({_K})::BIGINT AS n_rounds, md5(left(content, greatest(length(content) - ({_K}), 0)::BIGINT)) AS text_md5 FROM corpus_lines")
def contaminate(spark, folder):
    lines = read(spark, folder, "corpus_lines").select("line_id", "content")
    bad = rules.contaminate(lines, lambda t: F.substring(t, F.lit(1), F.greatest(F.length(t) - 1, F.lit(0))), 0.5, 3, 0, "line_id", "content")
    return bad.select("line_id", F.col("n_rounds").cast("long").alias("n_rounds"), F.md5("content").alias("text_md5"))


_PPL = "SELECT line_id, min(ppl) AS ppl FROM ppl_scores WHERE ppl > 0 AND ppl < 'infinity'::DOUBLE AND NOT isnan(ppl) GROUP BY 1"


@query(f"WITH s AS ({_PPL}), r AS (SELECT *, row_number() OVER (ORDER BY ppl, line_id) AS rank, count(*) OVER () AS n FROM s) SELECT line_id, ppl, rank, CASE WHEN rank <= floor(n * 0.8::DOUBLE) THEN 'pos' ELSE 'neg' END AS label FROM r")
def ppl_split(spark, folder):
    s = read(spark, folder, "ppl_scores").where("ppl > 0 and ppl < double('infinity') and not isnan(ppl)").groupBy("line_id").agg(F.min("ppl").alias("ppl"))
    return lm.split_by_quantile(s, "ppl", 0.8, "line_id").select("line_id", "ppl", "rank", "label")


@query(
    f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT w, count(*) AS n FROM w GROUP BY 1),
    b AS (SELECT (sum(n) + count(*) + 1)::DOUBLE AS b FROM c), f AS (SELECT doc_id, w, count(*) AS f FROM w GROUP BY 1, 2)
    SELECT doc_id, round(exp(-sum(f * ln((n + 1) / b)) / sum(f)), 4) AS ppl FROM f JOIN c USING (w), b GROUP BY doc_id"""
)
def unigram_perplexity(spark, folder):
    d = read(spark, folder, "documents").select("doc_id", "text")
    counts = table(lm.unigrams(d), "unigrams")
    scored = lm.perplexity(d, lm.unigram_scorer(counts), truncation=None)
    return scored.where("ppl is not null").select("doc_id", F.round("ppl", 4).alias("ppl"))


_CHARS = f"list_filter(string_split(regexp_replace(content, {_W}, '', 'g'), ''), lambda x: x <> '')"


@query(
    f"""WITH w AS (SELECT line_id AS doc_id, unnest({_CHARS}) AS w FROM corpus_lines WHERE content IS NOT NULL), c AS (SELECT w, count(*) AS n FROM w GROUP BY 1),
    b AS (SELECT (sum(n) + count(*) + 1)::DOUBLE AS b FROM c), f AS (SELECT doc_id, w, count(*) AS f FROM w GROUP BY 1, 2)
    SELECT doc_id, round(exp(-sum(f * ln((n + 1) / b)) / sum(f)), 4) AS ppl FROM f JOIN c USING (w), b GROUP BY doc_id"""
)
def char_perplexity(spark, folder):
    """The scores that quality_split ranks."""
    lines = _lines(spark, folder)
    counts = table(lm.unigrams(lines, unit="char"), "unigrams")
    scored = lm.perplexity(lines, lm.unigram_scorer(counts), unit="char", truncation=None)
    return scored.where("ppl is not null").select("doc_id", F.round("ppl", 4).alias("ppl"))


#: A bigram model small enough to repeat in SQL: words and pairs with log10 probability and back-off weight.
_UNI = {"<unk>": (-2.0, 0.0), "<s>": (-99.0, -0.25), "</s>": (-1.5, 0.0), "the": (-1.25, -0.5), "of": (-1.75, -0.125), "de": (-1.5, -0.375)}
_BI = {("<s>", "the"): -0.5, ("of", "the"): -0.25, ("the", "</s>"): -2.25, ("de", "de"): -3.0}


def _arpa_text() -> str:
    ones = [f"{p}\t{w}\t{b}" for w, (p, b) in _UNI.items()]
    twos = [f"{p}\t{a} {b}" for (a, b), p in _BI.items()]
    return "\n".join(["\\data\\", f"ngram 1={len(ones)}", f"ngram 2={len(twos)}", "", "\\1-grams:", *ones, "", "\\2-grams:", *twos, "", "\\end\\"])


def _arpa_sql() -> str:
    u = ", ".join(f"('{w}', {p}::DOUBLE, {b}::DOUBLE)" for w, (p, b) in _UNI.items())
    g = ", ".join(f"('{a}', '{b}', {p}::DOUBLE)" for (a, b), p in _BI.items())
    return f"""WITH u(w, p, b) AS (VALUES {u}), g(a, c, p) AS (VALUES {g}),
    t AS (SELECT doc_id, list_concat(['<s>'], {_WORDS}, ['</s>']) AS t FROM documents WHERE text IS NOT NULL),
    x AS (SELECT doc_id, unnest(range(2, len(t) + 1)) AS i, t FROM t), s AS (SELECT doc_id, t[i - 1] AS a, t[i] AS c FROM x),
    k AS (SELECT doc_id, CASE WHEN ua.w IS NULL THEN '<unk>' ELSE s.a END AS a, CASE WHEN uc.w IS NULL THEN '<unk>' ELSE s.c END AS c FROM s LEFT JOIN u ua ON ua.w = s.a LEFT JOIN u uc ON uc.w = s.c)
    SELECT doc_id, round(pow(10, -sum(coalesce(g.p, ua.b + uc.p)) / count(*)), 4) AS ppl FROM k LEFT JOIN g ON g.a = k.a AND g.c = k.c JOIN u ua ON ua.w = k.a JOIN u uc ON uc.w = k.c GROUP BY doc_id"""


@query(_arpa_sql())
def arpa_perplexity(spark, folder):
    """Perplexity by a back-off model in ARPA text, over whole documents."""
    scored = lm.perplexity(read(spark, folder, "documents").where("text is not null"), lm.arpa_scorer(text=_arpa_text()), truncation=None)
    return scored.select("doc_id", F.round("ppl", 4).alias("ppl"))


@query()
def quality_split(spark, folder):
    lines = read(spark, folder, "corpus_lines").select(F.col("line_id").alias("doc_id"), F.col("content").alias("text"))
    counts = table(lm.unigrams(lines, unit="char"), "unigrams")
    return flows.quality_split(lines, lm.unigram_scorer(counts), truncation=None).select("doc_id", F.round("ppl", 4).alias("ppl"), "rank", "label")


_ONE, _NIL = "contains(coalesce(response, ''), '1')", "contains(coalesce(response, ''), '0')"


@query(f"SELECT verdict_id, 'pos' AS verdict FROM judge_verdicts WHERE {_ONE} AND NOT {_NIL} UNION ALL SELECT verdict_id, 'neg' FROM judge_verdicts WHERE {_NIL} AND NOT {_ONE}")
def verdict_strict(spark, folder):
    return judge.verdicts(read(spark, folder, "judge_verdicts")).select("verdict_id", "verdict")


@query(f"SELECT verdict_id, 'pos' AS verdict FROM judge_verdicts WHERE {_ONE} UNION ALL SELECT verdict_id, 'neg' FROM judge_verdicts WHERE {_NIL}")
def verdict_as_written(spark, folder):
    return judge.verdicts(read(spark, folder, "judge_verdicts"), strict=False).select("verdict_id", "verdict")


@query(f"SELECT line_id AS doc_id, CASE WHEN len({_WORDS}) % 2 = 0 THEN 'pos' ELSE 'neg' END AS verdict FROM (SELECT line_id, content AS text FROM corpus_lines WHERE content IS NOT NULL)")
def judged(spark, folder):
    """The whole way with an injected judge that says 1 to texts of an even number of words."""
    asked = judge.prompts(_lines(spark, folder).where("text is not null"), "Is this good prose?", truncation=1_000_000)

    def even(prompt: str) -> str:
        return "1" if len(prompt.split("'''", 1)[1].rsplit("'''", 1)[0].split()) % 2 == 0 else "0"

    return judge.verdicts(judge.ask(asked, even)).select("doc_id", "verdict")


_ENTITIES = "e AS (SELECT DISTINCT name_en AS entity FROM entity_list WHERE length(name_en) > 1), m AS (SELECT doc_id, entity FROM documents, e WHERE contains(' ' || lower(text) || ' ', ' ' || lower(entity) || ' '))"


def _entities(spark: SparkSession, folder: str, lang: str = "en") -> DataFrame:
    return corpus.entities(read(spark, folder, "entity_list"), lang)


@query(f"WITH {_ENTITIES} SELECT entity, count(*) AS df FROM m GROUP BY 1")
def entity_df(spark, folder):
    return knowledge.entity_counts(knowledge.mentions(read(spark, folder, "documents"), _entities(spark, folder)))


@query(f"WITH {_ENTITIES} SELECT (SELECT count(*) FROM m) AS mentions, sum(len({_WORDS}))::BIGINT AS size, round((SELECT count(*) FROM m) / (sum(len({_WORDS})) + 1e-9::DOUBLE), 6) AS density FROM documents")
def knowledge_density(spark, folder):
    return knowledge.knowledge_density(read(spark, folder, "documents"), _entities(spark, folder)).withColumn("density", F.round("density", 6))


@query("WITH e AS (SELECT DISTINCT name_zh AS entity FROM entity_list WHERE length(name_zh) > 1) SELECT entity, count(*) AS df FROM documents, e WHERE contains(text, entity) GROUP BY 1")
def entity_df_zh(spark, folder):
    return knowledge.entity_counts(knowledge.mentions(read(spark, folder, "documents"), _entities(spark, folder, "zh"), "char"))


@query("WITH e AS (SELECT DISTINCT name_zh AS entity FROM entity_list WHERE length(name_zh) > 1), m AS (SELECT doc_id, entity FROM documents, e WHERE contains(text, entity)) SELECT (SELECT count(*) FROM m) AS mentions, sum(length(text))::BIGINT AS size, round((SELECT count(*) FROM m) / (sum(length(text)) + 1e-9::DOUBLE), 6) AS density FROM documents")
def knowledge_density_zh(spark, folder):
    return knowledge.knowledge_density(read(spark, folder, "documents"), _entities(spark, folder, "zh"), "char").withColumn("density", F.round("density", 6))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT (SELECT count(*) FROM v) AS vectors, count(*) AS pairs, round(avg(list_cosine_similarity(a.e, b.e)), 6) AS mean_cosine FROM v a JOIN v b ON a.vec_id < b.vec_id")
def cosine_pairs_summary(spark, folder):
    return vectors.mean_cosine(read(spark, folder, "embeddings")).withColumn("mean_cosine", F.round("mean_cosine", 6))


@query()
def semantic_pairs(spark, folder):
    v = read(spark, folder, "embeddings")
    n = v.count()
    return vectors.pair_cosines(v, n // 10).withColumn("sim", F.round("sim", 6))


@query(
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), c AS (SELECT label, d, avg(x) AS c FROM x GROUP BY 1, 2),
    f AS (SELECT label, vec_id, sqrt(sum((x - c) * (x - c))) AS dist FROM x JOIN c USING (label, d) GROUP BY 1, 2)
    SELECT label AS cluster, arg_min(vec_id, dist) AS medoid, count(*) AS size, round(min(dist), 6) AS dist FROM f GROUP BY label"""
)
def cluster_medoids(spark, folder):
    m = vectors.medoids(read(spark, folder, "embeddings"), cluster_col="label")
    return m.withColumn("dist", F.round("dist", 6))


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, e FROM v ORDER BY vec_id LIMIT 10),
    a0 AS (SELECT v.vec_id, min({'d': list_distance(v.e, c0.e), 'k': k}).k AS k FROM v, c0 GROUP BY 1),
    m AS (SELECT k, d, avg(x) AS m FROM (SELECT k, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM a0 JOIN v USING (vec_id)) GROUP BY 1, 2), c1 AS (SELECT k, list(m ORDER BY d) AS e FROM m GROUP BY 1)
    SELECT v.vec_id, min({'d': list_distance(v.e, c1.e), 'k': k}).k::INT AS cluster FROM v, c1 GROUP BY 1"""
)
def kmeans_round(spark, folder):
    """One round from a given start: the ten vectors of the smallest ids."""
    v = read(spark, folder, "embeddings")
    start = [list(r.embedding) for r in v.orderBy("vec_id").limit(10).collect()]
    return vectors.kmeans(v, 10, 1, start=start).select("vec_id", F.col("cluster").cast("int").alias("cluster"))


@query()
def kmeans_clusters(spark, folder):
    return vectors.kmeans(read(spark, folder, "embeddings"), 100).groupBy("cluster").agg(F.count("*").alias("size"))


@query(
    """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), h AS (SELECT label, d, avg(x * x) AS h FROM x GROUP BY 1, 2),
    p AS (SELECT a.label AS i, b.label AS j, a.h / (a.h + b.h + 1e-8::DOUBLE) AS u, b.h / (a.h + b.h + 1e-8::DOUBLE) AS v FROM h a JOIN h b ON a.d = b.d AND a.label < b.label),
    s AS (SELECT i, j, 1 - sum(u * v) / (sqrt(sum(u * u)) * sqrt(sum(v * v))) AS dist FROM p GROUP BY 1, 2)
    SELECT count(*) AS pairs, round(avg(dist), 6) AS mean, round(stddev_samp(dist), 6) AS spread FROM s WHERE dist <> 0"""
)
def batch_diversity(spark, folder):
    d = vectors.batch_diversity(vectors.hessians(read(spark, folder, "embeddings")), variance="std")
    return d.select("pairs", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


@query()
def mtld(spark, folder):
    return knowledge.mtld(read(spark, folder, "documents").where("text is not null")).select("doc_id", F.round("mtld", 6).alias("mtld"))


@query()
def corpus_profile(spark, folder):
    v = read(spark, folder, "embeddings")
    return flows.profile(read(spark, folder, "documents"), n=None, entities=_entities(spark, folder), embeddings=v)


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, fetched_at) AS DATE)::VARCHAR AS day, source, count(*) AS docs FROM documents WHERE fetched_at IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2")
def docs_by_day(spark, folder):
    """The batch form of the streaming count."""
    d = read(spark, folder, "documents").where("fetched_at is not null and source is not null")
    w = d.groupBy(F.window("fetched_at", "1 day").alias("w"), "source").agg(F.count("*").alias("docs"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "source", "docs")


@query(f"SELECT line_id, md5(t) AS text_md5 FROM (SELECT line_id, regexp_replace(content, '[0-9]+', '', 'g') AS t FROM corpus_lines) WHERE t <> ''")
def stream_rule_filter(spark, folder):
    """The rule filter on a stream of the table's files, run to its end."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    one = read(spark, folder, "corpus_lines").select("line_id", "content", "ingested_at")
    one.write.parquet(f"{base}/in")
    live = stream.read_stream(spark, f"{base}/in", one.schema)
    stream.run_once(stream.filter_stream(live, ["strip_digits"], "content").select("line_id", F.md5("content").alias("text_md5")), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out")
