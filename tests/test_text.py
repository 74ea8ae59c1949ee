import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as T

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXTS = st.lists(st.text(alphabet=st.sampled_from(list("ab c\n\t . 　​ é中\U0001f600")), max_size=24), min_size=1, max_size=30)


def column(spark, values, fn):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[1] for r in spark.createDataFrame(rows, "i int, t string").select("i", fn(F.col("t"))).orderBy("i").collect()]


def grams(t, n):
    return {t[i : i + n] for i in range(len(t) - n + 1)}


@given(TEXTS)
@SETTINGS
def test_words_equal_python(spark, values):
    assert column(spark, values, T.word_count) == [len(v.split()) for v in values]
    assert column(spark, values, T.normalise_space) == [" ".join(v.split()) for v in values]
    assert column(spark, values, lambda t: T.truncate_words(t, 3)) == [" ".join(v.split()[:3]) for v in values]


@given(TEXTS)
@SETTINGS
def test_cuts_equal_python(spark, values):
    assert column(spark, values, lambda t: T.truncate_spaces(t, 2)) == [" ".join(v.split(" ")[:2]) for v in values]
    assert column(spark, values, T.char_space) == [" ".join(v) for v in values]
    assert column(spark, values, lambda t: T.char_truncate(t, 5)) == [v[:5] for v in values]
    assert column(spark, values, T.para_count) == [len(v.replace("\n\n", "\n").split("\n")) for v in values]


@given(TEXTS)
@SETTINGS
def test_shingles_equal_python(spark, values):
    for n in (1, 5):
        assert [set(x) for x in column(spark, values, lambda t, n=n: T.shingles(t, n))] == [grams(v, n) for v in values]


@pytest.mark.parametrize("text, words, paras", [("", 0, 1), ("  a b ", 2, 1), ("a b　c", 3, 1), ("a​b", 1, 1), ("a\n\nb", 2, 2), ("a\n\n\nb", 2, 3), ("a\n\n\n\nb", 2, 3), (None, None, None)])
def test_counts(spark, text, words, paras):
    assert column(spark, [text], T.word_count) == [words]
    assert column(spark, [text], T.para_count) == [paras]


def test_long_text(spark):
    assert column(spark, ["word " * 200_000], T.word_count) == [200_000]


def test_jaccard_edges(spark):
    rows = spark.createDataFrame([("abcdef", "abcdef"), ("abcdef", "abcdeX"), ("abc", "abd"), ("abcdefgh", "abcdefghi"), (None, "abcdef")], "a string, b string")
    got = [r[0] for r in rows.select(T.jaccard_sim(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, pytest.approx(1 / 3), None, 0.8, None]


def test_recall(spark):
    got = spark.range(1).select(T.recall_prob(F.lit(0.8), 200, 10), T.recall_prob(F.lit(0.8), 100, 20)).first()
    assert got[0] == pytest.approx(0.1095, abs=1e-4) and got[1] == pytest.approx(0.9996, abs=1e-4)


def test_cosine_of_zero_vector(spark):
    got = spark.range(1).select(T.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))).first()
    assert got[0] == 0.0
