import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions.numeric import erfc, erfc_sql, stars
from quillspark.operators import agg, stats

LIKERT = {
    "q17": {"human": (461, 143, 171, 54), "gemma": (21, 384, 308, 115), "gpt-oss": (1, 0, 354, 470), "llama": (11, 79, 252, 489), "qwen": (0, 0, 326, 505)},
    "q18": {"human": (387, 134, 180, 38), "gemma": (320, 419, 0, 0), "gpt-oss": (105, 383, 242, 3), "llama": (267, 257, 169, 46), "qwen": (17, 49, 632, 41)},
    "q19": {"human": (260, 157, 263, 59), "gemma": (1, 607, 130, 0), "gpt-oss": (125, 313, 291, 4), "llama": (183, 174, 293, 89), "qwen": (22, 39, 598, 80)},
}
STATISTIC = {
    "q17": {"gemma": 573.071450, "gpt-oss": 995.052918, "llama": 811.465944, "qwen": 1016.204938},
    "q18": {"gemma": 371.230015, "gpt-oss": 320.526634, "llama": 61.820053, "qwen": 630.062096},
    "q19": {"gemma": 626.077470, "gpt-oss": 148.525432, "llama": 21.956645, "qwen": 405.421351},
}


def test_erfc_is_precise_far_into_the_tail(spark):
    xs = [0.0, 1e-9, 0.1, 0.5, 0.84, 0.85, 1.0, 1.24, 1.26, 2.0, 2.85, 2.86, 5.0, 10.0, 20.0, 22.3, 26.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("a"), F.expr(erfc_sql("x")).alias("b")).collect()
    for r in got:
        assert math.isclose(r.a, math.erfc(r.x), rel_tol=2e-13) and math.isclose(r.b, r.a, rel_tol=1e-12)


def test_chi_square_of_known_counts(spark):
    rows = [(q, d, o, n) for q, by in LIKERT.items() for d, c in by.items() for o, n in enumerate(c, 1)]
    got = stats.chi_square(spark.createDataFrame(rows, "question string, dataset string, option int, n long")).collect()
    assert len(got) == 12
    for r in got:
        x = STATISTIC[r.question][r.dataset]
        assert abs(r.statistic - x) < 1e-5 and r.dof == 3
        assert math.isclose(r.p, math.erfc(math.sqrt(r.statistic / 2)) + math.sqrt(2 * r.statistic / math.pi) * math.exp(-r.statistic / 2), rel_tol=1e-11)
    assert min(r.p for r in got) < 1e-200


def test_chi_square_drops_empty_categories(spark):
    rows = [("q", "human", 1, 5), ("q", "human", 2, 7), ("q", "human", 3, 0), ("q", "x", 1, 6), ("q", "x", 2, 2), ("q", "x", 3, 0), ("q", "y", 1, 0), ("q", "y", 2, 0), ("q", "y", 3, 0)]
    got = {r.dataset: r for r in stats.chi_square(spark.createDataFrame(rows, "question string, dataset string, option int, n long")).collect()}
    assert got["x"].dof == 1 and 0 < got["x"].p < 1 and got["y"].p is None


def test_bh_by_hand(spark):
    df = spark.createDataFrame([("f", 1, 0.01), ("f", 2, None), ("f", 3, 0.04), ("f", 4, 0.03), ("g", 1, math.nan)], "family string, i int, p double")
    got = {(r.family, r.i): r.p_adj for r in stats.bh_adjust(df, ("family",), ties=("i",)).collect()}
    assert got["f", 1] == pytest.approx(0.04) and got["f", 2] == 1 and got["f", 3] == got["f", 4] == pytest.approx(0.16 / 3) and got["g", 1] == 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=30))
def test_bh_is_monotone_and_no_smaller(spark, ps):
    got = stats.bh_adjust(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), ties=("i",)).collect()
    assert all(r.p_adj >= r.p - 1e-15 and r.p_adj <= 1 for r in got)
    order = sorted(got, key=lambda r: r.p)
    assert all(a.p_adj <= b.p_adj + 1e-15 for a, b in zip(order, order[1:]))


def test_mann_whitney_full_separation(spark):
    rows = [("q", "human", float(i)) for i in range(500)] + [("q", "x", float(i + 1000)) for i in range(500)]
    got = stats.mann_whitney(spark.createDataFrame(rows, "question string, dataset string, value double")).first()
    assert math.isclose(got.p, 5.85624291350e-165, rel_tol=1e-9)


def test_exact_mann_whitney_by_enumeration(spark):
    rnd = random.Random(1)
    for n1, n2 in ((3, 3), (4, 6), (5, 9)):
        x = rnd.sample(range(100), n1 + n2)
        a, b = x[:n1], x[n1:]
        u = lambda s, t: sum(i > j for i in s for j in t)
        top = max(u(a, b), u(b, a))
        every = [u(c, [v for v in x if v not in c]) for c in itertools.combinations(x, n1)]
        want = min(1.0, 2 * sum(v >= top for v in every) / len(every))
        rows = [("q", "human", float(v)) for v in a] + [("q", "s", float(v)) for v in b]
        got = stats.mann_whitney(spark.createDataFrame(rows, "question string, dataset string, value double")).first()
        assert math.isclose(got.p, want, rel_tol=1e-12)


def test_mann_whitney_guards(spark):
    rows = [("q", "human", 1.0)] * 4 + [("q", "few", 2.0)] * 2 + [("q", "same", 1.0)] * 4 + [("q", "odd", math.nan), ("q", "odd", math.inf), ("q", "odd", None)]
    got = {r.dataset: r.p for r in stats.mann_whitney(spark.createDataFrame(rows, "question string, dataset string, value double")).collect()}
    assert got == {"few": None, "same": 1.0}


def test_entropy_and_shares(spark):
    rows = [("a", "x"), ("b", "x"), ("b", "x"), ("c", "x"), ("c", "y"), ("d", None)]
    got = {r.dataset: r.entropy for r in agg.normalized_entropy(spark.createDataFrame(rows, "dataset string, key string"), ("dataset",)).collect()}
    assert got["a"] is None and got["b"] == 0 and abs(got["c"] - 1) < 1e-9
    share = {r.dataset: r.unique_pct for r in agg.distinct_share(spark.createDataFrame(rows, "dataset string, key string"), ("dataset",)).collect()}
    assert share == {"a": 100, "b": 50, "c": 100, "d": None}


def test_proportions_fill_zeros(spark):
    got = agg.proportions(spark.createDataFrame([("q", "h", 1), ("q", "h", 1), ("q", "h", 3), ("q", "x", None)], "question string, dataset string, score int")).collect()
    assert {(r.dataset, r.option): (r.n, round(r.prop, 3)) for r in got} == {("h", 1): (2, 0.667), ("h", 2): (0, 0), ("h", 3): (1, 0.333), ("h", 4): (0, 0), **{("x", o): (0, 0) for o in range(1, 5)}}


def test_stars_and_row_mean(spark):
    df = spark.createDataFrame([(0.001, 1, None, 4), (0.0009, None, None, None), (0.05, 2, 3, 4), (None, 1, 1, 1), (0.04, 0, 0, 0)], "p double, a int, b int, c int")
    got = df.select(stars(F.col("p")).alias("s"), agg.row_mean([F.col(c) for c in "abc"]).alias("m")).collect()
    assert [(r.s, r.m) for r in got] == [("**", 2.5), ("***", None), ("", 3.0), ("", 1.0), ("*", 0.0)]


def test_box_and_band(spark):
    df = spark.createDataFrame([("q", "d", float(v)) for v in (1, 2, 4, 8, 100)], "question string, dataset string, value double")
    r = agg.box_summary(df).first()
    assert (r.q25, r.median, r.q75, r.whisker_low, r.whisker_high) == (2, 4, 8, 1, 8)
    assert agg.noise_band(df).first().abs_q95 == pytest.approx(81.6)


def test_exact_counts_are_those_of_all_orders():
    import itertools

    from quillspark.operators.stats import u_counts

    for a, b in ((1, 1), (1, 5), (2, 3), (3, 3), (4, 3), (5, 4)):
        want = [0] * (a * b + 1)
        for first in itertools.combinations(range(a + b), a):
            want[sum(x - i for i, x in enumerate(first))] += 1
        assert u_counts(a, b).tolist() == want
    assert sum(u_counts(8, 3000).tolist()) == __import__("math").comb(3008, 8)


def test_texts_are_scanned_once(spark, tmp_path):
    from pyspark.sql import functions as F
    from quillspark.operators import agg
    from quillspark.plans import analyses

    rows = [("q1", d, f"{'w ' * (i % 7)}") for i in range(40) for d in ("human", "a", "b")]
    spark.createDataFrame(rows, "question string, dataset string, raw string").write.parquet(str(tmp_path / "t"))
    counts = analyses.open_wordcounts(spark.read.parquet(str(tmp_path / "t")))
    for df in (analyses.sentiment_shift(counts, value="word_count", exact=False), agg.box_summary(counts, value="word_count")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1
        assert df.where(F.col("question") == "q1").count() in (2, 3)


def test_box_of_groups_without_values(spark):
    rows = [("q1", "human", 1.0), ("q1", "human", 3.0), ("q1", "human", math.nan), ("q1", "human", None), ("q1", "llama", None), (None, "human", 2.0)]
    got = {(r.question, r.dataset): (r.n, r.median, r.whisker_low, r.whisker_high) for r in agg.box_summary(spark.createDataFrame(rows, "question string, dataset string, value double")).collect()}
    assert got == {("q1", "human"): (2, 2.0, 1.0, 3.0), (None, "human"): (1, 2.0, 2.0, 2.0)}


def test_bh_ranks_distinct_p_and_not_rows(spark):
    ps = [None, float("nan"), 0.0, 0.0, 1.0, 3e-300, 1e-12, 1e-12] + [((i * 7919) % 1000) ** 2 / 1e6 for i in range(700)]
    df = spark.createDataFrame([(f, i, p) for f in ("a", None) for i, p in enumerate(ps)], "family string, i int, p double")
    frame = stats.bh_adjust(df, ("family",), ties=("i",))
    few = {(r.family, r.i): r.p_adj for r in stats.bh_adjust(df, ("family",), ties=("i",), few=True).collect()}
    assert {(r.family, r.i): r.p_adj for r in frame.collect()} == few and len(few) == 2 * len(ps) and frame.columns == ["family", "i", "p", "p_adj"]
    assert "row_number" not in frame._jdf.queryExecution().toString()
