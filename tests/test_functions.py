"""Scalar functions against Python on edge values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geotrends.functions import (
    canonical_state,
    clean_district,
    clean_state_label,
    human_number,
    money_sum,
    pct_change,
    place_year_label,
    quarter_tag,
    safe_ratio,
    segment,
    title_case,
    truncate_int,
)
from geotrends.operators import with_text

UNITS = [(1e12, "T"), (1e9, "B"), (1e7, "Cr"), (1e6, "M"), (1e3, "k")]
EDGES = [0.0, -5.0, 124.0, 1000.0, 1001.0, 1125.0, 2675.0, 1e6, 1000001.0, 1e7, 1e9, 1e12, 1.5e12, -5e7, 5e-4, 0.125]
EDGES += [float("nan"), float("inf"), float("-inf"), -1234567.25, 1e15]
EDGES += [1e-5, 1.5e-7, -2.5e-5, 9.99e-5, 1e-4, -1e16, -1.25e17, -1e100, 1e16, (1e15 + 0.125) * 1e12, (2e15 + 0.375) * 1e12]
EDGES += [10.0**k for k in range(-8, 36)] + [-(10.0**k) for k in range(-8, 36)] + [3.3 * 10.0**k for k in range(15, 35)]


def expected_text(n):
    for bound, unit in UNITS:
        if n > bound:
            return f"{n / bound:.2f} {unit}"
    return str(n)


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def values_of(df):
    return [row[0] for row in df.collect()]


def test_human_number_matches_python(spark):
    random.seed(5)
    values = EDGES + [random.uniform(0, 10 ** random.randint(1, 15)) for _ in range(20000)]
    values += [random.randint(0, 10**6) * 1.25 for _ in range(20000)]
    df = column(spark, values, "double")
    texts = [expected_text(v) for v in values]
    assert values_of(df.select(human_number(F.col("x")))) == texts
    assert values_of(with_text(df, {"x": "t"}).select("t")) == texts


def test_human_number_of_whole_numbers(spark):
    df = column(spark, [None, -5, 0, 124, 1000, 1001, -50_000_000, 2675], "bigint")
    assert values_of(df.select(human_number(F.col("x")))) == [
        None, "-5", "0", "124", "1000", "1.00 k", "-50000000", "2.67 k",
    ]
    as_double = with_text(df, {"x": "t"}, as_double=True).select("t")
    assert values_of(as_double)[:5] == [None, "-5.0", "0.0", "124.0", "1000.0"]


def test_title_case_matches_python(spark):
    names = ["y.s.r. district", "o'neil district", "ANDAMAN-&-nicobar", "a1b2c", "straße ßa", "", "  two  spaces "]
    assert values_of(column(spark, names, "string").select(title_case(F.col("x")))) == [n.title() for n in names]


def test_title_case_matches_python_on_documents(spark):
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    rows = text.select("text", title_case(F.col("text"))).collect()
    assert all(cased == raw.title() for raw, cased in rows)


def test_names(spark):
    states = ["andaman-&-nicobar-islands", "jammu-&-kashmir", "dadra-&-nagar", "tamil-nadu", None]
    assert values_of(column(spark, states, "string").select(canonical_state(F.col("x")))) == [
        "Andaman & Nicobar", "Jammu & Kashmir", "Dadra and Nagar Haveli and Daman and Diu", "Tamil Nadu", None,
    ]
    districts = ["y.s.r. district", "foo district district", "districtville"]
    assert values_of(column(spark, districts, "string").select(clean_district(F.col("x")))) == [
        "Y.S.R.", "Foo", "Districtville",
    ]
    assert values_of(column(spark, ["jammu-&-kashmir"], "string").select(clean_state_label(F.col("x")))) == [
        "Jammu and Kashmir"
    ]
    assert values_of(column(spark, ["3.json", "4-1.json"], "string").select(quarter_tag(F.col("x")))) == ["Q3", "Q4"]
    assert values_of(column(spark, ["a", None], "string").select(place_year_label(F.col("x"), F.lit(2020)))) == [
        "a - 2020", None,
    ]


def test_ratio_and_growth(spark):
    df = spark.createDataFrame([(3, 2), (3, 0), (0, 0), (None, 4), (50, 100)], "now int, before int")
    assert values_of(df.select(safe_ratio(F.col("now"), F.col("before")))) == [1.5, None, None, None, 0.5]
    assert values_of(df.select(pct_change(F.col("now"), F.col("before")))) == [50.0, math.inf, None, None, -50.0]


def test_segment_bounds(spark):
    rows = [(20.0, 100001), (20.01, 100001), (20.01, 99999), (20.0, 99999), (50.0, 100000), (None, 100001)]
    df = spark.createDataFrame(rows, "g double, v bigint")
    assert values_of(df.select(segment(F.col("g"), F.col("v")))) == [
        "Saturated", "Best", "Rising", "Idle", "Idle", "Idle",
    ]


def test_truncate(spark):
    assert values_of(column(spark, [2.9, -2.9], "double").select(truncate_int(F.col("x")))) == [2, -2]


def test_money_sum_is_exact_in_any_order(spark):
    random.seed(3)
    cents = [random.randint(-(10**12), 10**12) for _ in range(5000)] + [10**15 + 1]
    for seed in (1, 2):
        random.Random(seed).shuffle(cents)
        df = column(spark, [c / 100 for c in cents], "double").repartition(7)
        assert df.agg(money_sum(F.col("x"))).first()[0] == sum(cents) / 100
    assert column(spark, [1e17] * 200, "double").agg(money_sum(F.col("x"))).first()[0] == 2e19
    assert column(spark, [None], "double").agg(money_sum(F.col("x"))).first()[0] is None


def test_sums_keep_every_digit(spark):
    nan, inf = float("nan"), float("inf")
    cases = {
        "small": ([0.004, 0.004], 0.008),
        "tiny": ([1e-12, 2e-12, nan, None], 3e-12),
        "cents": ([12345.67] * 3 + [0.01], 37037.02),
        "large": ([9e15, 0.25, -9e15], 0.25),
        "infinite": ([1.0, inf], inf),
        "none": ([nan, None], None),
        "huge": ([1e300, 5.0], 1e300),
    }
    rows = [(k, v) for k, (values, _) in cases.items() for v in values]
    out = spark.createDataFrame(rows, "k string, x double").repartition(3).groupBy("k").agg(money_sum(F.col("x")).alias("s"))
    found = {r.k: r.s for r in out.collect()}
    for k, (_, expected) in cases.items():
        assert found[k] == (expected if expected is None else pytest.approx(expected, rel=1e-12))


def _sums(spark, cases):
    rows = [(k, v) for k, values in cases.items() for v in values]
    out = spark.createDataFrame(rows, "k string, x double").repartition(5).groupBy("k").agg(money_sum(F.col("x")).alias("s"))
    return {r.k: r.s for r in out.collect()}


def test_sums_over_the_range_of_doubles(spark):
    """Numbers that are no whole cents sum to what an exact sum rounds to."""
    rng = random.Random(11)

    def spread(low, high, n):
        numbers = [rng.choice([-1, 1]) * 2.0 ** rng.uniform(low, high) for _ in range(n)]
        return [x for x in numbers if round(x * 100) / 100 != x or abs(x) >= 2.0**43]

    cases = {
        "squares": [3e10**2] * 200,
        "twelve": [9e21] * 12,
        "apart": [1e300, 1e-300],
        "tiny": [4e-18] * 1000,
        "tinier": [1e-20] * 3,
        "third": [1 / 3] * 999,
        "gone": [2.0**100, 2.0**-80, -(2.0**100)],
        "large": [1e30, 1.5, -1e30],
        "halves": [2.0**53 + 2, 1.0, 2.0**-60],
        "minus": [-(3.7e11**2)] * 77 + [1e-9],
        "zero": [1 / 3, -1 / 3],
        **{f"random {i}": spread(-30, 110, 300) for i in range(20)},
        **{f"near {i}": spread(-5, 40, 500) for i in range(20)},
        **{f"small {i}": spread(-70, -30, 200) for i in range(10)},
        **{f"huge {i}": spread(60, 111, 200) for i in range(10)},
    }
    found = _sums(spark, cases)
    exact = {k: math.fsum(v) for k, v in cases.items()}
    assert {k: found[k] for k in cases if " " not in k and found[k] != exact[k]} == {}
    assert {k: found[k] for k in cases if abs(found[k] - exact[k]) > math.ulp(exact[k])} == {}
    again = _sums(spark, {k: v[::-1] for k, v in cases.items()})
    assert again == found


def test_sums_of_cents_are_decimal(spark):
    cents = {f"{n}": [round(random.Random(n).uniform(-1e9, 1e9) * 100) for _ in range(n)] for n in (1, 10, 1000)}
    found = _sums(spark, {k: [c / 100 for c in v] for k, v in cents.items()})
    assert found == {k: sum(v) / 100 for k, v in cents.items()}
    large = [8.7e12] * 3000 + [0.01]
    assert _sums(spark, {"x": large})["x"] == (870_000_000_000_000 * 3000 + 1) / 100


def test_title_case_keeps_control_characters(spark):
    df = column(spark, ["a\u0001 b", "\u0001c", "x\u0001\u0002y z", "\u0001 \u0001 d-e"], "string")
    assert values_of(df.select(title_case(F.col("x")))) == ["A\u0001 B", "\u0001C", "X\u0001\u0002Y Z", "\u0001 \u0001 D-E"]
