"""Rules at the edges, and properties that hold for any data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geotrends.fixed_values import SEGMENTS
from geotrends.operators.quality import row_digest
from geotrends.operators.scope import latest_rows
from geotrends.operators.aggregates import children_parts
from geotrends.operators.windows import rescale, with_total
from geotrends.operators import (
    app_open_rate,
    check_schema,
    conditional_growth,
    duplicate_count,
    exact_quantiles,
    filter_scope,
    flag_underutilized,
    head_n,
    hierarchy_rollup,
    iqr_bounds,
    latest_rows,
    matrix,
    matrix_long,
    middle_slice,
    null_counts,
    order_by_category,
    profile_info,
    rank_places,
    regroup_sum,
    rescale,
    rising_places,
    tail_n,
    top_places,
    totals_with_gross,
    users_with_location,
    with_total,
)
from geotrends.operators.quantiles import _first_bucket
from geotrends.plans import payment_modes
from geotrends.schemas import SCHEMAS
from geotrends.sinks import create_tables, refresh, with_surrogate_id
from geotrends.sources import read_csv
from workload.views import Tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF_DIR)


def districts(spark, rows):
    return spark.createDataFrame(
        [(s, y, "Q1", d, n, float(n)) for s, y, d, n in rows], SCHEMAS["map_transaction"]
    )


def test_rising_places_edges(spark):
    rows = [
        ("s", 2018, "zero", 0), ("s", 2019, "zero", 5),
        ("s", 2018, "still", 0), ("s", 2019, "still", 0),
        ("s", 2018, "gap", 10), ("s", 2021, "gap", 30),
        ("s", 2018, "bound", 10000), ("s", 2019, "bound", 90000),
        ("s", 2018, "twice", 10), ("s", 2019, "twice", 20),
    ]
    rising = rising_places(districts(spark, rows)).collect()
    assert [(r.district, r.growth_percentage, r.state_year) for r in rising] == [
        ("zero", math.inf, "s - 2019"),
        ("gap", 200.0, "s - 2021"),
    ]


def test_growth_from_nothing_is_unknown(spark):
    rows = [("a", 2024, "Q1", "t", 5, 1.0), ("b", 2023, "Q1", "t", 3, 1.0), ("b", 2024, "Q1", "t", 4, 1.0)]
    growth = conditional_growth(spark.createDataFrame(rows, SCHEMAS["aggregated_insurance"])).orderBy("state").collect()
    assert [(r.count_2024, r.count_2023, r.growth_percent) for r in growth] == [(5, 0, None), (4, 3, 33.33)]


def test_unknown_rate_is_not_flagged(spark):
    users = spark.createDataFrame([("s", 2020, "Q1", "A", 0, 0.1), ("s", 2020, "Q1", "B", 6000, 0.9)], SCHEMAS["aggregated_user"])
    opens = spark.createDataFrame([("s", 2020, "Q1", "d", 10, 500)], SCHEMAS["map_user"])
    rates = app_open_rate(users, opens)
    assert {r.brand: r.underutilized for r in flag_underutilized(rates, keep_all=True).collect()} == {"A": False, "B": True}


def test_top_places_merges_names_across_states(spark):
    rows = [("a", 2020, "Q1", "x", 5), ("b", 2020, "Q1", "x", 7), ("b", 2020, "Q1", "y", 7)]
    df = spark.createDataFrame(rows, SCHEMAS["top_user_districtwise"])
    merged = top_places(df, ["district"], carry="state").collect()
    assert [(r.state, r.district, r.users) for r in merged] == [("a", "x", 12), ("b", "y", 7)]
    apart = top_places(df, ["district"], by_state=True).collect()
    assert [(r.state, r.district, r.users) for r in apart] == [("b", "x", 7), ("b", "y", 7), ("a", "x", 5)]


@pytest.mark.parametrize("n", [3, 10, 15, 20, 21, 47])
def test_head_middle_tail_cover_all(spark, n):
    # Counts tie, so the place decides.
    df = spark.createDataFrame([(f"p{i:02d}", i % 4) for i in range(n)], "place string, count int")
    parts = [head_n(df, "count", ["place"]), middle_slice(df, "count", ["place"]), tail_n(df, "count", ["place"])]
    head, middle, tail = ({r.place for r in p.collect()} for p in parts)
    assert head | middle | tail == {r.place for r in df.collect()}
    assert len(middle) == max(0, n - 20) and not middle & (head | tail)


def test_middle_keeps_null_places(spark):
    df = spark.createDataFrame([(f"p{i:02d}", i) for i in range(10)] + [(None, 10)] + [(f"q{i}", 20 + i) for i in range(10)], "place string, count int")
    assert [r.place for r in middle_slice(df, "count", ["place"]).collect()] == [None]


def test_children_in_parts(spark):
    rows = [("a", f"c{i:04d}") for i in range(1000)] * 3 + [("b", "x"), ("c", None), (None, "y"), ("d", "q"), ("d", "p")]
    parts = children_parts(spark.createDataFrame(rows, "s string, d string").repartition(6), "s", "d", size=64).collect()
    assert all(1 <= len(r.ds) <= 64 for r in parts)
    by_parent = {}
    for r in sorted(parts, key=lambda r: (r.s, r.part)):
        assert r.part == len(by_parent.setdefault(r.s, []))
        by_parent[r.s].append(r.ds)
    flat = {s: [c for part in lists for c in part] for s, lists in by_parent.items()}
    assert flat == {"a": [f"c{i:04d}" for i in range(1000)], "b": ["x"], "d": ["p", "q"]}


def test_computed_frames_are_read_once(spark, tmp_path):
    path = str(tmp_path / "rows.parquet")
    spark.range(40).selectExpr("id % 4 as year", "id as v", "id % 3 as k").write.parquet(path)
    grouped = spark.read.parquet(path).groupBy("year", "k").agg(F.sum("v").alias("v"))
    for frame in (latest_rows(grouped), rescale(grouped, "v", "size"), with_total(grouped, {"v": "total"}), with_total(grouped, {"v": "total"}, "year")):
        assert "FileScan" not in frame._jdf.queryExecution().executedPlan().toString()
        assert frame.count() > 0
    assert latest_rows(spark.read.parquet(path)).count() == 10


def test_duplicates_by_digest_compare_whole_rows(spark):
    """Different rows of one digest are no duplicates."""
    rows = [(1, "a", None), (1, "a", None), (2, None, "a"), (None, "a", "a"), (1, None, "a"), (1, "a", "a")] + [(7, "hot", "row")] * 20
    df = spark.createDataFrame(rows, "x int, `y.z` string, n string").repartition(4)
    columns = [F.col("x"), F.col("`y.z`")]
    for digest in (None, row_digest(df), [F.lit(1)], [F.xxhash64(*columns), F.lit(0)]):
        assert duplicate_count(df, digest).first()[0] == 20
    assert duplicate_count(df.limit(0), row_digest(df)).first()[0] == 0
    wide = df.select("*", *[F.lit(i).alias(f"c{i}") for i in range(12)])
    assert duplicate_count(wide).first()[0] == 20


def test_hierarchy_children_sum_to_their_parent(tables):
    path = ["state", "district", "year", "quarter"]
    nodes = hierarchy_rollup(tables.map_transaction, path, "transaction_count").collect()
    by_level = {k: [n for n in nodes if n.level == k] for k in range(5)}
    total = by_level[0][0].value
    assert by_level[0][0].pct_parent == 1.0 and len(by_level[0]) == 1
    for level, members in by_level.items():
        assert sum(n.value for n in members) == total
        assert math.isclose(sum(n.pct_root for n in members), 1.0)
        if level:
            sums = {}
            for n in members:
                key = tuple(n[c] for c in path[: level - 1])
                sums[key] = sums.get(key, 0) + n.pct_parent
            assert all(math.isclose(s, 1.0) for s in sums.values())


def test_hierarchy_of_large_amounts(spark):
    rows = [("a", f"d{i % 7}", 3e10) for i in range(200)] + [("b", "d0", 2.5e-7), ("b", "d0", 1e12 + 1 / 3)]
    df = spark.createDataFrame(rows, "s string, d string, v double").repartition(5)
    nodes = {(n.level, n.s, n.d): n for n in hierarchy_rollup(df, ["s", "d"], "v").collect()}
    of = lambda s: [v for x, _, v in rows if s in (None, x)]
    for key, s in (((0, None, None), None), ((1, "a", None), "a"), ((1, "b", None), "b")):
        value = math.fsum(of(s))
        assert nodes[key].value == pytest.approx(value, rel=1e-15)
        assert nodes[key].weighted == pytest.approx(math.fsum(v * v for v in of(s)) / value, rel=1e-14)


def test_hierarchy_reads_its_rows_once(spark, tmp_path):
    from geotrends.operators.hierarchy import _nodes

    path = str(tmp_path / "rows.parquet")
    spark.range(50).selectExpr("id % 3 as a", "id % 5 as b", "id % 2 as c", "id / 7 as v").write.parquet(path)
    nodes = _nodes(spark.read.parquet(path), ["a", "b", "c"], "v")
    nodes.collect()
    plan = nodes._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("Expand") == 1
    assert hierarchy_rollup(spark.read.parquet(path).limit(0), ["a", "b", "c"], "v").count() == 0
    one = hierarchy_rollup(spark.read.parquet(path), ["a"], "v").collect()
    assert sorted((r.level, r.a) for r in one if r.a is not None) == [(1, 0), (1, 1), (1, 2)] and len(one) == 4


def test_hierarchy_keeps_null_keys_apart_from_totals(spark):
    df = spark.createDataFrame([("a", None, 2), ("a", "x", 3), (None, "y", 5)], "s string, d string, v bigint")
    nodes = {(n.level, n.s, n.d): (n.value, n.pct_parent) for n in hierarchy_rollup(df, ["s", "d"], "v").collect()}
    assert nodes[(1, "a", None)] == (5, 0.5)
    assert nodes[(2, "a", None)] == (2, 0.4)
    assert nodes[(1, None, None)] == (5, 0.5)
    assert nodes[(2, None, "y")] == (5, 1.0)


def test_matrix_cells_are_the_long_rows(tables):
    df = tables.agg_transaction
    wide = matrix(df, "transaction_type", "quarter", "transaction_count", values=["Q1", "Q2", "Q3", "Q4"]).collect()
    long = matrix_long(df, "quarter", "transaction_type", "transaction_count").collect()
    cells = {(r.transaction_type, q): r[q] for r in wide for q in ("Q1", "Q2", "Q3", "Q4") if r[q] is not None}
    assert cells == {(r.y, r.x): r.z for r in long}


def test_matrix_rejects_unknown_aggregate(tables):
    with pytest.raises(ValueError):
        matrix(tables.agg_transaction, "year", "state", "transaction_count", agg="median", values=[])


def quartiles(values):
    s = sorted(values)
    out = []
    for p in (0.25, 0.5, 0.75):
        at = p * (len(s) - 1)
        low = math.floor(at)
        out.append(s[low] + (at - low) * (s[math.ceil(at)] - s[low]))
    return out


@pytest.mark.parametrize(
    "values",
    [
        [1.0, 2.0, 3.0, 10.0],
        [5.0],
        [7.0] * 1000,
        [-1.5, 0.0, 0.0, 2.5, 1e300, -1e300],
        [1000 + i / 7919 for i in range(5000)],
        [1.0 + i * 2**-52 for i in range(300)],
        [random.Random(9).lognormvariate(0, 9) for _ in range(3000)],
    ],
    ids=["survey", "one", "same", "wide", "narrow", "adjacent", "tailed"],
)
def test_exact_quartiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    rows = {r.probability: r.quantile for r in exact_quantiles(df, "x", [0.25, 0.5, 0.75]).collect()}
    expected = quartiles(values)
    assert all(math.isclose(rows[p], e, rel_tol=1e-12, abs_tol=1e-12) for p, e in zip((0.25, 0.5, 0.75), expected))


def test_quartiles_with_infinite_values(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(v,) for v in (1.0, 3.0, inf, nan, None, -inf, 2.0)], "x double")
    for approx in (False, True):
        r = iqr_bounds(df, "x", approx=approx).first()
        assert (r.q1, r.q2, r.q3, r.median, r.lower, r.upper) == (1.0, 2.0, 3.0, 2, -2, 6)


def test_first_buckets_divide_values_of_any_size(spark):
    values = [10.0 ** (-300 + 290 * i / 20000) for i in range(20000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    largest = df.groupBy(_first_bucket(F.col("x"))).count().agg(F.max("count")).first()[0]
    assert largest < 20
    found = {r.probability: r.quantile for r in exact_quantiles(df, "x", [0.0, 0.25, 1.0]).collect()}
    assert found[0.0] == values[0] and found[1.0] == values[-1] and math.isclose(found[0.25], quartiles(values)[0], rel_tol=1e-9)


def test_iqr_bounds(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 10)] + [(None, 4)], "k string, x int")
    rows = {r.k: (r.q1, r.q2, r.q3, r.median, r.upper) for r in iqr_bounds(df, "x", by=["k"]).collect()}
    assert rows == {"a": (1.75, 2.5, 4.75, 2, 9), None: (4.0, 4.0, 4.0, 4, 4)}
    sketch = iqr_bounds(df.filter("k = 'a'"), "x", approx=True).first()
    assert sketch.q2 in (2.0, 3.0)


def test_rescale_bounds(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "x int")
    assert [r.y for r in rescale(df, "x", "y").collect()] == [5.0, 27.5, 50.0, None]
    same = spark.createDataFrame([(4,), (4,)], "x int")
    assert [r.y for r in rescale(same, "x", "y").collect()] == [50.0, 50.0]


def test_scope_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 2020, "Q1", "t", 1, 1.0)], SCHEMAS["aggregated_transaction"]).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    scoped = filter_scope(spark.read.parquet(path), "a", 2020, "Q1").select("transaction_count")
    plan = scoped._jdf.queryExecution().executedPlan().toString()
    for part in ("EqualTo(state,a)", "EqualTo(year,2020)", "EqualTo(quarter,Q1)"):
        assert part in plan
    assert "transaction_amount" not in plan


def test_totals_list_every_period(tables):
    scoped = tables.agg_transaction.filter("year = 1998")
    totals = totals_with_gross(scoped, "year", ["transaction_count"], tables.agg_transaction).collect()
    values = {r.scope: r.transaction_count for r in totals}
    assert values["1998"] == values["Gross"] > 0 and values["1999"] == 0


def test_period_totals_only(tables):
    with pytest.raises(ValueError):
        with_total(tables.agg_transaction, {"transaction_count": "t"}, by="state")


def test_regroup_drops_null_keys(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    assert [tuple(r) for r in regroup_sum(df, ["k"], ["v"]).collect()] == [("a", 1)]


def test_rank_places_of_year_shows_it(tables):
    row = rank_places(tables.agg_transaction, ["state"], 1998).first()
    assert row.year == 1998


def test_locations_collapse_to_one(spark):
    users = spark.createDataFrame([("a", 2020, "Q1", "x", 5), ("a", 2020, "Q2", "x", 6)], SCHEMAS["top_user_districtwise"])
    places = spark.createDataFrame(
        [("a", "x", 9.0, 77.0, 1.0), ("a", "x", 9.0, 77.0, 2.0), ("a", "y", 1.0, 1.0, 1.0)],
        SCHEMAS["state_level_location_metrics"],
    )
    assert [tuple(r) for r in users_with_location(users, places).collect()] == [("a", "x", 11, 77.0, 9.0)]


def test_latest_rows(tables):
    last = latest_rows(tables.agg_transaction).agg(F.min("year"), F.max("year")).first()
    assert last[0] == last[1] == tables.agg_transaction.agg(F.max("year")).first()[0]


def test_category_order(spark):
    df = spark.createDataFrame([(c,) for c in ("Idle", "Other", "Best", "Rising", "Saturated")], "c string")
    assert [r.c for r in order_by_category(df, "c", SEGMENTS).collect()] == [*SEGMENTS, "Other"]


def test_profiles(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0)], "k string, v double")
    assert {r.column: (r.dtype, r.non_null, r.rows) for r in profile_info(df).collect()} == {
        "k": ("string", 3, 3), "v": ("double", 1, 3),
    }
    assert {r.column: r.nulls for r in null_counts(df).collect()} == {"k": 0, "v": 2}
    assert duplicate_count(df).first()[0] == 1
    assert duplicate_count(df.limit(0)).first()[0] == 0


def test_schema_problems(spark):
    df = spark.createDataFrame([("a", 1)], "state string, extra int")
    with pytest.raises(ValueError, match="missing year.*unexpected extra"):
        check_schema(df, SCHEMAS["map_user"])


def test_surrogate_ids_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(6)
    rows = with_surrogate_id(df, ["v"]).collect()
    assert sorted((r.id, r.v) for r in rows) == [(i + 1, i) for i in range(1000)]


def test_payment_outputs_by_scope(tables):
    open_scope = payment_modes(tables.agg_transaction)
    assert set(open_scope) >= {"rows", "totals", "map", "map_start", "type_matrix", "periods", "period_matrix"}
    closed = payment_modes(tables.agg_transaction, "NATION_3", 1998, "Q2")
    assert "periods" not in closed
    assert closed["map"].columns[-2:] == ["count_sum", "amount_sum"]


def test_csv_header_is_checked(spark, tmp_path):
    schema = SCHEMAS["aggregated_insurance"]
    path = tmp_path / "t.csv"
    path.write_text('State,Year,Quarter,Type,Insurance_Count,Insurance_Amount\n"Go ""x"", a",2020,Q1,T,6,1360.0\n')
    assert read_csv(spark, str(path), schema).first().state == 'Go "x", a'
    path.write_text("Year,State,Quarter,Type,Insurance_Count,Insurance_Amount\n2020,a,Q1,T,6,1360.0\n")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(path), schema).collect()
    path.write_text("State,Year,Quarter,Type,Insurance_Count,Insurance_Amount\na,odd,Q1,T,6,1360.0\n")
    with pytest.raises(Exception, match="MALFORMED"):
        read_csv(spark, str(path), schema).collect()


def test_refresh_replaces_all_years_in_every_mode(spark):
    schema = SCHEMAS["map_user"]
    frame = lambda year: spark.createDataFrame([("a", year, "Q1", "d", 1, 2)], schema)
    create_tables(spark, "refreshed")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        refresh(spark, "refreshed", {"map_user": frame(2020)})
        refresh(spark, "refreshed", {"map_user": frame(2021)})
        assert [r.year for r in spark.table("refreshed.map_user").collect()] == [2021]
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
        spark.sql("DROP DATABASE refreshed CASCADE")


def test_scope_is_read_once(spark):
    rows = spark.createDataFrame([("a", 2020, "Q1", "t", 3, 1.5)], SCHEMAS["aggregated_transaction"])
    for scope in (("a", "All", "All"), ("a", 2020, "Q1"), ("All", "All", "All")):
        outputs = payment_modes(rows, *scope)
        for name in ("rows", "map", "map_start", "type_matrix"):
            plan = outputs[name]._jdf.queryExecution().optimizedPlan().toString()
            assert "LocalRelation" not in plan
