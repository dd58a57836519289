"""Reading document trees, and a full refresh from one."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from geotrends.fixed_values import DOCUMENT_PATHS
from geotrends.plans import extract_tables, profile_tables, refresh_from_tree
from geotrends.schemas import SCHEMAS
from geotrends.sinks import create_tables, drop_tables, refresh, tables, write_tree
from geotrends.sources import (
    extract,
    read_boundaries,
    read_csv,
    read_table,
    read_tree,
    rejected_elements,
    split_rejects,
)

STATES = {"andaman-&-nicobar-islands": "Andaman & Nicobar", "tamil-nadu": "Tamil Nadu", "goa+one two": "Goa+One Two"}


def put(root, entity, place, year, quarter, body):
    folder = root / DOCUMENT_PATHS[entity] / place / str(year)
    folder.mkdir(parents=True, exist_ok=True)
    text = body if isinstance(body, str) else json.dumps({"success": True, "data": body}, indent=2)
    (folder / f"{quarter}.json").write_text(text)


def measure(n):
    return {"type": "TOTAL", "count": n, "amount": n * 10.25}


def bodies(n):
    """One body per document set; ``n`` makes the numbers differ."""
    instruments = [{"name": "Peer", "paymentInstruments": [measure(n), measure(0)]}]
    hover = [{"name": "y.s.r. district", "metric": [measure(n)]}, {"name": "o'neil district", "metric": [measure(n + 1)]}]
    ranked = {
        "districts": [{"entityName": "foo", "metric": measure(n)}],
        "pincodes": [{"entityName": "600001", "metric": measure(n)}, {"entityName": "600002", "metric": measure(n)}],
    }
    users = {
        "districts": [{"name": "foo", "registeredUsers": n}],
        "pincodes": [{"name": "600001", "registeredUsers": n}],
    }
    return {
        "aggregated_user": {"usersByDevice": [{"brand": "A", "count": n, "percentage": 0.25}]},
        "aggregated_transaction": {"transactionData": instruments},
        "aggregated_insurance": {"transactionData": instruments},
        "map_user": {"hoverData": {"foo district": {"registeredUsers": n, "appOpens": n * 2}}},
        "map_transaction": {"hoverDataList": hover},
        "map_insurance": {"hoverDataList": hover},
        "top_user": users,
        "top_transaction": ranked,
        "top_insurance": ranked,
        "location": {"data": {"columns": ["lat", "lng", "metric", "label"], "data": [[8.5, 77.25, n, "foo district"]]}},
    }


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    n = 0
    for state in STATES:
        for year, quarter in ((2020, 1), (2020, 2), (2021, 4)):
            n += 1
            for entity, body in bodies(n).items():
                put(root, entity, f"state/{state}", year, quarter, body)
    for entity, body in bodies(7).items():
        body = {"data": {"data": [[20.5, 78.0, 7, "jammu-&-kashmir"]]}} if entity == "location" else body
        put(root, entity, ".", 2020, 3, body)
    return root


def test_all_tables(spark, tree):
    tables = extract_tables(spark, str(tree))
    assert set(tables) == set(SCHEMAS)
    for name, df in tables.items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in SCHEMAS[name]]
    counts = {name: df.count() for name, df in tables.items()}
    two = {"map_transaction", "map_insurance", "top_transaction_pincodewise", "top_insurance_pincodewise"}
    expected = {name: 18 if name in two else 9 for name in SCHEMAS} | {"india_level_location_metrics": 1}
    assert counts == expected


def test_names_and_periods(spark, tree):
    rows = extract(read_tree(spark, str(tree), "map_insurance"), "map_insurance").collect()
    assert {r.state for r in rows} == set(STATES.values())
    assert {(r.year, r.quarter) for r in rows} == {(2020, "Q1"), (2020, "Q2"), (2021, "Q4")}
    assert {r.district for r in rows} == {"Y.S.R.", "O'Neil"}
    tables = extract_tables(spark, str(tree))
    country = tables["india_level_location_metrics"].first()
    assert tuple(country) == ("Jammu and Kashmir", 20.5, 78.0, 7.0)
    assert tables["top_transaction_pincodewise"].first().pincode.startswith("6000")


def test_narrow_globs(spark, tree):
    raw = read_tree(spark, str(tree), "aggregated_user", state="tamil-nadu", year="2020")
    assert {(r.state, r.year) for r in extract(raw, "aggregated_user").collect()} == {("Tamil Nadu", 2020)}


@pytest.fixture(scope="module")
def damaged(tmp_path_factory):
    root = tmp_path_factory.mktemp("damaged")
    good = {"brand": "A", "count": 3, "percentage": 0.5}
    lists = {
        1: [good, {"brand": "B", "count": "many", "percentage": 0.5}, {"brand": "C", "count": 7, "percentage": 1}],
        2: [None, {"brand": "D"}, 5, good],
        3: None,
    }
    for quarter, items in lists.items():
        put(root, "aggregated_user", "state/goa", 2020, quarter, {"usersByDevice": items})
    put(root, "aggregated_user", "state/goa", 2021, 1, {})
    put(root, "aggregated_user", "state/goa", 2021, 2, {"usersByDevice": "odd"})
    put(root, "aggregated_transaction", "state/goa", 2020, 1, {"transactionData": [{"name": "X", "paymentInstruments": []}]})
    users = {"x": {"registeredUsers": 1, "appOpens": 2}, "y": 4}
    put(root, "map_user", "state/goa", 2020, 1, {"hoverData": users})
    put(root, "location", "state/goa", 2020, 1, {"data": {"data": [[1, 2, 3], [1, 2, 3, "x district"], ["a", 2, 3, "z"]]}})
    put(root, "top_user", "state/goa", 2020, 1, '{"data": {"districts": [')
    put(root, "top_user", "state/goa", 2020, 2, {"districts": [{"name": "x", "registeredUsers": 4}], "pincodes": None})
    return root


def test_damaged_elements_are_rejected_alone(spark, damaged):
    raw = read_tree(spark, str(damaged), "aggregated_user")
    kept = extract(raw, "aggregated_user").select("quarter", "brand", "user_count").collect()
    assert sorted(map(tuple, kept)) == [("Q1", "A", 3), ("Q1", "C", 7), ("Q2", "A", 3)]
    rejects = rejected_elements(raw, "aggregated_user").collect()
    assert sorted((r.file_path[-6], r.position) for r in rejects) == [("1", "1"), ("2", "0"), ("2", "1"), ("2", "2")]


def test_damaged_nodes_of_other_shapes(spark, damaged):
    root = str(damaged)
    assert extract(read_tree(spark, root, "aggregated_transaction"), "aggregated_transaction").count() == 0
    users = extract(read_tree(spark, root, "map_user"), "map_user").collect()
    assert [(r.district, r.appopen_count) for r in users] == [("X", 2)]
    places = extract(read_tree(spark, root, "location"), "state_level_location_metrics").collect()
    assert [tuple(r) for r in places] == [("Goa", "X", 1.0, 2.0, 3.0)]


def test_unparsable_documents(spark, damaged):
    with pytest.raises(PySparkException, match="unparsable document"):
        extract(read_tree(spark, str(damaged), "top_user"), "top_user_districtwise").collect()
    good, rejects = split_rejects(read_tree(spark, str(damaged), "top_user", strict=False))
    assert [r.registered_users for r in extract(good, "top_user_districtwise").collect()] == [4]
    assert extract(good, "top_user_pincodewise").count() == 0
    assert [r.file_path[-6:] for r in rejects.collect()] == ["1.json"]


def test_refresh_twice_gives_the_same(spark, tree, tmp_path):
    for _ in range(2):
        refresh_from_tree(spark, str(tree), "refreshed", str(tmp_path / "db"), str(tmp_path / "csv"))
    loaded = {name: read_table(spark, name, "refreshed").select(*s.names) for name, s in SCHEMAS.items()}
    profile = profile_tables(loaded)
    assert {r.table: r.duplicates for r in profile["duplicates"].collect()} == {
        name: 0 for name in SCHEMAS
    }
    info = profile["info"].collect()
    assert sum(r.nulls for r in info) == 0
    assert {r.rows for r in info if r.table == "map_insurance"} == {18}
    for name, schema in SCHEMAS.items():
        back = read_csv(spark, str(tmp_path / "csv" / name), schema)
        assert back.exceptAll(loaded[name]).count() == 0 and back.count() == loaded[name].count()


def test_refresh_checks_before_it_writes(spark, tmp_path):
    create_tables(spark, "checked", str(tmp_path / "db"))
    good = spark.createDataFrame([("a", 2020, "Q1", "x", 1, 2)], SCHEMAS["map_user"])
    refresh(spark, "checked", {"map_user": good})
    bad = good.drop("quarter")
    with pytest.raises(ValueError, match="missing quarter"):
        refresh(spark, "checked", {"map_user": good.limit(0), "map_insurance": bad})
    assert read_table(spark, "map_user", "checked").count() == 1


def _users(spark, n):
    return spark.createDataFrame([("a", 2020 + i, "Q1", "x", n, 2) for i in range(3)], SCHEMAS["map_user"])


def _amounts(spark, n):
    return spark.createDataFrame([("a", 2020, "Q1", "x", n, 2.5)], SCHEMAS["map_insurance"])


def _counts(spark, db):
    users = read_table(spark, "map_user", db).select("registered_users").distinct().collect()
    return [r[0] for r in users], [r.insurance_count for r in read_table(spark, "map_insurance", db).collect()]


def test_refresh_that_fails_midway_changes_nothing(spark, tmp_path):
    """All tables show their old rows if one cannot be written, or if the switch itself fails."""
    db = "stepwise"
    create_tables(spark, db, str(tmp_path / "db"))
    refresh(spark, db, {"map_user": _users(spark, 1), "map_insurance": _amounts(spark, 1)})
    reader = read_table(spark, "map_user", db)
    broken = _amounts(spark, 2).withColumn("insurance_count", F.raise_error(F.lit("broken row")).cast("bigint"))
    with pytest.raises(PySparkException, match="broken row"):
        refresh(spark, db, {"map_user": _users(spark, 2), "map_insurance": broken})
    assert _counts(spark, db) == ([1], [1])
    show = tables._show

    def failing(spark, db, table, version):
        if table == "map_insurance" and version and version not in known:
            raise RuntimeError("no switch")
        show(spark, db, table, version)

    known = tables._versions(spark, db)
    tables._show = failing
    try:
        with pytest.raises(RuntimeError, match="no switch"):
            refresh(spark, db, {"map_user": _users(spark, 2), "map_insurance": _amounts(spark, 2)})
    finally:
        tables._show = show
    assert _counts(spark, db) == ([1], [1]) and tables._versions(spark, db) == known
    refresh(spark, db, {"map_user": _users(spark, 3), "map_insurance": _amounts(spark, 3)})
    assert _counts(spark, db) == ([3], [3])
    assert reader.count() == 3  # a frame of the old rows still finds its files
    refresh(spark, db, {"map_user": _users(spark, 4)})
    assert _counts(spark, db) == ([4], [3])
    assert read_table(spark, "aggregated_user", db).count() == 0
    drop_tables(spark, db)
    assert not tables._versions(spark, db) and not spark.catalog.databaseExists(db)


def test_written_tree_is_read_back(spark, tmp_path):
    folder = DOCUMENT_PATHS["map_user"]
    body = lambda n: json.dumps({"data": {"hoverData": {"foo é district": {"registeredUsers": n, "appOpens": 2 * n}}}})
    rows = [(f"{folder}/state/goa+one two/2020/{q}.json", body(q)) for q in (1, 2, 3)] + [(f"{folder}/state/a-&-b/2021/1.json", body(9))]
    frame = spark.createDataFrame([*rows, (None, "x"), ("x.json", None)], "path string, document string").repartition(3)
    for _ in range(2):  # a second run writes the same files
        write_tree(frame, str(tmp_path / "out"))
    assert (tmp_path / "out" / rows[0][0]).read_text() == body(1)
    flat = extract(read_tree(spark, str(tmp_path / "out"), "map_user"), "map_user").collect()
    assert sorted((r.state, r.year, r.quarter, r.district, r.registered_users) for r in flat) == [
        ("A & B", 2021, "Q1", "Foo É", 9), *[("Goa+One Two", 2020, f"Q{q}", "Foo É", q) for q in (1, 2, 3)],
    ]
    write_tree(frame.limit(0), str(tmp_path / "none"))


def test_year_filter_prunes_partitions(spark, tmp_path):
    create_tables(spark, "pruned", str(tmp_path / "db"))
    rows = [("a", y, "Q1", "x", 1, 2) for y in (2019, 2020)]
    refresh(spark, "pruned", {"map_user": spark.createDataFrame(rows, SCHEMAS["map_user"])})
    one = read_table(spark, "map_user", "pruned").filter("year = 2019")
    assert one.count() == 1
    assert all("year=2019" in f for f in one.inputFiles())


def test_csv_with_crlf(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b"State,Year,Quarter,Type,Insurance_Count,Insurance_Amount\r\nA & B,2020,Q2,Insurance,6,1360.0\r\n")
    rows = read_csv(spark, str(path), SCHEMAS["aggregated_insurance"]).collect()
    assert [tuple(r) for r in rows] == [("A & B", 2020, "Q2", "Insurance", 6, 1360.0)]


def test_boundaries(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    features = [{"type": "Feature", "properties": {"ST_NM": n}, "geometry": square} for n in ("A", "B", "C")]
    path = tmp_path / "shapes.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = read_boundaries(spark, str(path)).collect()
    assert [r.name for r in rows] == ["A", "B", "C"]
    assert json.loads(rows[0].geometry_json) == square
