"""Operators on pages and vectors against plain versions."""

import base64
import hashlib
import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from geotrends.llm.components import connected_components
from geotrends.llm.shared_store import new_folder
from geotrends.llm.url_rules import judge_urls
from geotrends.llm.vectors import Settings, nearest_cells, near_vectors
from geotrends.llm.warc import NO_DATE, SAME_PAYLOAD, page_records, read_archive, read_index, warc_records, write_archive

PAGES = [
    (1, "http://a/1", "<p>é</p>", "x"), (7, "http://a/7", "same", "x"), (3, "http://a/3\r\nWARC-Type: no", "same", "x"), (5, None, "same", "x"),
    (8, "http://a/8", None, "x"), (9, "http://a/9", "", "x"), (9, "http://a/9", "", "x"), (None, "http://n", "alone", "x"),
    (20, "http://l", "l" * 300_000, "x"), (None, "http://m", "same", "x"),
]


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, sha256 string").repartition(3)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_warc_round_trip(spark, min_bytes):
    folder = new_folder(spark, "test-warc")
    headers, payloads = page_records(_pages(spark, PAGES), min_bytes)
    write_archive(headers, payloads, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({h or "" for _, _, h, _ in PAGES})
    first = {}
    for i, _, h, _ in PAGES:
        first[h or ""] = min(x for x in (first.get(h or ""), i) if x is not None) if (i, first.get(h or "")) != (None, None) else None
    expected = []
    for i, url, h, _ in PAGES:
        data = (h or "").encode()
        revisit = len(data) >= min_bytes and i != first[h or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        url = url and url.replace("\r", "%0D").replace("\n", "%0A")
        expected.append((i, url, len(data), digest, "revisit" if revisit else "response", first[h or ""] if revisit else None))
    found = [tuple(r) for r in read_index(spark, folder).collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected))
    whole = read_archive(spark, folder).collect()
    before = headers.join(payloads.distinct(), "sha256").select("header", "payload").collect()
    assert sorted((bytes(r[0]), bytes(r[1])) for r in whole) == sorted((bytes(r[0]), bytes(r[1])) for r in before)


def _parse_warc(data):
    """The records of a WARC file by its grammar alone: version, named fields, block of the stated length, two line ends."""
    out = []
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        version, *lines = head.decode().split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines)
        n = int(fields["Content-Length"])
        out.append((fields, data[:n]))
        assert data[n : n + 4] == b"\r\n\r\n" and len(fields) == len(lines)
        data = data[n + 4 :]
    return out


def test_warc_file(spark):
    """The records one after another are a WARC file, also where payloads hold header-like text."""
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\nb"
    pages = [*PAGES, (90, "http://x/90", tricky, None), (91, "http://x/91", tricky, "2020-05-06T07:08:09Z")]
    folder = new_folder(spark, "test-warc")
    write_archive(*page_records(_pages(spark, pages), date=F.when(F.col("sha256").contains("Z"), F.col("sha256"))), folder)
    records = _parse_warc(b"".join(bytes(r[0]) for r in warc_records(spark, folder).collect()))
    assert len(records) == len(pages)
    for fields, _ in records:
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Type"} <= fields.keys()
        assert (fields["WARC-Type"] == "revisit") == (fields.get("WARC-Profile") == SAME_PAYLOAD) == ("WARC-Refers-To" in fields)
    named = {f["WARC-Record-ID"]: (f, block) for f, block in records if f["WARC-Type"] == "response"}
    for fields, block in records:
        if fields["WARC-Type"] == "revisit":
            original, payload = named[fields["WARC-Refers-To"]]
            assert block == b"" and original["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
        else:
            payload = block
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    dates = {f["WARC-Record-ID"]: f["WARC-Date"] for f, _ in records}
    assert dates["<urn:page:90>"] == NO_DATE and dates["<urn:page:91>"] == "2020-05-06T07:08:09Z"
    ids = [(r["page_id"], r["refers_to"]) for r in read_index(spark, folder).collect()]
    assert sorted(map(str, (i for i, _ in ids))) == sorted(map(str, (p[0] for p in pages))) and (91, 90) in ids


def test_warc_edges(spark):
    folder = new_folder(spark, "test-warc")
    write_archive(*page_records(_pages(spark, []).limit(0)), folder)
    assert read_index(spark, folder).count() == 0
    headers, payloads = page_records(_pages(spark, PAGES))
    with pytest.raises(Exception, match="wrong digest"):
        write_archive(headers, payloads.selectExpr("sha256", "cast('x' as binary) as payload"), new_folder(spark, "test-warc"))


RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "", "allow"), ("net", "/es/a", "allow"), ("com", "/very/long/path", "block"), ("org", "/x", "block"), ("org", "/x", "allow"), (None, "/", "block"),
]


def _judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [
        (len(h + p), len(h), h + p, v)
        for h, p, v in sorted(RULES[:8] + RULES[8:9])
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(3)
    hosts = ["example.com", "WWW.Example.com", "a.www.example.com", "net", "b.net", "xnet", "org", "q.org", "com", "e..net", "", "com:80"]
    paths = ["", "/", "/en/", "/en/x", "/en", "/es/a", "/es/", "/es/ab/c", "/very/long/path/1", "/x", "/y?z=/en/", "?a=/", "#/", "/é\u0001"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += [None, "", "no scheme", "http:/x", "a://b://c.com/", "http://net/es/a"] + ["http://b.net/es/1"] * 50
    rows = [(k, u, "h", "p") for k, u in enumerate(urls)] + [(0, urls[0], "h", "p")]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rules = rules.where("not (host <=> 'org' and verdict = 'block')").unionByName(rules.where("host = 'org' and verdict = 'block'"))
    out = judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, host string, path string").repartition(5), rules)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    found = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect() if r["host"].find("org") < 0)
    expected = sorted((k, *_judge(u)) for k, u, _, _ in rows if _judge(u)[0].find("org") < 0)
    assert [str(x) for x in found] == [str(x) for x in expected]
    # Of equal rules the smallest verdict counts.
    assert {r["verdict"] for r in out.collect() if r["host"].endswith("org") and r["path"] == "/x"} == {"allow"}


def test_url_rules_edges(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert [tuple(r)[2:] for r in judge_urls(pages, rules.limit(0)).collect()] == [("a.com", "/", None, "allow")]


def test_url_rules_use_no_python(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    plan = judge_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def _vectors():
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1):
        for _ in range(12):
            center = rng.normal(size=16)
            rows += [(label, (center + 0.1 * rng.normal(size=16)).astype(np.float32).tolist()) for _ in range(12)]
        rows += [(label, [1.0] * 16)] * 40 + [(label, [2.0] * 16)] * 3
    rows += [(None, [1.0] * 16), (0, None), (0, []), (0, [0.0] * 16), (0, [math.nan] + [1.0] * 15), (0, [math.inf] + [1.0] * 15),
             (0, [None] + [1.0] * 15), (0, [1.0] * 8), (0, [1.0] * 8), (1, [3.0])]
    return [(k, v, label, "x") for k, (label, v) in enumerate(rows)]


@pytest.mark.parametrize("settings", [Settings(), Settings(members=7, visitors=5, cell_size=4, sample=100)])
def test_near_vectors(spark, settings):
    rows = _vectors()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, cell string").repartition(4)
    out = {r["vec_id"]: r for r in near_vectors(frame, settings=settings).collect()}
    usable = lambda v: bool(v) and None not in v and np.isfinite(v).all() and np.any(v)
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v, label, _ in rows if label is not None and usable(v)}
    label = {k: x for k, _, x, _ in rows}
    links = {
        (a, b) for a in unit for b in unit
        if a != b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93
    }
    assert len(out) == len(rows)
    n = {k: sum(1 for a, _ in links if a == k) for k in out}
    found = sum(out[k]["n_links"] for k in out)
    assert all(out[k]["n_links"] <= n[k] for k in out)
    assert found >= 0.95 * sum(n.values())
    if found == sum(n.values()):
        reach = {k: k for k in out}
        for _ in range(len(rows)):
            changed = False
            for a, b in links:
                if reach[b] < reach[a]:
                    reach[a], changed = reach[b], True
            if not changed:
                break
        assert {k: (r["component_id"], r["kept"]) for k, r in out.items()} == {k: (c, c == k) for k, c in reach.items()}


def test_vectors_without_an_id_or_with_a_used_one(spark):
    """Links and components by brute force over rows, not over ids."""
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(6, 12))
    rows = [(int(i), (centers[i % 6] + 0.05 * rng.normal(size=12)).tolist(), 1) for i in range(10, 40)]
    rows += [(None, centers[k].tolist(), 1) for k in (0, 0, 1, 5)] + [(None, (-centers[3]).tolist(), 1), (None, None, 1), (None, [0.0] * 12, 1)]
    rows += [(11, centers[2].tolist(), 1), (11, centers[2].tolist(), 1), (11, (-centers[4]).tolist(), 1), (11, None, 1), (12, centers[0].tolist(), None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, digest string").repartition(4)
    unit = [np.array(v) / np.linalg.norm(v) if label and v and any(v) else None for _, v, label in rows]
    linked = lambda a, b: unit[a] is not None and unit[b] is not None and unit[a] @ unit[b] >= 0.93
    links = [(a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and linked(a, b)]
    component = brute.components(len(rows), links)
    expected = []
    for a, (i, _, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if component[b] == component[a] and rows[b][0] is not None]
        smallest = min(ids, default=None)
        expected.append((i, sum(1 for x, _ in links if x == a), smallest, i == smallest))
    found = [tuple(r) for r in near_vectors(frame).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def _low_rank(rng, n):
    """Neighbours differ along the few directions in which all vectors lie."""
    return rng.normal(size=(n, 4)) @ rng.normal(size=(4, 32)) + 0.01 * rng.normal(size=(n, 32))


def _power_law(rng, n):
    return rng.normal(size=(n, 32)) * np.arange(1, 33) ** -1.5


@pytest.mark.parametrize("make", [_low_rank, _power_law])
def test_recall_where_directions_differ(spark, make):
    x = make(np.random.default_rng(2), 3000)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93).sum(1) - 1
    frame = spark.createDataFrame([(k, v, 1) for k, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>, label int")
    out = {r["vec_id"]: r["n_links"] for r in near_vectors(frame.repartition(8), settings=Settings(sample=1000)).collect()}
    assert all(out[k] <= n for k, n in enumerate(links))
    assert sum(out.values()) >= 0.98 * links.sum() > 0


def test_near_vectors_of_nothing(spark):
    frame = spark.createDataFrame(_vectors()[:1], "vec_id bigint, embedding array<float>, label int, cell string").limit(0)
    assert near_vectors(frame).count() == 0


def test_multi_sequence_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(5)
    order = nearest_cells(a, b, 99)
    sums = [a[c // 5] + b[c % 5] for c in order]
    assert sorted(order) == list(range(35)) and sums == sorted(sums)


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 160)] + [(1, 1), (5, 3), (3, 5), (200, 7), (None, 4)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert found == {**{k: 100 for k in range(100, 161)}, 1: 1, 3: 3, 5: 3, 7: 7, 200: 7}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
