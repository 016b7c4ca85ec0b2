import random

import pytest

from goldenloom.llm import format_duplicates as D
from goldenloom.llm import groups, metric, survivors
from goldenloom.llm.naming import osa


def union(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent}


def check(spark, pairs):
    got = groups.connected_groups(spark.createDataFrame(pairs, "a string, b string"))
    assert {r["id"]: r["group_id"] for r in got.collect()} == union(pairs)


def test_chain_ring_star_core_and_dirt(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    ring = [(f"r{i:02}", f"r{(i + 1) % 9:02}") for i in range(9)]
    star = [("s00", f"s{i:02}") for i in range(1, 20)]
    core = [(f"k{i}", f"k{j}") for i in range(5) for j in range(i)]
    tail = [("k0", "t1"), ("t1", "t2"), ("lone", "lone"), (None, "x"), ("x", None), ("p", "q"), ("q", "p")]
    check(spark, chain + ring + star + core + tail + chain[:5])


def test_random_graph(spark):
    rng = random.Random(5)
    check(spark, [(f"n{rng.randrange(80):02}", f"n{rng.randrange(80):02}") for _ in range(75)])


def test_no_pairs(spark):
    assert groups.connected_groups(spark.createDataFrame([], "a string, b string")).count() == 0


CUSTOMERS = "id string, name string, email string, phone string, ingested_at timestamp, key string, copies int, batch string"


def test_ledger_over_batches(spark):
    import datetime as dt

    y = lambda n: dt.datetime(2020 + n, 5, 1)
    rows = [
        ("3", "Ann  Lee", "a@x.org", "1-2", y(0)), ("1", "LEE, Ann", "A @x.org", "(1)2", y(1)), ("1", "LEE, Ann", "A @x.org", "(1)2", y(3)),
        ("2", "Ann Lee", "a@x.org", "13", y(1)), ("4", None, "", " ", y(2)), ("5", "", None, None, None), ("6", "AnnLee", "a@x.org", "12", y(0)),
        (None, "Ann Lee", "a@x.org", "12", y(0)),
    ]
    df = spark.createDataFrame([(*r, "clash", 1, "b") for r in rows], CUSTOMERS)
    assert {tuple(r) for r in D.copies(df).collect()} == {("1", 2), ("4", 2)}
    assert D.copies(df.limit(0)).count() == 0


def test_a_ledger_is_opened_again_and_rewrites_touched_buckets_only(spark, tmp_path):
    batch = lambda rows: spark.createDataFrame([(i, k.encode()) for i, k in rows], "id string, key binary")
    path = str(tmp_path / "ledger")
    first = D.Ledger(spark, path, 8)
    first.add(batch([(f"i{n}", f"k{n % 20}") for n in range(40)]))
    before = dict(first.counted)
    later = D.Ledger.open(spark, path)
    later.add(batch([("i0", "k1"), ("a", "k3"), ("i40", "new")]))
    later.add(batch([]))
    got = {r["key"].decode(): (r["copies"], r["keep_id"]) for r in D.Ledger.open(spark, path).counts().collect()}
    assert got == {f"k{n}": (3, "a") if n == 3 else (2, min(f"i{n}", f"i{n + 20}")) for n in range(20)} | {"new": (1, "i40")}
    assert sum(later.counted[k] != v for k, v in before.items()) <= 2


def test_survivors_rank_and_ties(spark):
    import datetime as dt

    t = lambda m: dt.datetime(2024, m, 1)
    rows = [
        ("g", "e2", "sap_erp", {"name": "B", "email": "b@x.org", "city": "N/A", "phone": "0000000000"}, t(1)),
        ("g", "e1", "sap_erp", {"name": "A", "email": "n/a@n/a", "city": "Rome"}, t(1)),
        ("g", "e3", "nobody", {"name": "C", "email": "c@x.org", "city": "Oslo", "phone": None}, dt.datetime(2030, 1, 1)),
        ("h", "e4", None, {"name": "???"}, None), (None, "e5", None, {"name": "X"}, None), ("i", "e6", None, None, t(1)),
    ]
    c = spark.createDataFrame([(*r, 1.0) for r in [*rows, rows[0]]], "golden_record_id string, entity_id string, source string, fields map<string,string>, updated_at timestamp, trust double")
    s = spark.createDataFrame([("e3", 0.9, t(1)), ("e3", 0.1, t(2)), ("e1", 0.5, t(1))], "entity_id string, completeness double, computed_at timestamp")
    d = spark.createDataFrame([("sap_erp", 0.9)], "source_name string, trust_weight double")
    got = {(r["golden_record_id"], r["field"]): r["entity_id"] for r in survivors.survivorship_map(c, s, d).collect()}
    assert got == {("g", "name"): "e1", ("g", "email"): "e2", ("g", "city"): "e1"}


@pytest.mark.parametrize("block", [16_384, 20])
def test_radius_join_loses_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(metric, "BLOCK", block)
    rng = random.Random(6)
    words = sorted({"".join(rng.choices("abcdoé", k=rng.randint(1, 16))) for _ in range(150)} | {"kestrel", "kestral", "kesterl", "heron", "x" * 90, "x" * 89 + "y", "日本", "日本語"})
    df = spark.createDataFrame([(w, 1) for w in [*words, *words[:9], "", None]], "word string, a int")
    got = sorted((r["a"], r["b"], r["distance"], r["one"]) for r in metric.near_points(df).collect())
    want = sorted((a, b, d, osa(a, b, 1) <= 1) for a in words for b in words if a <= b and (d := metric.distance(a, b)) <= 2)
    assert got == want
    assert osa("kestrel", "kesterl", 2) == 1 and metric.near_points(df.limit(0)).count() == 0
