import datetime as dt
import random

from goldenloom.operators import history

SCHEMA = "entity_id string, status string, fields map<string,string>, version int, captured_at timestamp, deleted_at timestamp, ingested_at timestamp, seq int, chunk string"


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def brute(rows):
    best = {}
    for e, s, f, v, c, d, i, *_ in rows:
        if e is None or c is None:
            continue
        state = (s or "", tuple(sorted((k, x) for k, x in (f or {}).items() if x)))
        key = (v if v is not None else -1, i or dt.datetime.min, d is not None)
        if (e, c) not in best or key > best[e, c][0]:
            best[e, c] = (key, d is not None, state)
    out = []
    for e in {e for e, _ in best}:
        live, start = None, None
        for c in sorted(c for x, c in best if x == e):
            _, gone, state = best[e, c]
            if live is not None and (gone or state != live):
                out.append((e, start, str(c)))
                live = None
            if not gone and live is None:
                live, start = state, str(c)
        if live is not None:
            out.append((e, start, history.OPEN_END))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        n = rng.randrange(120)
        fields = rng.choice([None, {}, {"a": "1"}, {"a": "1", "b": ""}, {"a": "1", "b": None}, {"b": "2", "a": "1"}, {"a": " 1"}])
        rows.append((rng.choice(["e1", "e2", "e3", None]), rng.choice(["x", "", None]), fields, rng.choice([1, 2, None]), rng.choice([at(n), None]) if rng.random() < 0.1 else at(n),
                     at(n) if rng.random() < 0.15 else None, at(n + rng.randrange(9)), 7, "clash"))
    # Ties in every ordering column have no defined winner beyond version, arrival and deletion; keep one row of each.
    rows = list({(r[0], r[4], r[3], r[6], r[5] is None): r for r in rows}.values())
    rows += rows[:20]
    for limit in (history.LIMIT, 7):  # with and without chunks
        got = history.versions(spark.createDataFrame(rows, SCHEMA), limit)
        assert sorted(map(tuple, got.collect())) == brute(rows)


def test_hot_keys_are_cut_into_chunks(spark):
    rows = spark.range(1000).selectExpr("'hot' AS k", "timestamp_seconds(id * id) AS t").unionByName(spark.createDataFrame([("cold", at(1))], "k string, t timestamp"))
    sizes = {(r["k"], r["chunk"]): r["count"] for r in history.with_chunks(rows, "k", "t", 100).groupBy("k", "chunk").count().collect()}
    assert sizes.pop(("cold", 0)) == 1 and sum(sizes.values()) == 1000 and len(sizes) >= 10 and max(sizes.values()) <= 130


def test_empty(spark):
    assert history.versions(spark.createDataFrame([], SCHEMA)).count() == 0
