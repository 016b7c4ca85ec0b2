"""Pairs found and scored in cells: nothing lost, and no pair sent before it is known to count."""

import glob
import random

import numpy as np
import pyarrow as pa
import pytest
from test_core import entities

from goldenloom import session
from goldenloom.functions import strings
from goldenloom.functions import text as X
from goldenloom.operators import cells
from goldenloom.operators import resolution as R
from goldenloom.operators import similarity as S
from goldenloom.plans import changes, meaning
from goldenloom.rules import FUZZY_WEIGHTS_DEV


def sent_after(df):
    """Exchanges and joins of the plan that come after the cells."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")
    return [line for line in plan[0].splitlines() if "Exchange" in line or "Join" in line] if len(plan) > 1 else ["no cells"]


def people(spark, n=40, seed=3):
    rng = random.Random(seed)
    first, last = ["anna", "anne", "bert", "berta"], ["northwell", "northwel", "southby", "eastham"]
    rows = []
    for i in range(n):
        name = f"{rng.choice(first)} {rng.choice(last)} {rng.choice(['ltd', 'works', ''])}"
        rows.append((rng.choice(["customer", "supplier"]), f"e{i:03}", {"name": name, "email": rng.choice(["info@x.org", "sales@y.org", "", None]), "city": rng.choice(["Rome", "Oslo"]), "note": str(i % 7)}))
    return entities(spark, rows)


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(cells, "CELL", 6)


def brute(cur):
    rows = [(r["entity_type"], r["id"], r["fields"], r["t"]) for r in S.profiles(cur).select("entity_type", "id", "fields", S.text_terms(S.F.col("fields")).alias("t")).collect()]
    out = {}
    for k, i, f, t in rows:
        for m, j, g, u in rows:
            if k == m and i < j:
                dot = sum(t.count(w) * u.count(w) for w in set(t))
                cosine = round(dot / (sum(t.count(w) ** 2 for w in set(t)) ** 0.5 * sum(u.count(w) ** 2 for w in set(u)) ** 0.5), 4)
                both = [(w, X.jaro_winkler_of(S.clean(f[n]), S.clean(g[n]))) for n, w in FUZZY_WEIGHTS_DEV.items() if f.get(n) and g.get(n)]
                exact = sum(w * s for w, s in both) / sum(w for w, _ in both)
                if cosine >= S.least_cosine(0.80):
                    out[k, i, j] = pytest.approx((exact, cosine, 0.65 * exact + 0.35 * cosine), abs=1e-4)
    return out


def test_combined_scores_of_all_pairs_without_sending_pairs(spark, small):
    cur = people(spark)
    scored = S.pair_scores(cur)
    assert {(r["entity_type"], r["id_a"], r["id_b"]): (r["fuzzy"], r["cosine"], r["combined"]) for r in scored.collect()} == brute(cur)
    assert not sent_after(scored)


def test_clusters_from_a_forest_of_each_cell(spark, small):
    cur = people(spark, 60)
    edges = S.reached_edges(cur, 0.8)
    assert not sent_after(edges)
    n, pairs = S.profiles(cur).count(), S.pair_scores(cur, 0.8, reached=True).count()
    assert edges.where("a <> b").count() < pairs and edges.count() <= n * -(-n // cells.CELL + 3)
    want = {tuple(r) for r in S.clusters(cur, S.pair_scores(cur), 0.8).collect()}
    assert {tuple(r) for r in S.connected(cur, edges).collect()} == want and want


def test_pairs_of_asked_profiles_only(spark, small):
    cur = people(spark)
    asked = cur.where("entity_id LIKE '%5'").select(S.F.col("entity_id").alias("id"))
    ids = {r["id"] for r in asked.collect()}
    want = {tuple(r) for r in S.pair_scores(cur).where("combined >= 0.8").collect() if {r["id_a"], r["id_b"]} & ids}
    got = [tuple(r) for r in S.pair_scores(cur, 0.8, reached=True, asked=asked).collect()]
    assert set(got) == want and len(got) == len(want) > 0


def test_bands_and_remediation_take_pairs_from_cells(spark, small, monkeypatch):
    cur = people(spark)
    monkeypatch.setattr(meaning, "_active", lambda s, d: cur)
    want = S.pair_scores(cur).where("combined >= 0.8")
    bands = meaning.QUERIES["pair_bands"](spark, "")
    assert sum(r["pairs"] for r in bands.collect()) == want.count() > 0
    assert all("Join" not in line for line in sent_after(bands))
    seen = []
    monkeypatch.setattr(S, "pair_scores", lambda *a, **k: seen.append(a))
    assert meaning._clusters(spark, "").count() and not seen


def test_a_cosine_that_rounds_to_the_threshold_is_found(spark):
    rows = spark.createDataFrame([("product", "a", ["sss"] * 10 + ["uuu"] * 21 + ["www"] * 2), ("product", "b", ["sss"])], "entity_type string, id string, terms array<string>")
    found = S.cosine_pairs(rows, S.least_cosine(0.80))
    assert [tuple(r) for r in found.collect()] == [("product", "a", "b", 0.4284)] and not sent_after(found)


def test_fuzzy_scores_many_at_a_time_are_the_scalar_ones():
    rng = random.Random(1)
    texts = list({"".join(rng.choices("abcé 1", k=rng.choice((0, 1, 2, 5, 9, 30, 64, 65)))) for _ in range(120)} | {chr(0x4E00 + i) * 3 for i in range(150)})
    many = strings.Strings(texts)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    assert many.jaro_winkler(a, b).tolist() == [X.jaro_winkler_of(texts[i], texts[j]) for i, j in zip(a, b)]
    assert strings.rounded(np.array([0.42835, 0.00005, 0.1]), 4).tolist() == [0.4284, 0.0001, 0.1]
    assert strings.coded(pa.array(["A", None, "a", ""]), str.lower)[0].tolist() == [0, -1, 0, -1]


def parties(spark, n=50, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        f = {"name": rng.choice(["north works", "north work", "nroth works", "zebra hall"]), "email": rng.choice(["info@x.org", "INFO@x.org ", "", None]), "phone": rng.choice(["+1 555 0101", "15550101", "-", None])}
        f |= {"company_name": rng.choice(["north works ltd", "ltd north works", None]), "address": rng.choice(["12 long road rome", "long road 12", "12 long rd", None]), "city": rng.choice(["Rome", "Roma"]), "note": str(i % 9)}
        rows.append(("customer", f"c{i:03}", f))
    return entities(spark, rows)


def test_candidates_are_scored_in_cells_like_all_pairs(spark, small):
    cur = parties(spark)
    rows = [(r["id"], r["fields"]) for r in S.profiles(cur).select("id", "fields").collect()]
    pairs = spark.createDataFrame([(i, j, f, g) for i, f in rows for j, g in rows if i < j], "id_a string, id_b string, a map<string,string>, b map<string,string>")
    want = R.score_pairs(pairs).where("final >= 0.75").select("id_a", "id_b", "scores", "fuzzy", "semantic", "final", "fields")
    near = R.near_pairs(S.profiles(cur), 0.75)
    got = R.judged(near).where("final >= 0.75").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 20
    assert not sent_after(near)


def test_golden_ids_need_sure_candidates_only(spark, small, monkeypatch):
    cur = parties(spark)
    monkeypatch.setattr(changes, "_cur", lambda s, d: cur)
    seen, resolve = [], R.resolve
    monkeypatch.setattr(R, "resolve", lambda e, t=R.REVIEW: seen.append(t) or resolve(e, t))
    got = {tuple(r) for r in changes.QUERIES["resolve_golden_ids"](spark, "").collect()}
    assert got == {tuple(r) for r in R.golden_ids(cur, resolve(cur)).collect()} and any(not r[2] for r in got)
    assert seen == [R.AUTO]


@pytest.mark.parametrize("query", ["tf_cosine_pairs", "fuzzy_pair_scores"])
def test_files_of_pairs_hold_one_cell_in_runs(spark, small, monkeypatch, query):
    """F6, F8: the result itself filled the disk, so a task writes the pairs of one cell and one of both ids stays the same for long."""
    cur = people(spark, 60)
    monkeypatch.setattr(meaning, "_active", lambda s, d: cur)
    rows = meaning.QUERIES[query](spark, "").withColumn("file", S.F.spark_partition_id()).collect()
    files = {}
    for r in rows:
        files.setdefault(r["file"], []).append(r)
    assert {(r["entity_type"], r["id_a"], r["id_b"]) for r in rows} == set(brute(cur)) and len(rows) == len(brute(cur)) > 300
    for own in files.values():
        assert len({r["entity_type"] for r in own}) == 1
        steps = sum(x["id_a"] != y["id_a"] and x["id_b"] != y["id_b"] for x, y in zip(own, own[1:]))
        ids = {r["id_a"] for r in own} | {r["id_b"] for r in own}
        assert steps < len(ids)


def test_rows_are_written_once_and_only_numbers_of_cells_are_sent(spark, small, monkeypatch):
    """F8: the rows were sent once for each block of their type, so shuffle files grew with the square of the rows and filled the disk."""
    cur = people(spark, 60)
    monkeypatch.setattr(meaning, "_active", lambda s, d: cur)
    scored = meaning.QUERIES["fuzzy_pair_scores"](spark, "")
    below = scored._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow", 1)[1]
    assert "Exchange" in below and "terms" not in below and "values" not in below
    root = session._roots[-1][1]
    assert spark.read.parquet(f"{root}/blocks").count() == S.profiles(cur).count()
    assert not glob.glob(root.removeprefix("file:") + "/rows")
    assert {(r["entity_type"], r["id_a"], r["id_b"]): r["fuzzy"] for r in scored.collect()} == {k: pytest.approx(v.expected[0], abs=1e-4) for k, v in brute(cur).items()}


def test_equal_pairs_of_values_are_compared_once(monkeypatch):
    many, seen, each = strings.Strings(["anna", "anne", "bert"]), [], strings.Strings._each
    monkeypatch.setattr(strings.Strings, "_each", lambda self, a, b: seen.extend(zip(a.tolist(), b.tolist())) or each(self, a, b))
    got = many.jaro_winkler(np.array([0, 1, 0, 0, 2]), np.array([1, 0, 1, 0, 1]))
    assert got.tolist() == [X.jaro_winkler_of(many.texts[i], many.texts[j]) for i, j in ((0, 1), (1, 0), (0, 1), (0, 0), (2, 1))] and sorted(seen) == [(0, 0), (0, 1), (1, 0), (2, 1)]
    assert many.jaro_winkler(np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_small_steps_are_scored_together():
    steps = [(np.array([i]), np.array([i + 1]), np.array([1.0])) for i in range(5)]
    assert [[x.tolist() for x in own] for own in S.gathered(iter(steps))] == [[[0, 1, 2, 3, 4], [1, 2, 3, 4, 5], [1.0] * 5]] and not list(S.gathered(iter([])))
