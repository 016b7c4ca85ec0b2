import random

import pytest
from pyspark.sql import functions as F

from goldenloom import catalog
from goldenloom.delivery import cluster, pipeline, scan
from goldenloom.functions import text as X
from goldenloom.operators import analytics as A
from goldenloom.operators import changes as H
from goldenloom.operators import components as C
from goldenloom.operators import entities as E
from goldenloom.operators import graph as G
from goldenloom.operators import lineage as L
from goldenloom.operators import resolution as R
from goldenloom.operators import similarity as S
from goldenloom.operators import survivorship as V
from goldenloom.sources import ingest
from goldenloom.streaming import windows


def test_every_oracle_has_a_query():
    assert catalog.oracles().keys() <= catalog.queries().keys()


@pytest.mark.parametrize("a,b,score", [("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("", "x", 0.0), ("abc", "abc", 1.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, score):
    assert round(X.jaro_winkler_of(a, b), 4) == score == round(X.jaro_winkler_of(b, a), 4)


def test_ratios():
    assert X.token_sort_ratio_of("b a", "a b") == 1.0
    assert X.partial_token_sort_ratio_of("oak street", "12 oak street north") > 0.6
    assert X.indel_ratio_of("", "") == 1.0


def test_components_match_union_find(spark):
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["id"]: r["component"] for r in C.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}


def test_cosine_prefix_filter_loses_nothing(spark):
    rng = random.Random(2)
    texts = [rng.choices(["bolt", "valve", "steel", "ring", "pump", "red", "blue", "hall"], k=rng.randint(1, 4)) for _ in range(60)] + [[]]
    rows = spark.createDataFrame([("product", f"{i:02}", t) for i, t in enumerate(texts)], "entity_type string, id string, terms array<string>")
    got = {(r["id_a"], r["id_b"]) for r in S.cosine_pairs(rows, 0.6).collect()}

    def cos(a, b):
        from collections import Counter

        x, y = Counter(a), Counter(b)
        return sum(x[t] * y[t] for t in x) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5 if a and b else 0

    assert got == {(f"{i:02}", f"{j:02}") for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and round(cos(a, b), 4) >= 0.6}


def test_vector_blocks_agree_with_one_block(spark):
    rng = random.Random(4)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)], "vec_id bigint, embedding array<float>")
    one, many = (S.vector_top_k(v, v.where("vec_id % 10 = 0"), 3, *size) for size in ((1000, 20000), (4, 25)))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_graph_cycle_and_self(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "a", "t")], "source string, target string, type string")
    assert {(r["node"], r["origin"], r["hops"]) for r in G.provenance(edges).collect()} == {("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("a", "c", 2), ("b", "a", 2), ("c", "b", 2)}
    pairs = spark.createDataFrame([("a", "a"), ("a", "c"), ("a", "z")], "source string, target string")
    assert {tuple(r) for r in G.shortest_hops(edges, pairs, 3).collect()} == {("a", "a", 0), ("a", "c", 1)}


def test_upsert_and_insert_ignore(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, n int")
    assert {tuple(r) for r in E.upsert(old, new, "id", "n").collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {tuple(r) for r in E.insert_ignore(old, new.where("n = 1"), "id").collect()} == {(1, "a"), (2, "b"), (3, "e")}


def test_golden_majority_tie_takes_first_entity(spark):
    rows = [("g", e, "sap_erp", {"city": c}, None) for e, c in (("e1", "x"), ("e2", "y"), ("e3", "y"), ("e4", "x"))]
    df = spark.createDataFrame(rows, "golden_record_id string, entity_id string, source string, fields map<string,string>, updated_at timestamp")
    assert V.by_majority(V.values(df)).first()["value"] == "x"


def test_csv_and_json_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Id,Full  Name,E-Mail\nx1, Ann ,\n,Bob,b@x.org\n,,\n", encoding="utf-8")
    rows = {r["entity_id"]: r["fields"] for r in ingest.read_csv(spark, str(tmp_path / "a.csv"), "customer").collect()}
    assert rows.pop("x1") == {"full_name": "Ann"} and list(rows.values()) == [{"full_name": "Bob", "e_mail": "b@x.org"}]
    (tmp_path / "b.json").write_text('{"id": "y", "fields": {"name": "N", "x": ""}}\n')
    assert ingest.read_json(spark, str(tmp_path / "b.json"), "customer").first()["fields"] == {"name": "N"}


def test_envelopes_and_manifests(spark):
    raw = spark.createDataFrame([('{"event_id": "1", "event_type": "entity.merged"}',), ("{",), (None,)], "value string")
    good, bad = ingest.parse_events(raw)
    assert good.first()["topic"] == "mdm.entity.merged" and good.first()["partition_key"] == "1" and bad.count() == 2
    m = spark.createDataFrame([("r", "Django==3.2\n# x\nfoo\nPyYAML>=5.4  ; x\n")], "path string, content string")
    assert {(r["package"], r["version"]) for r in ingest.requirements(m).collect()} == {("django", "3.2"), ("pyyaml", "5.4")}
    assert {r["advisory"] for r in scan.advisories(ingest.requirements(m).select("package", "version")).collect()} == {"CVE-2023-24580", "CVE-2023-23969", "CVE-2020-14343"}
    p = spark.createDataFrame([("p", '{"dependencies": {"axios": "^1.5.0"}}')], "path string, content string")
    assert ingest.package_json(p).first()["version"] == "1.5.0"


def test_streaming_deduplicates_and_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT id DIV 2 AS event_id, timestamp_seconds(1700000000 + id * 10) AS ts, 1L AS user_id FROM range(40)").write.parquet(src)
    stream = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint").parquet(src)
    q = windows.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    q = windows.rate_limited(stream, 5).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rates").selectExpr("sum(requests)").first()[0] == 40 and spark.table("rates").where("limited").count() > 0


def entities(spark, rows):
    cols = "entity_type string, entity_id string, fields map<string,string>, status string, source string, tags array<string>, version int, term string, id string"
    return spark.createDataFrame([(k, i, f, "active", "api", ["a"], 1, "clash", "clash") for k, i, f in rows], cols)


def test_equal_and_foreign_names_of_every_type_are_linked(spark):
    kinds = ("customer", "supplier", "employee", "product", "asset", "location")
    party = {"name": "Zürich Größe Werke", "email": "info@zuerich.example", "city": "Zürich"}
    rows = [(k, f"{k}{i}", f) for k in kinds for i, f in enumerate((party, party, party | {"name": "ＺÜRICH Grösse  Werke"}, {"name": "東京製作所"}))]
    cur = entities(spark, rows)
    scored = S.pair_scores(cur)
    got = {(r["id_a"], r["id_b"]): r["fuzzy"] for r in scored.collect()}
    same = X.jaro_winkler_of("zürich größe werke", "zürich grösse werke")
    assert got == {(f"{k}0", f"{k}2"): round((0.3 * same + 0.3) / 0.6, 4) for k in kinds}
    clusters = {r["cluster"]: (r["members"], r["max_score"]) for r in S.clusters(cur, scored, 0.8).collect()}
    assert clusters == {f"{k}0": (3, 1.0) for k in kinds}
    assert {r["entity_id"]: r["id"] for r in S.membership(cur).collect()}["customer1"] == "customer0"
    assert S.clusters(cur.limit(0), S.pair_scores(cur.limit(0)), 0.8).count() == 0


def test_scores_that_tokens_cannot_reach_are_the_only_ones_left_out():
    assert round(0.65 * 1.0 + 0.35 * S.least_cosine(0.8), 4) <= 0.8 and S.least_cosine(0.8) > 0.428


def test_duplicates_and_queue(spark):
    scored = spark.createDataFrame([("a", "b", 0.9, 0.9, 0.97), ("b", "c", 0.9, 0.9, 0.96), ("c", "d", 0.8, 0.8, 0.85), ("x", "y", 0.9, 0.9, 0.97)], "id_a string, id_b string, fuzzy double, cosine double, combined double")
    asked = spark.createDataFrame([("b",)], "id string")
    assert [(r["candidate"], r["rank"]) for r in S.duplicates_of(scored, asked).orderBy("rank").collect()] == [("a", 1), ("c", 2)]
    assert {(r["id_a"], r["id_b"]) for r in R.auto_merges(scored).collect()} == {("a", "b"), ("x", "y")}
    items = R.queue(scored)
    assert [(r["id_a"], r["status"]) for r in items.collect()] == [("c", "pending")]
    item = items.first()["queue_id"]
    known = spark.createDataFrame([("c",), ("d",)], "entity_id string")
    for decision, ids, status, reason in (((item, True, None), known, "approved", None), ((item, True, None), known.limit(1), "failed", None), ((item, False, None), known, "rejected", "Manual rejection")):
        row = R.decided(items, spark.createDataFrame([decision], "queue_id string, approve boolean, reason string"), ids).first()
        assert (row["status"], row["reason"]) == (status, reason)


@pytest.mark.parametrize("a,b,strategy,score", [
    (None, None, "jaro_winkler", None), ("x", None, "jaro_winkler", 0.0), (" ＡB ", "ab", "exact_normalized", 1.0), ("+1 (212) 555-0001", "2125550001", "phone_normalized", 1.0), ("-", "2125550001", "phone_normalized", 0.0),
    ("b a", "a b", "token_sort", 1.0), ("12 oak street", "oak street 12 zone", "token_partial", 1.0), ("Robert", "Rupert", "phonetic", 1.0), ("Robert", "Rita", "phonetic", 0.5), ("ab", "ab", "else", 1.0),
])
def test_field_strategies(a, b, strategy, score):
    assert R.match_field(a, b, strategy) == score


def test_pairs_by_field_strategies(spark):
    rows = [("1", "2", {"name": "Acme Corp", "email": "A@x.org", "phone": "1-2"}, {"name": "Acme Corp", "email": "a@x.org"}), ("1", "3", {}, {"x": ""})]
    df = spark.createDataFrame(rows, "id_a string, id_b string, a map<string,string>, b map<string,string>")
    got = {r["id_b"]: r for r in R.score_pairs(df).collect()}
    assert got["2"]["fuzzy"] == round((0.30 + 0.15) / 0.65, 4) and sorted(got["2"]["fields"]) == ["email", "name"] and got["2"]["recommendation"] == "review"
    assert got["3"]["fuzzy"] == 0.0 and got["3"]["recommendation"] == "reject" and got["3"]["decision"] is None


def test_resolve_against_all_pairs(spark):
    rng = random.Random(5)
    names = ["acme north works", "acme north work", "acme nroth works", "zebra hall", "zebra halls", "lone star"]
    rows = [("customer", f"c{i}", {"name": n, "email": f"{n[:4].strip()}@x.org", "city": rng.choice(["Rome", "Oslo"])}) for i, n in enumerate(names)]
    cur = entities(spark, rows)
    got = {(r["entity_id"], r["candidate"]): r["confidence"] for r in R.resolve(cur).collect()}
    pairs = spark.createDataFrame([(i, j, f, g) for _, i, f in rows for _, j, g in rows if i != j], "id_a string, id_b string, a map<string,string>, b map<string,string>")
    want = {(r["id_a"], r["id_b"]): r["final"] for r in R.score_pairs(pairs).where("final >= 0.75").collect()}
    assert want and got == want
    golden = {r["entity_id"]: (r["golden_record_id"], r["is_new"]) for r in R.golden_ids(cur, R.resolve(cur)).collect()}
    assert set(golden) == {f"c{i}" for i in range(6)} and golden["c5"] == ("c5", True)


def test_updates_merges_and_masks(spark):
    import datetime as dt

    cur = entities(spark, [("customer", "a", {"name": "A", "email": ""}), ("customer", "b", {"name": "B", "email": "b@x.org", "phone": "1"})])
    changes = spark.createDataFrame([("a", {"name": "", "city": "Rome"}, dt.datetime(2025, 1, 1))], "entity_id string, changed map<string,string>, at timestamp")
    new, audit = H.updated(cur, changes)
    assert new.first()["fields"] == {"name": "", "email": "", "city": "Rome"} and new.first()["version"] == 2 and audit.first()["before"] == {"name": "A", "email": ""}
    trust = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "entity_id string, overall double")
    pairs = spark.createDataFrame([("a", "b")], "id_a string, id_b string")
    one, two = H.merged(pairs, cur, trust).first(), H.merged(pairs, cur).first()
    assert one["fields"]["name"] == "B" and one["tags"] == ["a"] and two["fields"] == {"name": "A", "email": "b@x.org", "phone": "1"} and two["tags"] == []
    masked, log = H.remediated(cur, spark.createDataFrame([("b", "pii", "email"), ("a", "trust", "")], "entity_id string, kind string, field string"))
    assert masked.first()["fields"]["email"] == H.MASK and {r["action"] for r in log.collect()} == {"pii_masked", "flagged_for_enrichment"}


@pytest.mark.parametrize("line,rule,severity", [
    ('cursor.execute("SELECT " + x)', "V001", "CRITICAL"), ('os.system("ls " + x)', "V002", "CRITICAL"), ("x.innerHTML = y", "V003", "HIGH"), ("open(a + b)", "V004", "HIGH"), ("requests.get(request.args)", "V005", "HIGH"),
    ("pickle.loads(x)", "V006", "CRITICAL"), ("hashlib.md5(x)", "V007", "HIGH"), ('SECRET_KEY = "abcdefgh1"', "V008", "HIGH"), ("redirect(request.args)", "V009", "MEDIUM"), ("etree.parse(x)", "V010", "HIGH"),
    ('re.compile("(a+)+")', "V011", "MEDIUM"), ("DEBUG = True", "V012", "MEDIUM"),
])
def test_code_rules(spark, line, rule, severity):
    files = spark.createDataFrame([("f", f"# {line}\nx = 1\n{line}", "python"), ("g", line, "cobol"), ("h", None, "python")], "path string, content string, language string")
    assert [(r["path"], r["line"], r["rule_id"], r["severity"]) for r in scan.code_findings(files).collect()] == [("f", 3, rule, severity)]


def test_config_rules_and_fixes(spark):
    docker = "FROM a:latest\nRUN pip install x\nCMD run"
    files = spark.createDataFrame([("d", docker), ("h", "replicaCount: 1"), ("e", "")], "path string, content string")
    got = {(r["path"], r["rule_id"], r["line"]) for r in scan.config_findings(files).collect()}
    assert {x for x in got if x[0] == "d"} == {("d", "D001", 1), ("d", "D003", 0), ("d", "D006", 0), ("d", "D010", 2)}
    assert {x[1] for x in got if x[0] == "h"} == {"H001", "H003", "H005", "H006", "H007"} and {x[1] for x in got if x[0] == "e"} == {"D003", "D006", "C003", "H001", "H003", "H005", "H006"}
    fixed = {r["path"]: r["content"] for r in scan.fixed_dockerfiles(files).collect()}
    assert fixed["d"] == "FROM a:stable\nRUN pip install x\nUSER nonroot\nCMD run"


def test_flat_json_keeps_its_fields(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "y", "name": "N", "x": "", "n": 3}\n{"fields": {"name": "M"}}\n')
    rows = {r["fields"].get("name"): (r["entity_id"], r["fields"]) for r in ingest.read_json(spark, str(tmp_path / "a.json"), "customer").collect()}
    assert rows["N"] == ("y", {"name": "N", "n": "3"}) and rows["M"][1] == {"name": "M"}


def test_latest_trust_keeps_one_score_of_each_entity(spark, tmp_path):
    rows = "SELECT 'a' AS entity_id, id / 10D AS overall, timestamp_seconds(1700000000 + id) AS computed_at FROM range(3) UNION ALL SELECT NULL, 1D, current_timestamp()"
    for i, extra in enumerate(("", " UNION ALL SELECT 'a', 0.9D, timestamp_seconds(1699999999) UNION ALL SELECT 'a', 0.5D, timestamp_seconds(1700000009)")):
        spark.sql(f"SELECT * FROM ({rows if i == 0 else 'SELECT NULL AS entity_id, 0D AS overall, current_timestamp() AS computed_at'}{extra})").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity_id string, overall double, computed_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windows.latest_trust(stream).writeStream.format("memory").queryName("trust").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r["overall"], None if r["change"] is None else round(r["change"], 6)) for r in spark.table("trust").orderBy("computed_at").collect()]
    assert got[-1] == (0.5, 0.3) and 0.9 not in {a for a, _ in got[1:]}


def test_scored_ingest_and_filters(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES ('a', 'customer', 'sap_erp', map('name', 'A', 'email', ' ')), ('b', 'customer', NULL, map('name', '')), (NULL, 'customer', 'x', map('name', 'C')) t(entity_id, entity_type, source, fields)").withColumn(
        "created_at", F.lit("2025-12-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity_id string, entity_type string, source string, fields map<string,string>, created_at timestamp").parquet(str(tmp_path / "in"))
    windows.scored_ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "bad")).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row["entity_id"] == "a" and row["fields"] == {"name": "A"} and row["tier"] in ("silver", "bronze") and spark.read.parquet(str(tmp_path / "bad")).count() == 2
    events = spark.createDataFrame([("customer", 0.9), ("supplier", 0.9), ("customer", 0.1), ("customer", None)], "entity_type string, combined double")
    assert windows.resolutions(events, "customer", 0.5).count() == 1
    e = spark.sql("SELECT timestamp_seconds(1700000000 + id * 600) AS ts, 1L AS user_id FROM range(6)")
    assert windows.sessions(e, "5 minutes").count() == 6 and windows.sessions(e, "15 minutes").count() == 1 and windows.sliding(e).selectExpr("sum(events)").first()[0] == 12


def test_lineage_of_merges(spark):
    pairs = spark.createDataFrame([("a", "b"), ("c", "d")], "id_a string, id_b string")
    events = L.merge_events(pairs, H.merged_id("id_a", "id_b"), "2026-01-01")
    assert L.downstream(events).count() == 4 and L.stats(events).where("operation = 'merged_into'").first()["entities"] == 4
    new = events.where("operation = 'merged' AND array_contains(sources, 'a')").select("entity_id")
    assert {(r["entity_id"], r["own"]) for r in L.lineage_of(events, new).collect()} == {(new.first()[0], True), ("a", False), ("b", False)}
    assert {r["type"] for r in L.edges(events).collect()} == {"DERIVED_FROM"} and L.simple_events(pairs.selectExpr("id_a AS entity_id", "NULL AS source"), "enriched", "2026-01-01").count() == 2


def test_percentiles_in_two_levels(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 5.0, None])) for _ in range(3000)] + [("one", 7.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["p0"], r["p1"]) for r in A.exact_percentiles(df, "k", "v", (0.5, 0.95)).collect()}
    want = {r["k"]: tuple(r["p"]) for r in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.95))).alias("p")).where("p[0] IS NOT NULL").collect()}
    assert set(got) == set(want) and all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k]))


def test_paths_subgraphs_and_dependents(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("a", "x", "t"), ("x", "c", "t"), ("c", "d", "DERIVED_FROM"), ("b", "d", "DERIVED_FROM"), ("d", "b", "DERIVED_FROM")], "source string, target string, type string")
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("a", "zz")], "source string, target string")
    assert {tuple(r) for r in G.shortest_paths(edges, pairs, 4).collect()} == {("a", "d", 2, "a>b>d"), ("a", "a", 0, "a")}
    near = G.neighborhood(edges, spark.createDataFrame([("a",)], "node string"), 1)
    assert {(r["source"], r["target"]) for r in G.subgraph(edges, near, ("t",)).collect()} == {("a", "b"), ("a", "x")}
    assert {r["node"]: r["dependents"] for r in G.inbound(edges, spark.createDataFrame([("d",), ("a",)], "node string")).collect()} == {"d": 2, "a": 0}
    assert G.upsert_edges(edges, edges).count() == 7
    nodes = spark.createDataFrame([("a", "A", "n"), ("b", "B", "n")], "id string, label string, name string")
    assert G.upsert_nodes(nodes, nodes.limit(1)).count() == 2 and {r["rule"]: r["broken"] for r in G.broken_constraints(nodes, edges).collect()}["edge_ends_known"] == 6


def test_only_reading_statements(spark):
    assert E.read_only(spark, "SELECT 1 AS x").first()["x"] == 1
    for bad in ("DROP TABLE t", "INSERT INTO t VALUES (1)", "CREATE TABLE t (a INT)", "nonsense"):
        with pytest.raises(ValueError):
            E.read_only(spark, bad)


def test_pods_and_drift(spark):
    pods = [("p1", "Pending", None, [("c", 9, "CrashLoopBackOff", "OOMKilled", False)]), ("p2", "Running", "Evicted", [("c", 9, "", "", True)]), ("p3", "Running", None, [("c", 9, "CrashLoopBackOff", "OOMKilled", False), ("d", 6, None, None, None)]), ("p4", "Running", None, [])]
    df = spark.createDataFrame(pods, "pod string, phase string, reason string, containers array<struct<name:string,restarts:int,waiting:string,terminated:string,ready:boolean>>")
    got = {(r["pod"], r["container"], r["issue_type"]) for r in cluster.pod_issues(df).collect()}
    assert got == {("p1", "", "Pending"), ("p2", "", "Evicted"), ("p3", "c", "CrashLoopBackOff"), ("p3", "c", "OOMKilled"), ("p3", "c", "NotReady"), ("p3", "d", "HighRestartCount")}
    leaves = "resource string, path string, value string"
    a, b = spark.createDataFrame([("r", "image", "x:1"), ("r", "labels.a", "1")], leaves), spark.createDataFrame([("r", "image", "x:2"), ("r", "hostPID", "true")], leaves)
    drift = cluster.manifest_drift(a, b)
    assert {(r["path"], r["severity"]) for r in drift.collect()} == {("image", "HIGH"), ("labels.a", "MEDIUM"), ("hostPID", "CRITICAL")}
    assert [r["action"] for r in cluster.reconciliation(drift, "resource").orderBy("step").collect()] == ["IMMEDIATE_REVIEW", "AUTO_RECONCILE", "AUTO_RECONCILE", "MANUAL_FIX"]
    assert cluster.health(cluster.pod_issues(df).withColumn("ns", F.lit("n")), spark.createDataFrame([("n",), ("m",)], "ns string"), "ns").where("ns = 'm'").first()["status"] == "healthy"


def test_project_files(spark):
    m = spark.createDataFrame([("p", "<dependency><artifactId> log4j-core </artifactId>\n<version>2.14.0</version></dependency><artifactId>x</artifactId><version>1</version>")], "path string, content string")
    assert {(r["package"], r["version"]) for r in ingest.pom_xml(m).collect()} == {("log4j-core", "2.14.0"), ("x", "1")}


def test_signed_webhooks(spark):
    import hashlib
    import hmac

    for secret in ("short", "x" * 100):
        sign = "sha256=" + hmac.new(secret.encode(), "päyload".encode(), hashlib.sha256).hexdigest()
        hooks = spark.createDataFrame([("päyload", sign), ("päyload", "sha256=0"), ("other", sign), ("päyload", None)], "body string, signature string")
        assert [tuple(r) for r in pipeline.genuine(hooks, secret).collect()] == [("päyload", sign)]
    assert pipeline.genuine(hooks, "").count() == 4


def test_webhooks_of_two_hosts(spark):
    push = '{"ref": "refs/heads/main", "after": "0123456789", "%s": {"%s": "o/r"}, %s, "commits": [{"added": ["a.py", "k8s/x.yaml"], "removed": ["a.py"]}]}'
    rows = [(1, "github_push", push % ("repository", "full_name", '"pusher": {"name": "ann"}')), (2, "gitlab_push", push % ("project", "path_with_namespace", '"user_name": "bob"')), (3, "github_push", "{"), (4, "else", None)]
    got = {r["event_id"]: r for r in pipeline.webhook_events(spark.createDataFrame(rows, "event_id int, hook string, body string")).collect()}
    assert [(got[i]["source"], got[i]["author"], got[i]["branch"], got[i]["commit_sha"], got[i]["files"]) for i in (1, 2)] == [("github", "ann", "main", "01234567", ["a.py", "k8s/x.yaml"]), ("gitlab", "bob", "main", "01234567", ["a.py", "k8s/x.yaml"])]
    assert got[1]["infra"] and got[1]["production"] and not got[1]["dependencies"] and got[3]["repository"] == "unknown" and got[4]["event_type"] == "manual"


def test_samples_of_two_types(spark, tmp_path):
    for t in ("customer", "supplier"):
        (tmp_path / f"{t}.csv").write_text(f"id,name\n{t[0]}1,A\n")
    got = ingest.read_samples(spark, customer=str(tmp_path / "customer.csv"), supplier=str(tmp_path / "supplier.csv")).collect()
    assert {(r["entity_id"], r["entity_type"]) for r in got} == {("c1", "customer"), ("s1", "supplier")}


def test_ci_suggestions_and_savings(spark):
    files = spark.createDataFrame([("a", "run: pip install x\nrun: npm install\nrun: pytest"), ("b", "timeout-minutes: 5\ncache")], "path string, content string")
    runs = spark.createDataFrame([("b", 700.0, True, 1)] * 3, "path string, seconds double, failed boolean, retries int")
    found = pipeline.ci_suggestions(files, runs)
    assert {(r["path"], r["rule_id"], r["savings"]) for r in found.collect()} == {("a", "O001", 120), ("a", "O002", 180), ("a", "O010", 180), ("a", "O020", 0), ("a", "O031", 60), ("b", "O050", 280), ("b", "O060", 135)}
    assert {r["path"]: r["dollars_a_month"] for r in pipeline.monthly_savings(found).collect()} == {"a": 43.2, "b": 33.2}
