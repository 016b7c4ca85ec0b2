"""Queries and oracles: graph, lineage, analytics, delivery telemetry."""

from pyspark.sql import functions as F

from goldenloom import rules
from goldenloom.delivery import scan
from goldenloom.delivery import telemetry as M
from goldenloom.operators import analytics as A
from goldenloom.operators import entities as E
from goldenloom.operators import graph as G
from goldenloom.plans.scores import CUR
from goldenloom.session import table


def _edges(s, d):
    return G.trade_edges(*[table(s, d, t) for t in ("customer", "supplier", "nation")])


def _merges(s, d):
    return G.merge_edges(table(s, d, "resolution_results"))


def _regions(s, d):
    return table(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))


def _paths(s, d):
    pairs = _regions(s, d).select(F.col("node").alias("source"), F.lit("r0").alias("target"))
    return G.shortest_hops(_edges(s, d), pairs, 4)


def _dependencies(s, d):
    """Versions of the advisories' packages as the parts table spreads them: p_size as major, p_partkey as minor."""
    names = s.createDataFrame([(i, a[0].replace("-", "_").upper()) for i, a in enumerate(rules.ADVISORIES)], "i int, package string")
    parts = table(s, d, "part").select((F.col("p_partkey") % len(rules.ADVISORIES)).cast("int").alias("i"), F.concat_ws(".", (F.col("p_size") % 7).cast("string"), (F.col("p_partkey") % 40).cast("string"), F.lit("1")).alias("version"))
    return parts.join(F.broadcast(names), "i").select("package", "version").distinct()


def _topics(s, d):
    e = table(s, d, "events").withColumn("kind", F.when(F.col("event_type") == "signup", "entity.ingested").when(F.col("event_type") == "purchase", "entity.merged").otherwise(F.concat(F.lit("web."), "event_type")))
    return e.groupBy(A.topic_of(F.col("kind")).alias("topic")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("keys"))


def _integrity(s, d):
    """Rule name and number of rows that break it."""
    r, t = table(s, d, "resolution_results"), table(s, d, "trust_scores")
    ids = E.current(table(s, d, "entities")).select("entity_id")
    rows = [
        ("score_in_range", t.where("NOT (overall BETWEEN 0 AND 1)")), ("pair_with_itself", r.where("golden_record_id = entity_id")),
        ("result_id_unique", r.groupBy("result_id").count().where("count > 1")), ("candidate_known", r.where("entity_id IS NOT NULL").join(ids, "entity_id", "left_anti")),
    ]
    parts = [df.agg(F.lit(n).alias("rule"), F.count("*").alias("broken")) for n, df in rows]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {
    "graph_stats": lambda s, d: G.stats(_edges(s, d)),
    "graph_impact": lambda s, d: G.impact(_edges(s, d)),
    "graph_neighborhood": lambda s, d: G.neighborhood(_edges(s, d), _regions(s, d), 2),
    "graph_shortest_path": _paths,
    "lineage_stats": lambda s, d: A.lineage_stats(table(s, d, "entities")),
    "lineage_upstream": lambda s, d: G.provenance(_merges(s, d), 1).select("node", "origin"),
    "provenance_chain": lambda s, d: G.provenance(_merges(s, d)),
    "analytics_counts": lambda s, d: A.counts(E.current(table(s, d, "entities"))),
    "resolution_stats": lambda s, d: A.resolution_stats(table(s, d, "resolution_results")),
    "integrity_checks": _integrity,
    "copilot_intents": lambda s, d: A.intents(table(s, d, "documents")),
    "topic_routing": _topics,
    "rate_limit_windows": lambda s, d: A.rate_windows(table(s, d, "events"), 1000, "60 seconds"),
    "http_telemetry": lambda s, d: A.telemetry(table(s, d, "events")),
    "dependency_cves": lambda s, d: scan.advisories(_dependencies(s, d)),
    
    "load_smoothing": lambda s, d: M.smoothed(M.hourly(table(s, d, "events"))),
    "scaling_forecast": lambda s, d: M.scaling(M.smoothed(M.hourly(table(s, d, "events"))), "2026-01-02 09:45:00"),
    "right_sizing": lambda s, d: M.right_sizing(table(s, d, "events")),
    "load_variation": lambda s, d: M.variation(table(s, d, "events")),
    "hpa_thrash": lambda s, d: M.thrash(table(s, d, "events"), 600),
}

_E = """e AS (SELECT DISTINCT source, target FROM (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
      UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)), u AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e)"""
_ME = """me AS (SELECT DISTINCT golden_record_id AS source, entity_id AS target FROM resolution_results WHERE action IN ('auto_merge', 'approved')
      AND golden_record_id IS NOT NULL AND entity_id IS NOT NULL AND golden_record_id <> entity_id)"""
_KIND = "CASE WHEN deleted_at IS NOT NULL THEN 'deleted' WHEN merged_into IS NOT NULL THEN 'merged' WHEN captured_at = born THEN 'created' ELSE 'updated' END"
_INTENT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{k}')" for k in keys) + f" THEN '{n}'" for n, keys in rules.INTENTS) + " ELSE 'overview' END"
_VER = "list_transform(string_split(regexp_replace({0}, '[^0-9.]', '', 'g'), '.')[1:4], lambda p: coalesce(TRY_CAST(p AS INT), 0))"
_ADV = ", ".join(f"({i}, '{a[0]}', '{a[1]}', '{a[2]}', {a[3]}::DOUBLE, '{a[4]}')" for i, a in enumerate(rules.ADVISORIES))
_TOPIC = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.TOPICS.items()) + " ELSE 'mdm.' || kind END"
_HOURLY = "h AS (SELECT event_type, date_trunc('hour', ts) AS hour, round(least(1.0::DOUBLE, avg(value) / 100.0::DOUBLE), 6) AS load FROM events GROUP BY 1, 2)"
_SMOOTH = f"""{_HOURLY}, o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS i, count(*) OVER (PARTITION BY event_type) AS points FROM h),
      sm AS (SELECT event_type, i, points, load AS level FROM o WHERE i = 1 UNION ALL SELECT o.event_type, o.i, o.points, 0.3::DOUBLE * o.load + 0.7::DOUBLE * sm.level FROM sm JOIN o ON o.event_type = sm.event_type AND o.i = sm.i + 1),
      z AS (SELECT sm.event_type, sm.points, round(sm.level, 4) AS level, round(CASE WHEN sm.points >= 3 THEN (a.load - b.load) / 2.0::DOUBLE ELSE 0.0::DOUBLE END, 4) AS slope
        FROM sm JOIN o a ON a.event_type = sm.event_type AND a.i = sm.points LEFT JOIN o b ON b.event_type = sm.event_type AND b.i = sm.points - 2 WHERE sm.i = sm.points)"""

ORACLES = {
    "graph_stats": f"WITH {_E} SELECT 'LOCATED_IN' AS type, count(*) AS edges, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM e",
    "graph_impact": f"""WITH {_E}, x AS (SELECT a AS node, count(*) AS neighbours FROM u GROUP BY 1), o AS (SELECT source AS node, count(*) AS edges_out FROM e GROUP BY 1), i AS (SELECT target AS node, count(*) AS edges_in FROM e GROUP BY 1)
      SELECT node, neighbours, coalesce(edges_out, 0) AS edges_out, coalesce(edges_in, 0) AS edges_in FROM x LEFT JOIN o USING (node) LEFT JOIN i USING (node)""",
    "graph_neighborhood": f"""WITH RECURSIVE {_E}, r AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS node, 0 AS hops FROM region UNION SELECT r.seed, u.b, hops + 1 FROM r JOIN u ON u.a = r.node WHERE hops < 2)
      SELECT seed, node, min(hops) AS hops FROM r GROUP BY 1, 2""",
    "graph_shortest_path": f"""WITH RECURSIVE {_E}, r AS (SELECT 'r' || r_regionkey AS source, 'r' || r_regionkey AS node, 0 AS hops FROM region UNION SELECT r.source, u.b, hops + 1 FROM r JOIN u ON u.a = r.node WHERE hops < 4)
      SELECT source, node AS target, min(hops) AS hops FROM r WHERE node = 'r0' GROUP BY 1, 2""",
    "lineage_stats": f"""WITH b AS (SELECT entity_id, min(captured_at) AS born FROM entities WHERE entity_id IS NOT NULL AND captured_at IS NOT NULL GROUP BY 1),
      x AS (SELECT DISTINCT entity_id, captured_at, source, merged_into, deleted_at FROM entities WHERE captured_at IS NOT NULL)
      SELECT operation, count(*) AS events, count(DISTINCT entity_id) AS entities FROM (SELECT entity_id, {_KIND} AS operation FROM x JOIN b USING (entity_id)) GROUP BY 1""",
    "lineage_upstream": f"WITH {_ME} SELECT source AS node, target AS origin FROM me",
    "provenance_chain": f"""WITH RECURSIVE {_ME}, r AS (SELECT source AS node, target AS origin, 1 AS hops FROM me UNION SELECT r.node, me.target, hops + 1 FROM r JOIN me ON me.source = r.origin WHERE hops < 10)
      SELECT node, origin, min(hops) AS hops FROM r WHERE node <> origin GROUP BY 1, 2""",
    "analytics_counts": f"""WITH {CUR} SELECT 'type' AS kind, entity_type AS value, count(*) AS entities FROM cur GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM cur GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM cur GROUP BY 2""",
    "resolution_stats": """WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id) AS rn FROM resolution_results) WHERE rn = 1)
      SELECT entity_type, count(*) AS results, count(*) FILTER (action IN ('auto_merge', 'approved')) AS merged, count(*) FILTER (action = 'review') AS review,
      round(avg(CASE WHEN action IN ('auto_merge', 'approved') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS merge_rate, round(avg(combined), 4) AS avg_combined FROM r GROUP BY 1""",
    "integrity_checks": f"""WITH {CUR} SELECT 'score_in_range' AS rule, count(*) AS broken FROM trust_scores WHERE NOT (overall BETWEEN 0 AND 1) UNION ALL SELECT 'pair_with_itself', count(*) FROM resolution_results WHERE golden_record_id = entity_id
      UNION ALL SELECT 'result_id_unique', count(*) FROM (SELECT result_id FROM resolution_results GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'candidate_known', count(*) FROM resolution_results WHERE entity_id IS NOT NULL AND entity_id NOT IN (SELECT entity_id FROM cur)""",
    "copilot_intents": f"SELECT doc_id, {_INTENT} AS intent FROM documents WHERE text IS NOT NULL",
    "topic_routing": f"""WITH x AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'entity.ingested' WHEN 'purchase' THEN 'entity.merged' ELSE 'web.' || event_type END AS kind FROM events)
      SELECT {_TOPIC} AS topic, count(*) AS events, count(DISTINCT user_id) AS keys FROM x GROUP BY 1""",
    "rate_limit_windows": "SELECT user_id, strftime(time_bucket(INTERVAL '1 minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, count(*) > 1000 AS limited FROM events GROUP BY 1, 2",
    "http_telemetry": """SELECT event_type, count(*) AS requests, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 4) AS share, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1""",
    "dependency_cves": f"""WITH a(i, package, fixed, advisory, score, severity) AS (VALUES {_ADV}),
      dep AS (SELECT DISTINCT a.package, (p_size % 7) || '.' || (p_partkey % 40) || '.1' AS version FROM part JOIN a ON a.i = p_partkey % {len(rules.ADVISORIES)})
      SELECT package, version, advisory, score, severity FROM dep JOIN a USING (package) WHERE {_VER.format('version')} < {_VER.format('fixed')}""",
    "load_smoothing": f"WITH RECURSIVE {_SMOOTH} SELECT * FROM z",
    "scaling_forecast": f"""WITH RECURSIVE {_SMOOTH}, y AS (SELECT event_type, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, level + slope) * 1.3::DOUBLE), 4) AS load FROM z WHERE points >= 3)
      SELECT event_type, load, CASE WHEN load > 0.70 THEN 'scale_up' WHEN load < 0.30 THEN 'scale_down' ELSE 'keep' END AS action,
      CAST(CASE WHEN load > 0.70 THEN least(20, ceil(4 * load / 0.70::DOUBLE)) WHEN load < 0.30 THEN 2 ELSE 4 END AS INT) AS replicas FROM y""",
    "right_sizing": "SELECT user_id, count(*) AS samples, " + ", ".join(f'round(CAST(round(quantile_cont(value, {q}) * {k}::DOUBLE, 8) AS DECIMAL(18, 8)), 4)::DOUBLE AS "{n}"' for q, k, n in ((0.5, 1.1, "request"), (0.95, 1.3, "limit"), (0.99, 1.5, "peak"))) + " FROM events GROUP BY 1",
    "load_variation": "SELECT event_type, round(avg(value), 4) AS mean, round(var_pop(value), 4) AS variance, round(stddev_pop(value) / avg(value), 4) AS cv FROM events GROUP BY 1",
    "hpa_thrash": """WITH s AS (SELECT user_id, ts, event_id, sign(value - lag(value) OVER w) AS d1, epoch(ts) - epoch(lag(ts) OVER w) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      t AS (SELECT *, lag(d1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d0 FROM s)
      SELECT user_id, count(*) FILTER (d0 * d1 < 0 AND gap <= 36000) AS turns, round(avg(CASE WHEN d0 * d1 < 0 AND gap <= 36000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS share FROM t WHERE d0 IS NOT NULL GROUP BY 1""",
}
