"""Queries and oracles: resolution by fields, changes and merges of entities, retrieval, jobs, overviews."""

from pyspark.sql import functions as F

from goldenloom import rules
from goldenloom.operators import analytics as A
from goldenloom.operators import changes as H
from goldenloom.operators import entities as E
from goldenloom.operators import governance as G
from goldenloom.operators import graph
from goldenloom.operators import ontology as O
from goldenloom.operators import resolution as R
from goldenloom.operators import retrieval as X
from goldenloom.operators import survivorship as V
from goldenloom.operators import trust as T
from goldenloom.plans import meaning
from goldenloom.plans.scores import CUR, DEV, PII_DEV, QUALITY, VIOLATIONS
from goldenloom.session import table

AT = "2026-01-01 00:00:00"
QUESTIONS = ["steel bracket", "sorting line north hall", "valve"]


def _cur(s, d):
    return E.current(table(s, d, "entities"))


def _members(s, d):
    """Pairs of the members of formed groups: the first one with every other one."""
    c = table(s, d, "resolution_candidates").where("golden_record_id IS NOT NULL AND entity_id IS NOT NULL")
    c = c.groupBy("golden_record_id", "entity_id").agg(F.max_by("fields", F.struct("updated_at", "source", "confidence")).alias("fields"))
    first = c.groupBy("golden_record_id").agg(F.min_by(F.struct("entity_id", "fields"), "entity_id").alias("f"))
    pairs = c.join(first, "golden_record_id").where("entity_id <> f.entity_id")
    return pairs.select(F.col("f.entity_id").alias("id_a"), F.col("entity_id").alias("id_b"), F.col("f.fields").alias("a"), F.col("fields").alias("b"))


def _changes(s, d):
    """What customers say now, as changes of the customers among the entities."""
    c = table(s, d, "customers").where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("city", "phone"), F.struct("ingested_at", "updated_at")).alias("r"))
    changed = F.map_from_arrays(F.array(F.lit("city"), F.lit("phone")), F.array("r.city", "r.phone"))
    return c.select(F.col("id").alias("entity_id"), changed.alias("changed"), F.lit(AT).cast("timestamp").alias("at"))


def _merge_pairs(s, d):
    """One pair of every golden record that merges by itself: with its smallest linked id."""
    r = table(s, d, "resolution_results").where("action = 'auto_merge' AND golden_record_id IS NOT NULL AND entity_id IS NOT NULL AND golden_record_id <> entity_id")
    return r.groupBy(F.col("golden_record_id").alias("id_a")).agg(F.min("entity_id").alias("id_b"))


def _merged(s, d, by_trust=True):
    cur = _cur(s, d)
    out = H.merged(_merge_pairs(s, d), cur, T.scores_dev(cur) if by_trust else None)
    fields = F.array_join(F.transform(F.filter(F.array_sort(F.map_entries("fields")), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return out.select(F.array_join("merged_from", "+").alias("merged_from"), "entity_type", "source", fields.alias("fields"), F.array_join("tags", ",").alias("tags"))


def _scored(s, d):
    r = table(s, d, "resolution_results").where("combined IS NOT NULL AND golden_record_id <> entity_id")
    return r.groupBy(F.least("golden_record_id", "entity_id").alias("id_a"), F.greatest("golden_record_id", "entity_id").alias("id_b")).agg(F.max("combined").alias("combined"))


def _decided(s, d):
    items = R.queue(_scored(s, d))
    decisions = items.where("right(id_a, 1) IN ('1', '2', '3', '4', '5', '6')").select("queue_id", (F.right("id_a", F.lit(1)) < "4").alias("approve"), F.lit(None).cast("string").alias("reason"))
    return R.decided(items, decisions, _cur(s, d)).drop("queue_id")


def _edges(s, d):
    return graph.merge_edges(table(s, d, "resolution_results"))


def _violations(s, d):
    cur = _cur(s, d)
    return G.violations(cur, T.scores_dev(cur))


def _context(s, d):
    return X.context(X.retrieve(_cur(s, d), QUESTIONS), _edges(s, d), 5)


def _summary(s, d):
    cur = _cur(s, d)
    trust = T.scores_dev(cur)
    return A.summary(cur, trust, T.quality(cur, trust), G.violations(cur, trust), table(s, d, "resolution_results").where("action IN ('auto_merge', 'approved')").dropDuplicates(["result_id"]),
                     R.queue(_scored(s, d)), O.infer(cur), graph.nodes(cur), _edges(s, d))


def _jobs(s, d):
    cur = _cur(s, d)
    trust = T.scores_dev(cur)
    return X.tasks(trust_recalculator=X.trust_job(trust, T.quality(cur, trust)), pii_scanner=X.pii_job(cur, G.detect_dev(cur)), metadata_enricher=O.tags("dev", cur, O.infer(cur)), duplicate_remediator=R.auto_merges(_scored(s, d)))


def _seeds(s, d):
    """The ends of merges whose id ends in 00 or 50."""
    return meaning._asked(_edges(s, d).select(F.col("source").alias("node")).distinct(), "node")


def _paths(s, d):
    e = _edges(s, d)
    pairs = meaning._asked(e.select("source").distinct(), "source").join(_groups(s, d), F.col("source") == F.col("node"))
    return graph.shortest_paths(e, pairs.select("source", F.col("least").alias("target")), 6)


def _groups(s, d):
    from goldenloom.operators.components import components

    return components(_edges(s, d).select(F.col("source").alias("a"), F.col("target").alias("b"))).select(F.col("id").alias("node"), F.col("component").alias("least"))


def _subgraph(s, d):
    return graph.subgraph(_edges(s, d), graph.neighborhood(_edges(s, d), _seeds(s, d), 2), ("DERIVED_FROM",))


def _enriched(s, d):
    cur = _cur(s, d)
    trust = T.scores_dev(cur)
    return H.enriched(cur, trust, T.quality(cur, trust), O.infer(cur)).select("entity_id", "status", "trust", "tier", "quality", "grade", "class_name")


def _constraints(s, d):
    return graph.broken_constraints(graph.nodes(_cur(s, d)), _edges(s, d))


def _updates(s, d):
    new, _ = H.updated(_cur(s, d), _changes(s, d))
    return new.select("entity_id", "version", F.col("fields")["city"].alias("city"), F.col("fields")["name"].alias("name"))


def _audit(s, d):
    _, audit = H.updated(_cur(s, d), _changes(s, d))
    return audit.select("entity_id", "action", F.col("before")["city"].alias("before"), F.col("after")["city"].alias("after"))


def _masked(s, d):
    cur = _cur(s, d)
    fields, _ = H.remediated(cur, _violations(s, d))
    return fields.select("entity_id", F.explode("fields").alias("field", "value")).where(F.col("value") == H.MASK).select("entity_id", "field")


QUERIES = {
    "pair_recommendations": lambda s, d: R.score_pairs(_members(s, d)).select("id_a", "id_b", "fuzzy", "semantic", "final", "decision", "recommendation", F.array_join("fields", ",").alias("fields")),
    "pair_semantic_scores": lambda s, d: _members(s, d).select("id_a", "id_b", F.round(R.cosine_of(R.service_terms(F.col("a")), R.service_terms(F.col("b"))), 4).alias("semantic")),
    "field_match_breakdown": lambda s, d: R.score_pairs(_members(s, d)).select(F.explode(R.breakdown(F.col("scores"))).alias("p")).groupBy("p.field", "p.method").agg(F.count("*").alias("pairs"), F.count_if(F.col("p.score") >= 0.85).alias("matching")),
    "resolve_candidates": lambda s, d: R.resolve(_cur(s, d)),
    "resolve_golden_ids": lambda s, d: R.golden_ids(_cur(s, d), R.resolve(_cur(s, d), R.AUTO)),
    "review_queue": lambda s, d: R.queue(_scored(s, d)).drop("queue_id"),
    "review_listing": lambda s, d: R.listing(R.queue(_scored(s, d)).drop("queue_id"), "pending"),
    "cluster_remediation": lambda s, d: R.remediation(meaning._clusters(s, d)),
    "golden_records_custom": lambda s, d: V.golden(table(s, d, "resolution_candidates"), {"name": "longest", "city": "shortest", "country": "trust"}),
    "review_decisions": _decided,
    "auto_merges": lambda s, d: R.auto_merges(_scored(s, d)),
    "entity_updates": _updates,
    "update_audit": _audit,
    "pii_remediation": _masked,
    "merge_by_trust": _merged,
    "merge_approved": lambda s, d: _merged(s, d, False),
    "merge_edges": lambda s, d: H.merge_effects(_merge_pairs(s, d))[1].groupBy("type").agg(F.count("*").alias("edges"), F.count_distinct("source").alias("sources")),
    "entity_enriched": _enriched,
    "copilot_retrieval": lambda s, d: X.retrieve(_cur(s, d), QUESTIONS).select("question", "rank", "entity_id", "label", "summary"),
    "copilot_context": _context,
    "pii_job": lambda s, d: X.pii_job(_cur(s, d), G.detect_dev(_cur(s, d))),
    "agent_tasks": _jobs,
    "analytics_summary": _summary,
    "dashboard": lambda s, d: A.dashboard(_cur(s, d), T.scores_dev(_cur(s, d)), T.quality(_cur(s, d), T.scores_dev(_cur(s, d)))),
    "event_panels": lambda s, d: A.panels(table(s, d, "events")),
    "graph_subgraph": _subgraph,
    "graph_paths": _paths,
    "graph_dependents": lambda s, d: graph.inbound(_edges(s, d), _edges(s, d).select(F.col("target").alias("node")).distinct()),
    "graph_constraints": _constraints,
    "lineage_downstream": lambda s, d: _edges(s, d).groupBy(F.col("target").alias("node")).agg(F.count("*").alias("derived"), F.min("source").alias("first")),
}

_MEM = """c AS (SELECT golden_record_id, entity_id, arg_max(fields, (coalesce(epoch_us(updated_at), -9e18::BIGINT), coalesce(source, ''), coalesce(confidence, -1))) AS fields FROM resolution_candidates WHERE golden_record_id IS NOT NULL AND entity_id IS NOT NULL GROUP BY 1, 2),
      f AS (SELECT golden_record_id, min(entity_id) AS id_a, arg_min(fields, entity_id) AS a FROM c GROUP BY 1), mp AS (SELECT id_a, entity_id AS id_b, a, fields AS b FROM c JOIN f USING (golden_record_id) WHERE entity_id <> id_a)"""
_FIRST = ", ".join(f"'{f}'" for f in rules.TEXT_FIRST)


def _terms_sql(m: str) -> str:
    own = "list_filter([" + ", ".join(f"{m}['{f}']" for f in rules.TEXT_FIRST) + "], lambda v: v <> '')"
    rest = f"list_transform(list_sort(list_filter(map_entries({m}), lambda e: e.value <> '' AND e.key NOT IN ({_FIRST}))), lambda e: e.value)"
    return f"list_filter(regexp_extract_all(lower(array_to_string(list_concat({own}, {rest})[1:12], ' ')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2)"


_SC = "sp AS (SELECT least(golden_record_id, entity_id) AS id_a, greatest(golden_record_id, entity_id) AS id_b, max(combined) AS combined FROM resolution_results WHERE combined IS NOT NULL AND golden_record_id <> entity_id GROUP BY 1, 2)"
_QU = _SC + ", qu AS (SELECT *, 'pending' AS status FROM sp WHERE combined >= 0.82 AND combined < 0.95)"
_AM = _SC + """, su AS (SELECT * FROM sp WHERE combined >= 0.95), en AS (SELECT id_a AS id, * FROM su UNION ALL SELECT id_b, * FROM su), bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY combined DESC, id_a, id_b) AS rn FROM en) WHERE rn = 1),
      am AS (SELECT id_a, id_b, combined FROM bs GROUP BY 1, 2, 3 HAVING count(*) = 2)"""
_CH = "ch AS (SELECT id AS entity_id, arg_max(struct_pack(city := city, phone := phone), (coalesce(epoch_us(ingested_at), -9e18::BIGINT), coalesce(epoch_us(updated_at), -9e18::BIGINT))) AS r FROM customers WHERE id IS NOT NULL GROUP BY 1)"
_MP = "mp AS (SELECT golden_record_id AS id_a, min(entity_id) AS id_b FROM resolution_results WHERE action = 'auto_merge' AND golden_record_id IS NOT NULL AND entity_id IS NOT NULL AND golden_record_id <> entity_id GROUP BY 1)"
_ME = """me AS (SELECT DISTINCT golden_record_id AS source, entity_id AS target FROM resolution_results WHERE action IN ('auto_merge', 'approved')
      AND golden_record_id IS NOT NULL AND entity_id IS NOT NULL AND golden_record_id <> entity_id), mu AS (SELECT source AS a, target AS b FROM me UNION SELECT target, source FROM me)"""


def _merge_sql(first: str, tags: str, base: str) -> str:
    keys = "list_sort(list_distinct(list_concat(map_keys(p.fields), map_keys(q.fields))))"
    value = "CASE WHEN p.fields[k] <> '' THEN p.fields[k] ELSE q.fields[k] END"
    return f"""WITH {base}, {_MP}, o AS (SELECT id_a, id_b, CASE WHEN {first} THEN id_a ELSE id_b END AS pid, CASE WHEN {first} THEN id_b ELSE id_a END AS qid FROM mp JOIN cur a ON a.entity_id = id_a JOIN cur b ON b.entity_id = id_b LEFT JOIN dev ta ON ta.entity_id = id_a LEFT JOIN dev tb ON tb.entity_id = id_b)
      SELECT id_a || '+' || id_b AS merged_from, p.entity_type, coalesce(p.source, 'merge') AS source, array_to_string(list_filter(list_transform({keys}, lambda k: CASE WHEN coalesce({value}, '') <> '' THEN k || '=' || ({value}) END), lambda x: x IS NOT NULL), '|') AS fields, {tags} AS tags
      FROM o JOIN cur p ON p.entity_id = pid JOIN cur q ON q.entity_id = qid"""


_RET = meaning.SEARCH.replace(str(meaning.SEARCHES), str(QUESTIONS)) + f""", rk AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, entity_id) AS INT) AS rank FROM hits) WHERE rank <= 10),
      rt AS (SELECT query AS question, rank, entity_id, entity_type, CASE WHEN fields['name'] <> '' THEN fields['name'] WHEN fields['full_name'] <> '' THEN fields['full_name'] ELSE left(entity_id, 8) END AS label,
        array_to_string(list_transform(list_sort(list_filter(map_entries(fields), lambda e: e.value <> '' AND e.key NOT IN ({', '.join(f"'{k}'" for k in X.SYSTEM)})))[1:3], lambda e: e.key || '=' || e.value), ', ') AS summary FROM rk JOIN cur USING (entity_id))"""
_CLASSES_DEV = meaning._classes_sql("dev").removeprefix(CUR + ", ")

ORACLES = {
    "pair_semantic_scores": f"""WITH {_MEM}, t AS (SELECT id_a, id_b, {_terms_sql('a')} AS x, {_terms_sql('b')} AS y FROM mp), n AS (SELECT id_a, id_b, list_sum(list_transform(x, lambda t: len(list_filter(y, lambda u: u = t)))) AS d, list_sum(list_transform(x, lambda t: len(list_filter(x, lambda u: u = t)))) AS xx,
      list_sum(list_transform(y, lambda t: len(list_filter(y, lambda u: u = t)))) AS yy FROM t) SELECT id_a, id_b, coalesce(round(d / sqrt(xx::DOUBLE * yy::DOUBLE), 4), 0.0::DOUBLE) AS semantic FROM n""",
    "review_queue": f"WITH {_QU} SELECT * FROM qu",
    "review_listing": f"WITH {_QU} SELECT *, (SELECT count(*) FROM qu) AS pending FROM qu",
    "cluster_remediation": "SELECT cluster, members, max_score, CASE WHEN max_score >= 0.95 THEN 'high_confidence' WHEN max_score >= 0.8 THEN 'medium_confidence' ELSE 'low_confidence' END AS band, CASE WHEN max_score >= 0.95 THEN 'auto_merge' WHEN max_score >= 0.8 THEN 'queue_for_review' ELSE 'flag' END AS action FROM (" + meaning.ORACLES["dup_clusters"] + ")",
    "golden_records_custom": f"""WITH {meaning.VALUES}, {meaning._MAJORITY} SELECT *, 'longest' AS strategy FROM ({meaning._golden('length(value) DESC')}) WHERE field = 'name' UNION ALL SELECT *, 'shortest' FROM ({meaning._golden('length(value)')}) WHERE field = 'city'
      UNION ALL SELECT *, 'trust' FROM ({meaning._golden('trust DESC')}) WHERE field IN ({meaning._T}, 'country') AND field <> 'name' UNION ALL SELECT *, 'recency' FROM ({meaning._golden('updated_at DESC NULLS LAST')}) WHERE field IN ({meaning._RC})
      UNION ALL SELECT *, 'majority' FROM ({meaning._golden('n DESC', 'm')}) WHERE field NOT IN ({meaning._T}, {meaning._RC}, 'name', 'city', 'country')""",
    "review_decisions": f"""WITH {CUR}, {_QU}, x AS (SELECT *, CASE WHEN right(id_a, 1) IN ('1', '2', '3', '4', '5', '6') THEN right(id_a, 1) < '4' END AS ok, id_a IN (SELECT entity_id FROM cur) AND id_b IN (SELECT entity_id FROM cur) AS known FROM qu)
      SELECT id_a, id_b, combined, CASE WHEN ok IS NULL THEN 'pending' WHEN NOT ok THEN 'rejected' WHEN known THEN 'approved' ELSE 'failed' END AS status, CASE WHEN NOT ok THEN 'Manual rejection' END AS reason FROM x""",
    "auto_merges": f"WITH {_AM} SELECT * FROM am",
    "entity_updates": f"WITH {CUR}, {_CH} SELECT entity_id, coalesce(version, 1) + 1 AS version, r.city AS city, fields['name'] AS name FROM cur JOIN ch USING (entity_id)",
    "update_audit": f"WITH {CUR}, {_CH} SELECT entity_id, 'updated' AS action, fields['city'] AS before, r.city AS after FROM cur JOIN ch USING (entity_id)",
    "pii_remediation": f"WITH {CUR}, {PII_DEV} SELECT entity_id, field FROM pii WHERE pii_type IS NOT NULL UNION SELECT entity_id, field FROM long WHERE value = '***MASKED***' AND entity_id IN (SELECT entity_id FROM pii WHERE pii_type IS NOT NULL)",
    "merge_by_trust": _merge_sql("coalesce(ta.overall, 0) >= coalesce(tb.overall, 0)", "array_to_string(list_sort(list_distinct(list_concat(coalesce(p.tags, []), coalesce(q.tags, [])))), ',')", DEV),
    "merge_approved": _merge_sql("TRUE", "''", DEV),
    "merge_edges": f"WITH {_MP}, e AS (SELECT id_a AS s FROM mp UNION ALL SELECT id_b FROM mp) SELECT 'MERGED_INTO' AS type, count(*) AS edges, count(DISTINCT s) AS sources FROM e",
    "entity_enriched": f"WITH {QUALITY}, {_CLASSES_DEV} SELECT cur.entity_id, cur.status, dev.overall AS trust, dev.tier, q.overall AS quality, q.grade, k.class_name FROM cur LEFT JOIN dev USING (entity_id) LEFT JOIN q USING (entity_id) LEFT JOIN k USING (entity_id)",
    "copilot_retrieval": f"WITH {_RET} SELECT question, rank, entity_id, label, summary FROM rt",
    "copilot_context": f"""WITH {_RET}, {_ME}, h AS (SELECT question, string_agg('  - [' || entity_type || '] ' || label || ': ' || summary, chr(10) ORDER BY rank) AS e FROM rt WHERE rank <= 8 GROUP BY 1),
      z AS (SELECT DISTINCT question, source, target FROM rt JOIN me ON entity_id IN (source, target) WHERE rank <= 3), zr AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY source, target) AS n FROM z),
      r AS (SELECT question, string_agg('  - ' || source || ' --[DERIVED_FROM]--> ' || target, chr(10) ORDER BY n) AS r FROM zr WHERE n <= 5 GROUP BY 1)
      SELECT question, concat_ws(chr(10), 'Query context for: ''' || question || '''', e, 'Knowledge graph relationships:' || chr(10) || r, 'Governance context: 5 active violations') AS context FROM h LEFT JOIN r USING (question)""",
    "pii_job": f"""WITH {CUR}, {PII_DEV} SELECT entity_id, count(*) AS pii_count, array_to_string(list_sort(list(DISTINCT field)), ',') AS fields, any_value(CASE WHEN cur.fields['name'] <> '' THEN cur.fields['name'] WHEN cur.fields['full_name'] <> '' THEN cur.fields['full_name'] ELSE left(entity_id, 8) END) AS label
      FROM pii JOIN cur USING (entity_id) WHERE pii_type IS NOT NULL GROUP BY 1""",
    "analytics_summary": f"""WITH {VIOLATIONS}, {QUALITY.removeprefix(DEV + ', ')}, {_CLASSES_DEV}, {_QU}, {_ME}, t AS (SELECT 'total_entities' AS measure, NULL AS value, count(*) AS amount FROM cur UNION ALL SELECT 'total_violations', NULL, count(*) FROM v
      UNION ALL SELECT 'total_merges', NULL, count(DISTINCT result_id) FROM resolution_results WHERE action IN ('auto_merge', 'approved') UNION ALL SELECT 'queue_size', NULL, count(*) FROM qu UNION ALL SELECT 'ontology_classes', NULL, count(DISTINCT class_name) FROM k
      UNION ALL SELECT 'graph_nodes', NULL, count(*) FROM cur UNION ALL SELECT 'graph_edges', NULL, count(*) FROM me UNION ALL SELECT 'by_type', entity_type, count(*) FROM cur GROUP BY 2 UNION ALL SELECT 'by_status', status, count(*) FROM cur GROUP BY 2 UNION ALL SELECT 'by_tier', tier, count(*) FROM dev GROUP BY 2
      UNION ALL SELECT 'by_grade', grade, count(*) FROM q GROUP BY 2 UNION ALL SELECT 'violations_by_severity', severity, count(*) FROM v GROUP BY 2) SELECT measure, value::VARCHAR AS value, amount::DOUBLE AS amount FROM t UNION ALL SELECT 'avg_trust', NULL, round(avg(overall), 4) FROM dev""",
    "dashboard": f"WITH {QUALITY} SELECT cur.status, count(*) AS entities, round(avg(dev.overall), 3) AS avg_trust, round(avg(q.overall), 3) AS avg_quality FROM cur LEFT JOIN dev USING (entity_id) LEFT JOIN q USING (entity_id) GROUP BY 1",
    "event_panels": "SELECT strftime(time_bucket(INTERVAL '2 minutes', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS events, round(count(*) / 120.0::DOUBLE, 6) AS rate, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS error_share, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "graph_subgraph": f"""WITH RECURSIVE {_ME}, sd AS (SELECT DISTINCT source AS node FROM me WHERE {meaning._ASKED.format('source')}), r AS (SELECT node AS seed, node, 0 AS hops FROM sd UNION SELECT r.seed, mu.b, hops + 1 FROM r JOIN mu ON mu.a = r.node WHERE hops < 2),
      nb AS (SELECT DISTINCT seed, node FROM r) SELECT x.seed, source, target, 'DERIVED_FROM' AS type FROM me JOIN nb x ON x.node = source JOIN nb y ON y.node = target AND y.seed = x.seed""",
    "graph_dependents": f"""WITH RECURSIVE {_ME}, r AS (SELECT DISTINCT target AS node, target AS peer, 0 AS hops FROM me UNION SELECT r.node, me.source, hops + 1 FROM r JOIN me ON me.target = r.peer WHERE hops < 4)
      SELECT node, count(DISTINCT peer) FILTER (peer <> node) AS dependents FROM r GROUP BY 1""",
    "graph_constraints": f"""WITH {CUR}, {_ME} SELECT 'node_id_unique' AS rule, 0 AS broken UNION ALL SELECT 'edge_ends_known', count(*) FROM me WHERE source NOT IN (SELECT entity_id FROM cur) OR target NOT IN (SELECT entity_id FROM cur) UNION ALL SELECT 'edge_unique', 0""",
    "lineage_downstream": f"WITH {_ME} SELECT target AS node, count(*) AS derived, min(source) AS first FROM me GROUP BY 1",
}
