"""Queries and oracles: lineage events, listings, integrity, batches."""

from pyspark.sql import functions as F

from goldenloom.operators import changes as H
from goldenloom.operators import entities as E
from goldenloom.operators import governance as G
from goldenloom.operators import lineage as L
from goldenloom.operators import trust as T
from goldenloom.plans import changes as P
from goldenloom.plans import meaning
from goldenloom.plans.scores import CUR, DEV, VIOLATIONS
from goldenloom.session import table, utc_text
from goldenloom.sources import ingest

TYPES = ("customer", "supplier", "product", "employee", "asset", "location")
STATUSES = ("active", "inactive", "pending", "merged", "deleted", "archived")


def _events(s, d):
    return L.log_events(table(s, d, "entities"))


def _integrity(s, d):
    """Rule name and number of rows that break it."""
    e, r, t, c = (table(s, d, n) for n in ("entities", "resolution_results", "trust_scores", "resolution_candidates"))
    ids = e.where("entity_id IS NOT NULL").select("entity_id").distinct()
    rows = {
        "entity_type_known": e.where(~F.col("entity_type").isin(*TYPES)), "trust_weight_in_range": table(s, d, "data_sources").where("NOT trust_weight BETWEEN 0 AND 1"),
        "dimensions_in_range": t.where("NOT (completeness BETWEEN 0 AND 1 AND consistency BETWEEN 0 AND 1 AND recency BETWEEN 0 AND 1 AND source_reliability BETWEEN 0 AND 1 AND validity BETWEEN 0 AND 1)"),
        "pair_order": r.where("golden_record_id > entity_id"), "scores_in_range": r.where("NOT (fuzzy BETWEEN 0 AND 1 AND semantic BETWEEN 0 AND 1)"),
        "candidate_entity_known": c.where("entity_id IS NOT NULL").join(ids, "entity_id", "left_anti"), "score_entity_known": t.where("entity_id IS NOT NULL").join(ids, "entity_id", "left_anti"),
        "source_known": c.where("source IS NOT NULL").join(table(s, d, "data_sources").select(F.col("source_name").alias("source")), "source", "left_anti"),
        "one_group_each": c.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.count_distinct("golden_record_id").alias("n")).where("n > 1"),
        "merged_into_known": e.where("merged_into IS NOT NULL").join(ids.withColumnRenamed("entity_id", "merged_into"), "merged_into", "left_anti"),
        "source_name_unique": table(s, d, "data_sources").groupBy("source_name").count().where("count > 1"),
    }
    out = None
    for name, df in rows.items():
        one = df.agg(F.lit(name).alias("rule"), F.count("*").alias("broken"))
        out = one if out is None else out.unionByName(one)
    return out


def _merge_events(s, d):
    return L.merge_events(P._merge_pairs(s, d), H.merged_id("id_a", "id_b"), P.AT)


def _batches(s, d):
    rows = table(s, d, "customers").withColumn("batch", F.concat_ws("-", F.coalesce("source", F.lit("none")), F.date_format(F.to_utc_timestamp("ingested_at", F.current_timezone()), "yyyy-MM")))
    return ingest.batch_status(rows, "batch", F.col("id").isNull() | (F.coalesce(F.trim("name"), F.lit("")) == ""))


def _created(s, d):
    rows = table(s, d, "suppliers").where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("name", "source"), F.struct("ingested_at", "updated_at")).alias("r"))
    new = rows.select(F.col("id").alias("entity_id"), F.lit("supplier").alias("entity_type"), F.col("r.source").alias("source"), F.create_map(F.lit("name"), F.col("r.name")).alias("fields"), F.lit(None).cast("array<string>").alias("tags"))
    return H.created(new, P.AT, "pending").select("entity_id", "status", "source", "version", F.col("fields")["name"].alias("name"), F.col("lineage")[0]["operation"].alias("operation"))


def _envelopes(s, d):
    rows = table(s, d, "entities").where("captured_at IS NOT NULL AND entity_id IS NOT NULL").select("entity_id", F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"), F.col("captured_at").alias("at")).dropDuplicates(["entity_id", "at"])
    good, _ = ingest.parse_events(ingest.envelopes(rows, "entity.ingested", "log"))
    return good.groupBy("topic").agg(F.count("*").alias("events"), F.count_distinct("partition_key").alias("keys"))


QUERIES = {
    "lineage_events": lambda s, d: _events(s, d).select("operation", "entity_id", utc_text(F.col("at")).alias("at"), "source", F.array_join("sources", "+").alias("sources")),
    "lineage_of_entities": lambda s, d: L.lineage_of(_events(s, d), meaning._asked(E.current(table(s, d, "entities")))).select("asked", "entity_id", "operation", utc_text(F.col("at")).alias("at"), "own"),
    "lineage_counts": lambda s, d: L.stats(_events(s, d).unionByName(_merge_events(s, d))),
    "lineage_nodes": lambda s, d: L.export(_merge_events(s, d))[0].select("entity_id", "events", "last"),
    "lineage_made_of": lambda s, d: L.downstream(_merge_events(s, d)),
    "entity_sources": lambda s, d: L.sources_of(table(s, d, "entities")).select("entity_id", "source", utc_text(F.col("first_seen")).alias("first_seen"), utc_text(F.col("last_seen")).alias("last_seen")),
    "integrity_rules": _integrity,
    "batch_status": _batches,
    "entity_created": _created,
    "event_envelopes": _envelopes,
    "entity_list_total": lambda s, d: E.matching(E.current(table(s, d, "entities")), T.latest_tier(table(s, d, "trust_scores")), "product", "active", "silver"),
    "violation_listing": lambda s, d: G.violations(E.current(table(s, d, "entities")), T.scores_dev(E.current(table(s, d, "entities")))).where("severity = 'high'").orderBy("entity_id", "field").limit(50),
}

_EV = """r AS (SELECT DISTINCT entity_id, captured_at, source, merged_into, deleted_at IS NOT NULL AS gone FROM entities WHERE entity_id IS NOT NULL AND captured_at IS NOT NULL), b AS (SELECT entity_id, min(captured_at) AS born FROM r GROUP BY 1),
      ev AS (SELECT DISTINCT CASE WHEN gone THEN 'deleted' WHEN captured_at = born THEN 'ingested' ELSE 'updated' END AS operation, entity_id, captured_at AS "at", coalesce(source, 'unknown') AS source, '' AS sources FROM r JOIN b USING (entity_id)
        UNION ALL SELECT 'merged', merged_into, min(captured_at), 'merge', entity_id FROM r WHERE merged_into IS NOT NULL GROUP BY merged_into, entity_id)"""
_T = "strftime({0} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"
_AT = '"at"'
_IDS = "(SELECT entity_id FROM entities WHERE entity_id IS NOT NULL)"

ORACLES = {
    "lineage_events": f"WITH {_EV} SELECT operation, entity_id, {_T.format(_AT)} AS {_AT}, source, sources FROM ev",
    "lineage_of_entities": f"""WITH {CUR}, {_EV}, w AS (SELECT entity_id AS asked FROM cur WHERE {meaning._ASKED.format('entity_id')}), i AS (SELECT asked, asked AS o FROM w UNION SELECT asked, sources FROM w JOIN ev ON ev.entity_id = asked WHERE sources <> '')
      SELECT asked, entity_id, operation, {_T.format('"at"')} AS "at", o = asked AS own FROM ev JOIN i ON i.o = ev.entity_id""",
    "lineage_counts": f"""WITH {_EV}, {P._MP}, al AS (SELECT operation, entity_id FROM ev UNION ALL SELECT 'merged', id_a || '|' || id_b FROM mp UNION ALL SELECT 'merged_into', id_a FROM mp UNION ALL SELECT 'merged_into', id_b FROM mp)
      SELECT operation, count(*) AS events, count(DISTINCT entity_id) AS entities FROM al GROUP BY 1""",
    "lineage_nodes": f"""WITH {P._MP}, n AS (SELECT 'gold-' || left(sha256(id_a || '|' || id_b), 16) AS entity_id, 'merged' AS op FROM mp UNION ALL SELECT id_a, 'merged_into' FROM mp UNION ALL SELECT id_b, 'merged_into' FROM mp)
      SELECT entity_id, count(*) AS events, any_value(op) AS last FROM n GROUP BY 1""",
    "lineage_made_of": f"WITH {P._MP}, n AS (SELECT id_a AS entity_id, id_a || id_b AS t FROM mp UNION ALL SELECT id_b, id_a || id_b FROM mp) SELECT entity_id, count(DISTINCT t) AS derived FROM n GROUP BY 1",
    "entity_sources": f"SELECT entity_id, source, {_T.format('min(captured_at)')} AS first_seen, {_T.format('max(captured_at)')} AS last_seen FROM entities WHERE entity_id IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2",
    "integrity_rules": f"""SELECT 'entity_type_known' AS rule, count(*) AS broken FROM entities WHERE entity_type NOT IN {TYPES} UNION ALL SELECT 'trust_weight_in_range', count(*) FROM data_sources WHERE NOT trust_weight BETWEEN 0 AND 1
      UNION ALL SELECT 'dimensions_in_range', count(*) FROM trust_scores WHERE NOT (completeness BETWEEN 0 AND 1 AND consistency BETWEEN 0 AND 1 AND recency BETWEEN 0 AND 1 AND source_reliability BETWEEN 0 AND 1 AND validity BETWEEN 0 AND 1)
      UNION ALL SELECT 'pair_order', count(*) FROM resolution_results WHERE golden_record_id > entity_id UNION ALL SELECT 'scores_in_range', count(*) FROM resolution_results WHERE NOT (fuzzy BETWEEN 0 AND 1 AND semantic BETWEEN 0 AND 1)
      UNION ALL SELECT 'candidate_entity_known', count(*) FROM resolution_candidates WHERE entity_id NOT IN {_IDS} UNION ALL SELECT 'score_entity_known', count(*) FROM trust_scores WHERE entity_id NOT IN {_IDS}
      UNION ALL SELECT 'source_known', count(*) FROM resolution_candidates WHERE source NOT IN (SELECT source_name FROM data_sources) UNION ALL SELECT 'one_group_each', count(*) FROM (SELECT entity_id FROM resolution_candidates WHERE entity_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT golden_record_id) > 1)
      UNION ALL SELECT 'merged_into_known', count(*) FROM entities WHERE merged_into NOT IN {_IDS} UNION ALL SELECT 'source_name_unique', count(*) FROM (SELECT source_name FROM data_sources GROUP BY 1 HAVING count(*) > 1)""",
    "batch_status": """WITH x AS (SELECT concat_ws('-', coalesce(source, 'none'), strftime(ingested_at AT TIME ZONE 'UTC', '%Y-%m')) AS batch, id IS NULL OR coalesce(trim(name), '') = '' AS bad FROM customers), n AS (SELECT batch, count(*) AS total, count(*) FILTER (bad) AS failed FROM x GROUP BY 1)
      SELECT batch, total, total - failed AS processed, failed, CASE WHEN failed = 0 THEN 'completed' WHEN failed < total THEN 'completed_with_errors' ELSE 'failed' END AS status FROM n""",
    "entity_created": """SELECT id AS entity_id, 'pending' AS status, coalesce(r.source, 'api') AS source, 1 AS version, r.name AS name, 'created' AS operation FROM (SELECT id, arg_max(struct_pack(name := name, source := source), (coalesce(epoch_us(ingested_at), -9e18::BIGINT), coalesce(epoch_us(updated_at), -9e18::BIGINT))) AS r
      FROM suppliers WHERE id IS NOT NULL GROUP BY 1)""",
    "event_envelopes": "SELECT 'mdm.entity.ingested' AS topic, count(*) AS events, count(DISTINCT entity_id) AS keys FROM (SELECT DISTINCT entity_id, captured_at FROM entities WHERE captured_at IS NOT NULL AND entity_id IS NOT NULL)",
    "entity_list_total": f"""WITH {CUR}, t AS (SELECT entity_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY computed_at DESC NULLS LAST, overall DESC NULLS LAST, completeness DESC NULLS LAST) AS rn FROM trust_scores WHERE entity_id IS NOT NULL) WHERE rn = 1 AND overall >= 0.70 AND overall < 0.85)
      SELECT count(*) AS total FROM cur WHERE entity_type = 'product' AND status = 'active' AND entity_id IN (SELECT entity_id FROM t)""",
    "violation_listing": f"WITH {VIOLATIONS} SELECT * FROM v WHERE severity = 'high' ORDER BY entity_id, field LIMIT 50",
}
