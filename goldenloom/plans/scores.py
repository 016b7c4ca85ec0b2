"""Queries and oracles: entities, trust, quality, personal data, policies."""

from goldenloom import rules
from goldenloom.operators import entities as E
from goldenloom.operators import governance as G
from goldenloom.operators import trust as T
from goldenloom.session import table


def _cur(s, d):
    return E.current(table(s, d, "entities"))


def _dev(s, d):
    return T.scores_dev(_cur(s, d))


def _upsert(s, d):
    customers = table(s, d, "customers").select("id", "name", "email", "ingested_at")
    old = customers.where("ingested_at < timestamp'2025-01-01 00:00:00Z'").groupBy("id").agg(*[_max_by(c) for c in ("name", "email", "ingested_at")])
    return E.upsert(old, customers.where("ingested_at >= timestamp'2025-01-01 00:00:00Z'"), "id", "ingested_at").select("id", "name", "email")


def _max_by(c):
    from pyspark.sql import functions as F

    return F.max_by(c, "ingested_at").alias(c)


def _ignore(s, d):
    from pyspark.sql import functions as F

    ids = [table(s, d, t).select(F.col("id"), F.lit(t).alias("origin")).where("id IS NOT NULL").distinct() for t in ("customers", "suppliers")]
    extra = table(s, d, "entities").select(F.col("entity_id").alias("id"), F.lit("entities").alias("origin")).where("id IS NOT NULL").distinct()
    return E.insert_ignore(ids[0].unionByName(ids[1]), extra, "id").groupBy("origin").agg(F.count("*").alias("ids"))


def _policies(s, d):
    """The seeded policies, one of every type's first fields, and one that is not active."""
    extra = [("required_customer", "quality", ["customer"], ["name", "email", "phone"], [], "medium", True), ("retired", "quality", [], ["sku"], [], "low", False)]
    seeds = G.registry(s, "service")
    return G.apply_policies(_cur(s, d), seeds.unionByName(s.createDataFrame(extra, seeds.schema)))


def _found(s, d):
    return G.violations(_cur(s, d), _dev(s, d))


def _overlay(s, d):
    from pyspark.sql import functions as F

    c = table(s, d, "resolution_candidates").where("golden_record_id IS NOT NULL AND entity_id IS NOT NULL")
    one = c.groupBy("golden_record_id").agg(F.min_by("fields", "entity_id").alias("a"), F.max_by("fields", "entity_id").alias("b"))
    return one.select("golden_record_id", F.explode(E.overlay(F.col("a"), F.col("b"))).alias("field", "value")).where("value <> ''")


#: The policies of the dev profile that its scan reports.
POLICY_OF = {"completeness": "pol-2", "pii": "pol-1", "trust": "pol-5"}

QUERIES = {
    "entities_current": lambda s, d: _cur(s, d).select("entity_id", "entity_type", "status", "source", "version"),
    "entity_list_page": lambda s, d: E.list_page(_cur(s, d), T.latest_tier(table(s, d, "trust_scores")), "product", "active", None, 10, 40).select("entity_id", "created_at"),
    "ingest_upsert": _upsert,
    "ingest_insert_ignore": _ignore,
    "merge_overlay": _overlay,
    "trust_scores_dev": _dev,
    "trust_scores_service": lambda s, d: T.scores_service(_cur(s, d)),
    "trust_tier_distribution": lambda s, d: _dev(s, d).groupBy("tier").count().withColumnRenamed("count", "entities"),
    "trust_rollup_by_type": lambda s, d: T.rollup_by_type(_dev(s, d)),
    "trust_latest_per_entity": lambda s, d: T.latest(table(s, d, "trust_scores")).select("entity_id", "overall", "completeness"),
    "trust_anomalies": lambda s, d: T.anomalies(table(s, d, "trust_scores")),
    "trust_consistency_by_group": lambda s, d: T.consistency_by_group(table(s, d, "resolution_candidates")),
    "trust_source_reliability": lambda s, d: T.reliability_by_group(table(s, d, "resolution_candidates")),
    "trust_running_mean": lambda s, d: T.running_mean(table(s, d, "trust_scores")).select("entity_id", "mean_so_far"),
    "quality_scores": lambda s, d: T.quality(_cur(s, d), _dev(s, d)),
    "quality_summary": lambda s, d: T.quality(_cur(s, d), _dev(s, d)).groupBy("grade").count().withColumnRenamed("count", "entities"),
    "quality_averages": lambda s, d: T.quality_averages(T.quality(_cur(s, d), _dev(s, d))),
    "low_trust": lambda s, d: T.low_trust(_dev(s, d)),
    "policy_seeds": lambda s, d: G.registry(s, "dev"),
    "source_seeds": lambda s, d: s.createDataFrame(list(rules.DATA_SOURCES), "source_name string, source_type string, trust_weight double"),
    "pii_policy_violations": lambda s, d: G.pii_policies(G.detect_service(_cur(s, d)), _cur(s, d), G.registry(s, "service")),
    "violation_policies": lambda s, d: G.with_policies(_found(s, d), G.registry(s, "dev"), POLICY_OF),
    "completeness_missing_fields": lambda s, d: T.missing_fields(_cur(s, d)),
    "pii_detect_dev": lambda s, d: G.detect_dev(_cur(s, d)),
    "pii_detect_service": lambda s, d: G.detect_service(_cur(s, d)),
    "pii_mask": lambda s, d: E.long_fields(G.mask_fields(_cur(s, d))).select("entity_id", "field", "value"),
    "pii_documents": lambda s, d: G.documents_pii(table(s, d, "documents")),
    "policy_violations": lambda s, d: G.violations(_cur(s, d), _dev(s, d)),
    "violations_by_severity": lambda s, d: G.violations(_cur(s, d), _dev(s, d)).groupBy("severity", "kind").count().withColumnRenamed("count", "violations"),
    "policy_registry": _policies,
}

CUR = """cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY captured_at DESC NULLS LAST, version DESC NULLS LAST,
      ingested_at DESC NULLS LAST, status DESC NULLS LAST) AS rn FROM entities WHERE entity_id IS NOT NULL)
  WHERE rn = 1 AND deleted_at IS NULL
)"""
_AS_OF = "TIMESTAMPTZ '2026-01-01 00:00:00+00'"


def _days(c: str) -> str:
    return f"greatest(floor((epoch({_AS_OF}) - epoch({c})) / 86400), 0)"


def _recency(c: str) -> str:
    return f"coalesce(round(exp(-{_days(c)} / 180.0), 4), 0.5)"


def _case(column: str, table_: dict, default) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table_.items()) + f" ELSE {default} END"


def _filled(fields) -> str:
    return " + ".join(f"CAST(coalesce(fields['{f}'] <> '', FALSE) AS INT)" for f in fields)


def _complete(profile: str) -> str:
    if profile == "dev":
        return "CASE entity_type " + " ".join(f"WHEN '{k}' THEN ({_filled(fs)}) / {float(len(fs))}::DOUBLE" for k, fs in rules.REQUIRED["dev"].items()) + (
            f" ELSE ({_filled(('name',))})::DOUBLE END"
        )
    pop = "coalesce(len(list_filter(map_values(fields), lambda v: v IS NOT NULL AND v <> '')), 0)"

    def one(fs):
        return f"least(1.0::DOUBLE, ({_filled(fs)}) / {float(len(fs))}::DOUBLE + least(0.10::DOUBLE, greatest(0.0::DOUBLE, 0.01::DOUBLE * ({pop} - {len(fs)}))))"

    return "CASE entity_type " + " ".join(f"WHEN '{k}' THEN {one(fs)}" for k, fs in rules.REQUIRED["service"].items()) + f" ELSE {one(('name',))} END"


def _valid(profile: str) -> str:
    checks = [(f, f"regexp_matches(fields['{f}'], '{p}')") for f, p in rules.VALID[profile].items()]
    if profile == "dev":
        checks += [("phone", "length(regexp_replace(fields['phone'], '\\D', '', 'g')) >= 7"), ("tax_id", "length(trim(fields['tax_id'])) >= 5")]
    seen = _filled([f for f, _ in checks])
    good = " + ".join(f"CAST(coalesce(fields['{f}'] <> '' AND {c}, FALSE) AS INT)" for f, c in checks)
    return f"CASE WHEN ({seen}) > 0 THEN ({good}) / ({seen})::DOUBLE ELSE {"0.0" if profile == 'dev' else "(CASE WHEN coalesce(len(list_filter(map_values(fields), lambda v: v IS NOT NULL AND v <> '')), 0) = 0 THEN 0.5 ELSE 0.8 END)"}::DOUBLE END"


_TIER = "CASE WHEN overall >= 0.85 THEN 'gold' WHEN overall >= 0.70 THEN 'silver' WHEN overall >= 0.50 THEN 'bronze' ELSE 'unverified' END"
_SRC = {p: _case("source", t, rules.UNKNOWN_SOURCE[p]) + "::DOUBLE" for p, t in rules.SOURCE_TRUST.items()}
DEV = f"""{CUR}, r AS (
  SELECT entity_id, entity_type, {_complete('dev')} AS completeness, {_recency('created_at')} AS recency, {_SRC['dev']} AS source_reliability FROM cur
), dev AS (
  SELECT *, {_TIER} AS tier FROM (SELECT *, round(0.35::DOUBLE * completeness + 0.20::DOUBLE * recency + 0.30::DOUBLE * source_reliability + 0.15::DOUBLE, 4) AS overall FROM r)
)"""
_NAME = "trim(regexp_replace(lower(fields['name']), '\\s+', ' ', 'g'))"
QUALITY = f"""{DEV}, q0 AS (
  SELECT entity_id, entity_type, {_NAME} AS name, {_complete('dev')} AS completeness, {_valid('dev')} AS validity FROM cur
), q1 AS (
  SELECT q0.*, CASE WHEN name <> '' THEN greatest(0.0::DOUBLE, 1 - 0.3::DOUBLE * (count(*) OVER (PARTITION BY q0.entity_type, name) - 1)) ELSE 0.5::DOUBLE END AS uniqueness,
    coalesce(dev.recency, 0.5::DOUBLE) AS timeliness FROM q0 LEFT JOIN dev USING (entity_id)
), q AS (
  SELECT entity_id, entity_type, completeness, validity, uniqueness, timeliness, overall,
    CASE WHEN overall >= 0.9 THEN 'A' WHEN overall >= 0.75 THEN 'B' WHEN overall >= 0.6 THEN 'C' WHEN overall >= 0.4 THEN 'D' ELSE 'F' END AS grade
  FROM (SELECT *, round(CAST(round(0.35::DOUBLE * completeness + 0.25::DOUBLE * validity + 0.25::DOUBLE * uniqueness + 0.15::DOUBLE * timeliness, 8) AS DECIMAL(18, 8)), 4)::DOUBLE AS overall FROM q1)
)"""
_LONG = "long AS (SELECT entity_id, entity_type, e.key AS field, e.value AS value FROM cur, unnest(map_entries(fields)) AS u(e))"


def _first(patterns, index: int) -> str:
    lit = (lambda v: f"'{v}'") if index == 0 else str
    return "CASE " + " ".join(f"WHEN regexp_matches(value, '{p[1]}') THEN {lit(p[index])}" for p in patterns) + " END"


_NAMES_DEV = ", ".join(f"'{f}'" for f in rules.PII_FIELDS_DEV)
PII_DEV = f"""{_LONG}, pii AS (
  SELECT entity_id, field, CASE WHEN field IN ({_NAMES_DEV}) THEN field WHEN value <> '' THEN {_first(rules.PII_PATTERNS_DEV, 0)} END AS pii_type,
    CASE WHEN field IN ({_NAMES_DEV}) THEN 0.95::DOUBLE ELSE 0.90::DOUBLE END AS confidence
  FROM long WHERE value IS NULL OR value <> '***MASKED***'
)"""
_BY_NAME = _case("lower(field)", {k: f"'{v}'" for k, v in rules.PII_FIELDS_SERVICE.items()}, "NULL")
_MASKED = "CASE WHEN length(value) <= 4 THEN '****' ELSE left(value, 2) || repeat('*', length(value) - 4) || right(value, 2) END"
_MISSING = " UNION ALL ".join(
    f"SELECT entity_id, entity_type, '{f}' AS field FROM cur WHERE entity_type = '{k}' AND coalesce(fields['{f}'], '') = ''" for k, fs in rules.REQUIRED["dev"].items() for f in fs
)
VIOLATIONS = f"""{DEV}, {PII_DEV}, missing AS ({_MISSING}), v AS (
  SELECT entity_id, 'completeness' AS kind, field, 'medium' AS severity FROM missing
  UNION ALL SELECT entity_id, 'pii', field, 'high' FROM pii WHERE pii_type IS NOT NULL
  UNION ALL SELECT entity_id, 'trust', '', 'low' FROM dev WHERE overall < 0.5
)"""
_DIMS = ("overall", *T.DIMENSIONS)

ORACLES = {
    "entities_current": f"WITH {CUR} SELECT entity_id, entity_type, status, source, version FROM cur",
    "entity_list_page": f"WITH {CUR} SELECT entity_id, created_at FROM cur WHERE entity_type = 'product' AND status = 'active' ORDER BY created_at DESC NULLS LAST, entity_id LIMIT 40 OFFSET 10",
    "ingest_upsert": "SELECT id, arg_max(name, ingested_at) AS name, arg_max(email, ingested_at) AS email FROM customers WHERE ingested_at IS NOT NULL GROUP BY id",
    "ingest_insert_ignore": """SELECT 'customers' AS origin, count(DISTINCT id) AS ids FROM customers UNION ALL SELECT 'suppliers', count(DISTINCT id) FROM suppliers
      UNION ALL SELECT 'entities', count(DISTINCT entity_id) FROM entities WHERE entity_id NOT IN (SELECT id FROM customers WHERE id IS NOT NULL UNION SELECT id FROM suppliers WHERE id IS NOT NULL)""",
    "merge_overlay": """WITH m AS (SELECT golden_record_id, arg_min(fields, entity_id) AS a, arg_max(fields, entity_id) AS b FROM resolution_candidates
        WHERE golden_record_id IS NOT NULL AND entity_id IS NOT NULL GROUP BY 1),
      k AS (SELECT golden_record_id, a, b, unnest(list_distinct(map_keys(a) || map_keys(b))) AS field FROM m)
      SELECT golden_record_id, field, CASE WHEN a[field] <> '' THEN a[field] ELSE b[field] END AS value FROM k WHERE (CASE WHEN a[field] <> '' THEN a[field] ELSE b[field] END) <> ''""",
    "trust_scores_dev": f"WITH {DEV} SELECT * FROM dev",
    "trust_scores_service": f"""WITH {CUR}, r AS (SELECT entity_id, entity_type, {_complete('service')} AS completeness, 1.0::DOUBLE AS consistency, {_recency('updated_at')} AS recency,
      {_SRC['service']} AS source_reliability, {_valid('service')} AS validity FROM cur)
      SELECT *, {_TIER} AS tier FROM (SELECT *, round(least(1.0::DOUBLE, 0.30::DOUBLE * completeness + 0.20::DOUBLE * consistency + 0.18::DOUBLE * recency + 0.22::DOUBLE * source_reliability
        + 0.10::DOUBLE * validity), 4) AS overall FROM r)""",
    "trust_tier_distribution": f"WITH {DEV} SELECT tier, count(*) AS entities FROM dev GROUP BY tier",
    "trust_rollup_by_type": f"WITH {DEV} SELECT entity_type, round(avg(overall), 4) AS avg_trust, min(overall) AS min_trust, max(overall) AS max_trust, count(*) AS entities FROM dev GROUP BY 1",
    "trust_latest_per_entity": """SELECT entity_id, overall, completeness FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY computed_at DESC NULLS LAST, overall DESC NULLS LAST,
      completeness DESC NULLS LAST) AS rn FROM trust_scores WHERE entity_id IS NOT NULL) WHERE rn = 1""",
    "trust_anomalies": f"""WITH t AS (SELECT DISTINCT entity_id, computed_at, {', '.join(_DIMS)} FROM trust_scores WHERE entity_id IS NOT NULL AND computed_at IS NOT NULL),
      l AS (SELECT entity_id, max(computed_at) AS last FROM t GROUP BY 1),
      a AS (SELECT entity_id, {', '.join(f"round(avg({x}) FILTER (computed_at < last) - max({x}) FILTER (computed_at = last), 8) AS {x}" for x in _DIMS)} FROM t JOIN l USING (entity_id) GROUP BY 1),
      u AS ({' UNION ALL '.join(f"SELECT entity_id, '{x}' AS dimension, {x} AS drop_, {0.15 if x == 'overall' else 0.20} AS lim FROM a" for x in _DIMS)})
      SELECT entity_id, dimension, drop_ AS "drop", CASE WHEN dimension = 'overall' AND drop_ > 0.25 THEN 'high' ELSE 'medium' END AS severity FROM u WHERE drop_ > lim""",
    "trust_consistency_by_group": """WITH l AS (SELECT golden_record_id, e.key AS field, e.value AS value FROM resolution_candidates, unnest(map_entries(fields)) AS u(e) WHERE golden_record_id IS NOT NULL),
      p AS (SELECT golden_record_id, field, count(DISTINCT lower(trim(value))) AS n FROM l WHERE value <> '' GROUP BY 1, 2)
      SELECT golden_record_id, round(avg(CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS consistency FROM p GROUP BY 1""",
    "trust_source_reliability": f"""WITH s AS (SELECT DISTINCT golden_record_id, source FROM resolution_candidates WHERE golden_record_id IS NOT NULL AND source IS NOT NULL),
      t AS (SELECT golden_record_id, {_SRC['service']} AS t FROM s) SELECT golden_record_id, round(0.7::DOUBLE * max(t) + 0.3::DOUBLE * avg(t), 8) AS source_reliability FROM t GROUP BY 1""",
    "trust_running_mean": """WITH t AS (SELECT entity_id, computed_at, max(overall) AS overall FROM trust_scores WHERE entity_id IS NOT NULL AND computed_at IS NOT NULL GROUP BY 1, 2)
      SELECT entity_id, round(avg(overall) OVER (PARTITION BY entity_id ORDER BY computed_at ROWS UNBOUNDED PRECEDING), 8) AS mean_so_far FROM t""",
    "quality_scores": f"WITH {QUALITY} SELECT * FROM q",
    "quality_summary": f"WITH {QUALITY} SELECT grade, count(*) AS entities FROM q GROUP BY grade",
    "completeness_missing_fields": f"WITH {CUR} {_MISSING}",
    "pii_detect_dev": f"WITH {CUR}, {PII_DEV} SELECT * FROM pii WHERE pii_type IS NOT NULL",
    "pii_detect_service": f"""WITH {CUR}, {_LONG} SELECT * FROM (SELECT entity_id, field, coalesce({_BY_NAME}, {_first(rules.PII_PATTERNS_SERVICE, 0)}) AS pii_type,
      CASE WHEN {_BY_NAME} IS NOT NULL THEN 0.95::DOUBLE ELSE ({_first(rules.PII_PATTERNS_SERVICE, 2)})::DOUBLE END AS confidence, {_MASKED} AS sample FROM long WHERE value IS NOT NULL) WHERE pii_type IS NOT NULL""",
    "pii_mask": f"""WITH {CUR}, {_LONG} SELECT entity_id, field, CASE WHEN value IS NOT NULL AND ({_BY_NAME} IS NOT NULL OR {_first(rules.PII_PATTERNS_SERVICE, 0)} IS NOT NULL) THEN {_MASKED} ELSE value END AS value FROM long""",
    "pii_documents": " UNION ALL ".join(f"SELECT doc_id, '{n}' AS pii_type FROM documents WHERE regexp_matches(text, '{G.ascii_bounds(p)}')" for n, p, _ in rules.PII_PATTERNS_SERVICE),
    "policy_violations": f"WITH {VIOLATIONS} SELECT * FROM v",
    "violations_by_severity": f"WITH {VIOLATIONS} SELECT severity, kind, count(*) AS violations FROM v GROUP BY 1, 2",
    "quality_averages": f"WITH {QUALITY} SELECT grade, count(*) AS entities, round(avg(overall), 4) AS avg_overall, round(avg(completeness), 4) AS avg_completeness, round(avg(validity), 4) AS avg_validity, round(avg(uniqueness), 4) AS avg_uniqueness FROM q GROUP BY 1",
    "low_trust": f"WITH {DEV} SELECT entity_id, entity_type, overall, tier FROM dev WHERE overall < 0.7 ORDER BY overall, entity_id LIMIT 10",
    "policy_seeds": "SELECT * FROM (VALUES " + ", ".join(str(p) for p in rules.POLICIES_DEV) + ") t(policy_id, name, kind, severity)",
    "source_seeds": "SELECT source_name, source_type, trust_weight::DOUBLE AS trust_weight FROM (VALUES " + ", ".join(str(p) for p in rules.DATA_SOURCES) + ") t(source_name, source_type, trust_weight)",
    "pii_policy_violations": f"""WITH {CUR}, {_LONG}, p AS (SELECT entity_id, entity_type, field, coalesce({_BY_NAME}, {_first(rules.PII_PATTERNS_SERVICE, 0)}) AS pii_type FROM long WHERE value IS NOT NULL)
      SELECT DISTINCT entity_id, 'pii_masking' AS policy_id, field, 'high' AS severity FROM p WHERE entity_type IN ('customer', 'employee') AND pii_type IS NOT NULL AND (field IN ('email', 'phone', 'ssn', 'date_of_birth') OR pii_type IN ('email', 'phone', 'ssn', 'date_of_birth'))""",
    "violation_policies": f"""WITH {VIOLATIONS} SELECT v.*, policy_id, name AS policy FROM (SELECT *, CASE kind WHEN 'completeness' THEN 'pol-2' WHEN 'pii' THEN 'pol-1' ELSE 'pol-5' END AS policy_id FROM v) v
      LEFT JOIN (VALUES {", ".join(str(p) for p in rules.POLICIES_DEV)}) t(policy_id, name, k, s) USING (policy_id)""".replace("SELECT v.*, policy_id,", "SELECT v.entity_id, v.kind, v.field, v.severity, policy_id,"),
    "policy_registry": f"""WITH {CUR} SELECT entity_id, 'completeness_threshold' AS policy_id, 'name' AS field FROM cur WHERE coalesce(fields['name'], '') = ''
      UNION ALL SELECT entity_id, 'required_customer', f FROM cur, unnest(['name', 'email', 'phone']) AS u(f) WHERE entity_type = 'customer' AND coalesce(fields[f], '') = ''""",
}
