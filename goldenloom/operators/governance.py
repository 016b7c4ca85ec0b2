"""Personal data and policies: ordered rules folded into one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldenloom import rules
from goldenloom.functions.text import masked, present
from goldenloom.operators.entities import long_fields
from goldenloom.operators.trust import missing_fields

MASK = "***MASKED***"


def _first(patterns, value: Column, index: int) -> Column:
    out = F.lit(None)
    for p in reversed(patterns):
        out = F.when(value.rlike(p[1]), F.lit(p[index])).otherwise(out)
    return out


def detect_dev(entities: DataFrame) -> DataFrame:
    """Field name first, else the first pattern that matches; masked values are not found again."""
    rows = long_fields(entities).where(F.col("value").isNull() | (F.col("value") != MASK))
    named = F.col("field").isin(*rules.PII_FIELDS_DEV)
    kind = F.when(named, F.col("field")).when(present(F.col("value")), _first(rules.PII_PATTERNS_DEV, F.col("value"), 0))
    return rows.select("entity_id", "field", kind.alias("pii_type"), F.when(named, 0.95).otherwise(0.90).alias("confidence")).where("pii_type IS NOT NULL")


def detect_service(entities: DataFrame) -> DataFrame:
    rows = long_fields(entities).where("value IS NOT NULL")
    names = F.create_map(*[F.lit(x) for kv in rules.PII_FIELDS_SERVICE.items() for x in kv])
    by_name = names[F.lower("field")]
    kind = F.coalesce(by_name, _first(rules.PII_PATTERNS_SERVICE, F.col("value"), 0))
    confidence = F.when(by_name.isNotNull(), 0.95).otherwise(_first(rules.PII_PATTERNS_SERVICE, F.col("value"), 2))
    return rows.select("entity_id", "field", kind.alias("pii_type"), confidence.alias("confidence"), masked(F.col("value")).alias("sample")).where(
        "pii_type IS NOT NULL"
    )


def mask_fields(entities: DataFrame) -> DataFrame:
    """Entities with every detected value masked."""
    names = [F.lit(n) for n in rules.PII_FIELDS_SERVICE]

    def hide(k, v):
        hit = F.array_contains(F.array(*names), F.lower(k)) | _first(rules.PII_PATTERNS_SERVICE, v, 0).isNotNull()
        return F.when(hit & v.isNotNull(), masked(v)).otherwise(v)

    return entities.withColumn("fields", F.transform_values("fields", hide))


def ascii_bounds(pattern: str) -> str:
    """The pattern with word bounds that count ASCII letters, digits and underscores only, in any regex engine."""
    edge = "[^0-9A-Za-z_]"
    if pattern.startswith(r"\b"):
        pattern = f"(?:^|{edge})" + pattern[2:]
    return pattern[:-2] + f"(?:$|{edge})" if pattern.endswith(r"\b") else pattern


def documents_pii(docs: DataFrame) -> DataFrame:
    """Documents by the kinds of personal data in their whole texts."""
    kinds = F.filter(F.array(*[F.when(F.col("text").rlike(ascii_bounds(p)), F.lit(n)) for n, p, _ in rules.PII_PATTERNS_SERVICE]), lambda k: k.isNotNull())
    return docs.where("text IS NOT NULL").select("doc_id", F.explode(kinds).alias("pii_type"))


def violations(entities: DataFrame, trust: DataFrame) -> DataFrame:
    """Missing required fields, unmasked personal data and low trust; one row per entity, kind and field."""
    missing = missing_fields(entities).select("entity_id", F.lit("completeness").alias("kind"), "field", F.lit("medium").alias("severity"))
    pii = detect_dev(entities).select("entity_id", F.lit("pii").alias("kind"), "field", F.lit("high").alias("severity"))
    low = trust.where("overall < 0.5").select("entity_id", F.lit("trust").alias("kind"), F.lit("").alias("field"), F.lit("low").alias("severity"))
    return missing.unionByName(pii).unionByName(low)


def apply_policies(entities: DataFrame, policies: DataFrame) -> DataFrame:
    """Entities by the active policies that apply to them and the required fields they lack.

    policies: policy_id, applies_to ARRAY<STRING> (empty: all types), required_fields ARRAY<STRING>, is_active. A policy stands once for every type
    that it applies to, so entities meet their policies by an equi-join, whatever the size of the registry.
    """
    active = policies.where("is_active AND size(required_fields) > 0").select("policy_id", "applies_to", "required_fields")
    typed = active.select("policy_id", "required_fields", F.explode("applies_to").alias("entity_type"))
    kinds = entities.select("entity_type").distinct().withColumn("one", F.lit(1))
    general = active.where("size(applies_to) = 0").withColumn("one", F.lit(1)).join(kinds, "one").select("policy_id", "required_fields", "entity_type")
    lacks = F.filter("required_fields", lambda f: ~present(F.col("fields")[f]))
    rows = entities.select("entity_id", "entity_type", "fields").join(typed.unionByName(general).distinct(), "entity_type")
    return rows.select("entity_id", "policy_id", F.explode(lacks).alias("field"))


def pii_policies(detections: DataFrame, entities: DataFrame, policies: DataFrame) -> DataFrame:
    """entity_id, policy_id, field, severity of detections (entity_id, field, pii_type) that an active policy wants masked, by field or by kind.

    policies: policy_id, applies_to, mask_fields ARRAY<STRING>, severity, is_active.
    """
    active = policies.where("is_active").select("policy_id", "applies_to", "severity", F.explode("mask_fields").alias("mask"))
    rows = detections.join(entities.select("entity_id", "entity_type"), "entity_id").select("entity_id", "entity_type", "field", F.explode(F.array_distinct(F.array("field", "pii_type"))).alias("mask"))
    hit = rows.join(active, "mask").where("size(applies_to) = 0 OR array_contains(applies_to, entity_type)")
    return hit.select("entity_id", "policy_id", "field", "severity").distinct()


def registry(spark, profile: str) -> DataFrame:
    """The seeded policies of a profile."""
    if profile == "dev":
        return spark.createDataFrame(list(rules.POLICIES_DEV), "policy_id string, name string, kind string, severity string")
    rows = [(n, k, list(a), list(r), list(m), sev, True) for n, k, a, r, m, sev in rules.POLICIES_SERVICE]
    return spark.createDataFrame(rows, "policy_id string, kind string, applies_to array<string>, required_fields array<string>, mask_fields array<string>, severity string, is_active boolean")


def with_policies(found: DataFrame, policies: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Violations beside the name of the policy that their kind breaks, where there is one."""
    of = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return found.withColumn("policy_id", of[F.col("kind")]).join(policies.select("policy_id", F.col("name").alias("policy")), "policy_id", "left")
