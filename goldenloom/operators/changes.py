"""Changes of entities as functions from old to new states: create, update, mask, merge; with audit rows and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldenloom.operators.entities import overlay

MASK = "***MASKED***"


def created(rows: DataFrame, at: str, status: str = "active") -> DataFrame:
    """New entities (entity_id, entity_type, source, fields, tags) at version 1 with their lineage."""
    when = F.lit(at).cast("timestamp")
    step = F.array(F.struct(F.lit("created").alias("operation"), F.coalesce("source", F.lit("api")).alias("source"), when.alias("at")))
    return rows.select(
        "entity_id", F.coalesce("entity_type", F.lit("customer")).alias("entity_type"), F.lit(status).alias("status"), F.coalesce("source", F.lit("api")).alias("source"),
        F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        when.alias("created_at"), when.alias("updated_at"), F.lit(1).alias("version"), step.alias("lineage"),
    )


def written_over(old: Column, new: Column) -> Column:
    """Map of both in which every key of ``new`` wins, with an empty value too."""
    return F.map_zip_with(old, new, lambda k, o, n: F.when(F.map_contains_key(new, k), n).otherwise(o))


def updated(entities: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new states of the changed entities, audit rows with the fields before and after) of changes (entity_id, changed, at)."""
    rows = entities.join(changes.select("entity_id", "changed", "at"), "entity_id")
    rows = rows.withColumn("after", written_over(F.col("fields"), F.col("changed")))
    audit = rows.select("entity_id", F.lit("updated").alias("action"), F.col("at").alias("occurred_at"), F.col("fields").alias("before"), "after")
    keep = [c for c in entities.columns if c not in ("fields", "version", "updated_at")]
    new = rows.select(*keep, F.col("after").alias("fields"), (F.coalesce("version", F.lit(1)) + 1).alias("version"), F.col("at").alias("updated_at"))
    return new, audit


def remediated(entities: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity_id, fields with exposed fields masked; violations with action and status) of violations (entity_id, kind, field)."""
    exposed = violations.where("kind = 'pii' AND field <> ''").groupBy("entity_id").agg(F.collect_set("field").alias("hide"))
    rows = entities.join(exposed, "entity_id").select("entity_id", F.transform_values("fields", lambda k, v: F.when(F.array_contains("hide", k), MASK).otherwise(v)).alias("fields"))
    action = F.when(F.col("kind") == "pii", "pii_masked").otherwise("flagged_for_enrichment")
    return rows, violations.withColumn("action", action).withColumn("status", F.lit("remediated"))


def merged(pairs: DataFrame, entities: DataFrame, trust: DataFrame | None = None) -> DataFrame:
    """New entities of pairs (id_a, id_b): the more trusted one (a on a tie, or always without ``trust``) is primary.

    Its non-empty fields win, tags are united (empty without ``trust``), the type and source are its own; the id is a digest of both ids, so a merge
    done again gives the same entity.
    """
    side = lambda x: entities.select(F.col("entity_id").alias(f"id_{x}"), F.struct("entity_type", "source", "fields", "tags").alias(x))
    rows = pairs.select("id_a", "id_b").join(side("a"), "id_a").join(side("b"), "id_b")
    first = F.lit(True)
    if trust is not None:
        for x in "ab":
            rows = rows.join(trust.select(F.col("entity_id").alias(f"id_{x}"), F.col("overall").alias(f"trust_{x}")), f"id_{x}", "left")
        first = F.coalesce("trust_a", F.lit(0.0)) >= F.coalesce("trust_b", F.lit(0.0))
    rows = rows.withColumn("p", F.when(first, F.col("a")).otherwise(F.col("b"))).withColumn("s", F.when(first, F.col("b")).otherwise(F.col("a")))
    none = F.array().cast("array<string>")
    tags = F.array_sort(F.array_union(F.coalesce("p.tags", none), F.coalesce("s.tags", none))) if trust is not None else none
    return rows.select(
        merged_id("id_a", "id_b").alias("entity_id"), "p.entity_type", F.lit("active").alias("status"), F.coalesce("p.source", F.lit("merge")).alias("source"),
        overlay(F.col("p.fields"), F.col("s.fields")).alias("fields"), tags.alias("tags"), F.lit(1).alias("version"), F.array("id_a", "id_b").alias("merged_from"),
    )


def merged_id(a: str, b: str) -> Column:
    return F.concat(F.lit("gold-"), F.substring(F.sha2(F.concat_ws("|", a, b), 256), 1, 16))


def merge_effects(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity_id, merged_into, status of the merged originals; MERGED_INTO edges) of pairs (id_a, id_b)."""
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("entity_id"), merged_id("id_a", "id_b").alias("merged_into"))
    return ends.withColumn("status", F.lit("merged")), ends.select(F.col("entity_id").alias("source"), F.col("merged_into").alias("target"), F.lit("MERGED_INTO").alias("type"))


def enriched(entities: DataFrame, trust: DataFrame, quality: DataFrame, classes: DataFrame) -> DataFrame:
    """Entities beside their trust, quality and class, where they have them."""
    t = trust.select("entity_id", F.col("overall").alias("trust"), "tier")
    q = quality.select("entity_id", F.col("overall").alias("quality"), "grade")
    return entities.join(t, "entity_id", "left").join(q, "entity_id", "left").join(classes.select("entity_id", "class_name"), "entity_id", "left")
