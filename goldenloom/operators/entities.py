"""Entities: current state of the log, views of it, listing, overlay and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldenloom.functions.text import present

#: Time at which time-dependent operators are evaluated unless told otherwise.
AS_OF = "2026-01-01 00:00:00+00:00"
STATE = ("entity_type", "status", "source", "fields", "tags", "created_at", "updated_at", "version", "merged_into", "captured_at", "deleted_at")


def current(log: DataFrame) -> DataFrame:
    """Latest state of every entity that is not deleted. A map-side pre-aggregated arg-max, safe for hot keys."""
    order = F.struct("captured_at", "version", "ingested_at", "status")
    last = log.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.max_by(F.struct(*STATE), order).alias("s"))
    return last.select("entity_id", "s.*").where("deleted_at IS NULL").drop("deleted_at")


def long_fields(entities: DataFrame) -> DataFrame:
    """One row per entity and field."""
    return entities.select("entity_id", "entity_type", F.explode("fields").alias("field", "value"))


def field(name: str) -> Column:
    return F.col("fields")[name]


def list_page(entities: DataFrame, trust: DataFrame, entity_type=None, status=None, tier=None, offset=0, limit=50) -> DataFrame:
    """Conjunctive optional filters, newest first, one page."""
    out = entities
    if entity_type:
        out = out.where(F.col("entity_type") == entity_type)
    if status:
        out = out.where(F.col("status") == status)
    out = out.join(trust.select("entity_id", "tier"), "entity_id", "left")
    if tier:
        out = out.where(F.col("tier") == tier)
    return out.orderBy(F.desc_nulls_last("created_at"), "entity_id").offset(offset).limit(limit)


def overlay(primary: Column, secondary: Column) -> Column:
    """Map union in which a non-empty value of ``primary`` wins."""
    return F.map_zip_with(secondary, primary, lambda k, s, p: F.when(present(p), p).otherwise(s))


def upsert(existing: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both by key; a batch row replaces, the last of the batch by ``order`` counts."""
    cols = [c for c in existing.columns if c != key]
    last = batch.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*")
    return existing.join(last.select(key), key, "left_anti").unionByName(last)


def insert_ignore(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """``existing`` and the batch rows with new keys."""
    return existing.unionByName(batch.select(*existing.columns).join(existing.select(key), key, "left_anti"))


def matching(entities: DataFrame, trust: DataFrame, entity_type=None, status=None, tier=None) -> DataFrame:
    """One row: how many entities the filters of ``list_page`` leave."""
    out = entities
    for column, value in (("entity_type", entity_type), ("status", status)):
        out = out.where(F.col(column) == value) if value else out
    if tier:
        out = out.join(trust.where(F.col("tier") == tier), "entity_id", "left_semi")
    return out.agg(F.count("*").alias("total"))


def fetch(entities: DataFrame, ranked: DataFrame) -> DataFrame:
    """The entities of ranked ids (entity_id, rank) with their rank; ids that are unknown are left out."""
    return ranked.select("entity_id", "rank").join(entities, "entity_id")


def read_only(spark, statement: str) -> DataFrame:
    """The result of a statement that only reads; raises ValueError for any other, also one behind a reading first part."""
    from pyspark.errors import ParseException

    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except ParseException as e:
        raise ValueError("no statement") from e
    name = plan.getClass().getSimpleName()
    if name.endswith("Command") or name.startswith(("Insert", "Create", "Drop", "Delete", "Update", "Merge", "Truncate", "Alter", "Replace", "Set", "Add", "Load")):
        raise ValueError(f"not a reading statement: {name}")
    return spark.sql(statement)
