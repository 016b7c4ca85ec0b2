"""Lineage as events: constructors, what led to an entity, what came of it, and the graph of both.

An event has event_id, operation, entity_id, at, actor, source and sources (the ids that it was made from).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = ("event_id", "operation", "entity_id", "at", "actor", "source", "sources")


def _event(operation: str | Column, entity: Column, at: Column, actor: Column, source: Column, sources: Column) -> list[Column]:
    op = F.lit(operation) if isinstance(operation, str) else operation
    ident = F.substring(F.sha2(F.concat_ws("|", op, entity, at.cast("string"), F.array_join(sources, "+")), 256), 1, 16)
    return [ident.alias("event_id"), op.alias("operation"), entity.alias("entity_id"), at.alias("at"), actor.alias("actor"), source.alias("source"), sources.alias("sources")]


def _none() -> Column:
    return F.array().cast("array<string>")


def log_events(log: DataFrame) -> DataFrame:
    """Events of a log of captures: the first ingests, later ones update, a deletion deletes; an entity merged into another is a source of it."""
    rows = log.where("entity_id IS NOT NULL AND captured_at IS NOT NULL").select("entity_id", "captured_at", "source", "merged_into", F.col("deleted_at").isNotNull().alias("gone")).distinct()
    born = rows.groupBy("entity_id").agg(F.min("captured_at").alias("born"))
    op = F.when(F.col("gone"), "deleted").when(F.col("captured_at") == F.col("born"), "ingested").otherwise("updated")
    system = F.lit("system")
    own = rows.join(born, "entity_id").select(*_event(op, F.col("entity_id"), F.col("captured_at"), system, F.coalesce("source", F.lit("unknown")), _none())).distinct()
    into = rows.where("merged_into IS NOT NULL").groupBy("entity_id", "merged_into").agg(F.min("captured_at").alias("at"))
    return own.unionByName(into.select(*_event("merged", F.col("merged_into"), F.col("at"), system, F.lit("merge"), F.array("entity_id"))))


def merge_events(pairs: DataFrame, target: Column, at: str) -> DataFrame:
    """Of every merge of (id_a, id_b) one event of the new entity with both sources, and one of each source that names it."""
    when, actor, source = F.lit(at).cast("timestamp"), F.lit("system"), F.lit("merge")
    rows = pairs.select("id_a", "id_b", target.alias("new"))
    made = rows.select(*_event("merged", F.col("new"), when, actor, source, F.array("id_a", "id_b")))
    ends = rows.select(F.explode(F.array("id_a", "id_b")).alias("old"), "new")
    return made.unionByName(ends.select(*_event("merged_into", F.col("old"), when, actor, source, _none())))


def simple_events(entities: DataFrame, operation: str, at: str, actor: str = "system") -> DataFrame:
    """One event of an operation (enriched, pii_masked, updated, ...) for every entity (entity_id, source)."""
    return entities.select(*_event(operation, F.col("entity_id"), F.lit(at).cast("timestamp"), F.lit(actor), F.coalesce("source", F.lit("unknown")), _none()))


def lineage_of(events: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, and the events of each asked entity and of those that it was directly made from, by time."""
    want = asked.select(F.col("entity_id").alias("asked")).distinct()
    up = events.join(want, events["entity_id"] == want["asked"]).select("asked", F.explode("sources").alias("of"))
    ids = want.select("asked", F.col("asked").alias("of")).unionByName(up).distinct()
    return events.join(ids, F.col("entity_id") == F.col("of")).select("asked", "entity_id", "operation", "at", "source", F.col("of").eqNullSafe(F.col("asked")).alias("own"))


def edges(events: DataFrame) -> DataFrame:
    """Distinct source, target, type of what entities were made from."""
    return events.select(F.explode("sources").alias("source"), F.col("entity_id").alias("target")).select("source", "target", F.lit("DERIVED_FROM").alias("type")).distinct()


def downstream(events: DataFrame) -> DataFrame:
    """entity_id, derived: how many entities were directly made from each."""
    return edges(events).groupBy(F.col("source").alias("entity_id")).agg(F.count("*").alias("derived"))


def export(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with the number of their events and the last one, edges) of the lineage graph."""
    nodes = events.groupBy("entity_id").agg(F.count("*").alias("events"), F.max_by("operation", F.struct("at", "event_id")).alias("last"))
    return nodes, edges(events)


def stats(events: DataFrame) -> DataFrame:
    return events.groupBy("operation").agg(F.count("*").alias("events"), F.count_distinct("entity_id").alias("entities"))


def sources_of(log: DataFrame) -> DataFrame:
    """entity_id, source, first and last capture: the sources that an entity came from."""
    return log.where("entity_id IS NOT NULL AND source IS NOT NULL").groupBy("entity_id", "source").agg(F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen"))
