"""Retrieval for questions: intents, entities with their neighbourhood and open violations, and their text; jobs and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldenloom.functions.text import present
from goldenloom.operators.similarity import search, text_terms

#: Keys that a summary leaves out.
SYSTEM = ("id", "created_at", "updated_at", "version")


def summary(fields: Column, most: int = 3) -> Column:
    """The first three filled fields by key as k=v."""
    kept = F.array_sort(F.map_entries(F.map_filter(fields, lambda k, v: present(v) & ~k.isin(*SYSTEM))))
    return F.array_join(F.transform(F.slice(kept, 1, most), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def label(entity_id: Column, fields: Column) -> Column:
    """Name, full name, or the first eight characters of the id."""
    return F.coalesce(F.when(present(fields["name"]), fields["name"]), F.when(present(fields["full_name"]), fields["full_name"]), F.substring(entity_id, 1, 8))


def retrieve(entities: DataFrame, questions: list[str], k: int = 10) -> DataFrame:
    """question, rank, entity_id, entity_type, label, summary of the k entities nearest to each question."""
    terms = entities.select("entity_id", text_terms(F.col("fields")).alias("terms"))
    hits = search(terms, questions, k).select(F.col("query").alias("question"), "entity_id", "rank", "score")
    about = entities.select("entity_id", "entity_type", label(F.col("entity_id"), F.col("fields")).alias("label"), summary(F.col("fields")).alias("summary"))
    return hits.join(about, "entity_id")


def context(found: DataFrame, edges: DataFrame, violations: int, entities: int = 8, relations: int = 5, anchors: int = 3) -> DataFrame:
    """question, context: a text of the first entities, the relations of the best three, and the number of open violations (an argument)."""
    shown = found.where(F.col("rank") <= entities)
    line = F.concat(F.lit("  - ["), "entity_type", F.lit("] "), "label", F.lit(": "), "summary")
    heads = shown.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))).alias("e"))
    near = found.where(F.col("rank") <= anchors).select("question", "entity_id")
    touching = edges.select("source", "target", "type", F.explode(F.array("source", "target")).alias("entity_id"))
    rels = near.join(touching, "entity_id").select("question", "source", "target", "type").distinct()
    rels = rels.withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy("source", "target", "type"))).where(F.col("n") <= relations)
    arrow = F.concat(F.lit("  - "), "source", F.lit(" --["), "type", F.lit("]--> "), "target")
    rels = rels.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("n", arrow.alias("t")))).alias("r"))
    rows = heads.join(rels, "question", "left")
    texts = lambda c: F.transform(c, lambda x: x["t"])
    none = F.array().cast("array<string>")
    parts = F.concat(
        F.array(F.concat(F.lit("Query context for: '"), "question", F.lit("'"))), texts("e"),
        F.coalesce(F.concat(F.array(F.lit("Knowledge graph relationships:")), texts("r")), none),
        F.array(F.lit(f"Governance context: {violations} active violations")) if violations else none,
    )
    return rows.select("question", F.array_join(parts, "\n").alias("context"))


def pii_job(entities: DataFrame, detections: DataFrame) -> DataFrame:
    """entity_id, label, pii_count, fields of the entities that show personal data."""
    per = detections.groupBy("entity_id").agg(F.count("*").alias("pii_count"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))
    return per.join(entities.select("entity_id", label(F.col("entity_id"), F.col("fields")).alias("label")), "entity_id")


def trust_job(scores: DataFrame, quality: DataFrame) -> DataFrame:
    """entity_id, overall, tier, grade after trust and quality are computed anew."""
    return scores.select("entity_id", "overall", "tier").join(quality.select("entity_id", "grade"), "entity_id")


def tasks(**results: DataFrame) -> DataFrame:
    """agent_type, status, entities: one row for the result of each job that was run."""
    out = None
    for name, df in sorted(results.items()):
        row = df.agg(F.lit(name).alias("agent_type"), F.lit("completed").alias("status"), F.count("*").alias("entities"))
        out = row if out is None else out.unionByName(row)
    return out
