"""Sources: delimited files, JSON batches, manifests, event envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldenloom.functions.text import normalise_column, present
from goldenloom.operators.analytics import topic_of

ENVELOPE = "event_id string, event_type string, occurred_at timestamp, source string, entity_id string, payload map<string,string>"


def _to_entities(rows: DataFrame, entity_type: str, source: str, id_column: str | None) -> DataFrame:
    names = [c for c in rows.columns if c != id_column]
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.trim(F.col(f"`{c}`")).alias("value")) for c in names])
    fields = F.map_filter(F.map_from_entries(pairs), lambda _, v: present(v))
    own = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])), 256)
    ident = F.coalesce(F.col(f"`{id_column}`"), own) if id_column in rows.columns else own
    return rows.select(ident.alias("entity_id"), F.lit(entity_type).alias("entity_type"), F.lit(source).alias("source"), fields.alias("fields")).where(F.size("fields") > 0)


def read_csv(spark: SparkSession, path: str, entity_type: str, source: str = "csv_upload", keep_id: bool = True) -> DataFrame:
    """Entities of a headed file: names normalised, blanks dropped, empty rows skipped. Without ``keep_id`` the id is a digest of the row."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    named = raw.toDF(*[normalise_column(c.lstrip("﻿")) or f"column_{i}" for i, c in enumerate(raw.columns)])
    return _to_entities(named, entity_type, source, "id" if keep_id else None)


def read_samples(spark: SparkSession, **files: str) -> DataFrame:
    """Entities of several files, one entity type each: ``customer=path, supplier=path``."""
    out = None
    for entity_type, path in files.items():
        part = read_csv(spark, path, entity_type)
        out = part if out is None else out.unionByName(part)
    return out


def read_json(spark: SparkSession, path: str, entity_type: str, source: str = "api_integration") -> DataFrame:
    """Entities of JSON lines: ``fields`` where a record has them, else all but the id; the id where there is one, else a digest of the fields.

    Lines are read as texts, so a record may have any keys; values that are no texts are kept as JSON. Lines that are no records are skipped.
    """
    raw = spark.read.text(path)
    record = F.from_json("value", "map<string,string>")
    inner = F.from_json(F.col("r")["fields"], "map<string,string>")
    flat = F.map_filter("r", lambda k, v: k != "id")
    rows = raw.select(record.alias("r")).where("r IS NOT NULL").select(F.col("r")["id"].alias("id"), F.map_filter(F.coalesce(inner, flat), lambda _, v: present(v)).alias("fields"))
    digest = F.sha2(F.to_json(F.array_sort(F.map_entries("fields"))), 256)
    return rows.select(F.coalesce("id", digest).alias("entity_id"), F.lit(entity_type).alias("entity_type"), F.lit(source).alias("source"), "fields").where(F.size("fields") > 0)


def parse_events(raw: DataFrame, body: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid envelopes with topic and partition key, rows that are none) of JSON bodies, batch or stream."""
    rows = raw.withColumn("e", F.from_json(F.col(body).cast("string"), ENVELOPE))
    good = F.col("e.event_id").isNotNull() & F.col("e.event_type").isNotNull()
    events = rows.where(good).select("e.*").withColumn("topic", topic_of(F.col("event_type")))
    events = events.withColumn("partition_key", partition_key(F.col("event_type"), F.col("payload"), F.col("entity_id"), F.col("event_id")))
    return events, rows.where(~F.coalesce(good, F.lit(False))).drop("e")


#: What an event of a kind is keyed by, beside its entity.
KEYED_BY = {"entity.merged": "golden_record_id", "duplicate.detected": "entity_id_1", "batch.ingested": "batch_id", "agent.task.started": "task_id", "agent.task.completed": "task_id"}


def partition_key(event_type: Column, payload: Column, entity_id: Column, event_id: Column) -> Column:
    """The key of an event's class in the payload, else the entity, else the event itself."""
    own = F.lit(None).cast("string")
    for kind, key in KEYED_BY.items():
        own = F.when(event_type == kind, payload[key]).otherwise(own)
    return F.coalesce(own, entity_id, event_id)


def envelopes(rows: DataFrame, event_type: str, source: str) -> DataFrame:
    """JSON bodies (event_id, value) of entities (entity_id, fields, at) as events of a type; the id is a digest, so an event built again is the same."""
    ident = F.substring(F.sha2(F.concat_ws("|", F.lit(event_type), "entity_id", F.col("at").cast("string")), 256), 1, 32)
    event = F.struct(ident.alias("event_id"), F.lit(event_type).alias("event_type"), F.col("at").alias("occurred_at"), F.lit(source).alias("source"), "entity_id", F.col("fields").alias("payload"))
    return rows.select(ident.alias("event_id"), F.to_json(event).alias("value"))


def batch_status(rows: DataFrame, by: str, failed: Column) -> DataFrame:
    """Rows, processed and failed ones of every batch, and its status."""
    n = rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(failed).alias("failed"))
    status = F.when(F.col("failed") == 0, "completed").when(F.col("failed") < F.col("total"), "completed_with_errors").otherwise("failed")
    return n.select(by, "total", (F.col("total") - F.col("failed")).alias("processed"), "failed", status.alias("status"))


def requirements(manifests: DataFrame) -> DataFrame:
    """path, package, version of pinned lines of requirement files (path, content)."""
    rows = manifests.select("path", F.explode(F.split("content", r"\R")).alias("line"))
    found = F.regexp_extract("line", r"^\s*([A-Za-z0-9._-]+)\s*(?:==|>=|~=)\s*([0-9][^\s;#]*)", 1), F.regexp_extract("line", r"^\s*([A-Za-z0-9._-]+)\s*(?:==|>=|~=)\s*([0-9][^\s;#]*)", 2)
    return rows.select("path", F.lower(found[0]).alias("package"), found[1].alias("version")).where("package <> ''")


def package_json(manifests: DataFrame) -> DataFrame:
    rows = manifests.select("path", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("m"))
    both = F.map_concat(F.coalesce("m.dependencies", F.create_map().cast("map<string,string>")), F.coalesce("m.devDependencies", F.create_map().cast("map<string,string>")))
    return rows.select("path", F.explode(both).alias("package", "raw")).select("path", F.lower("package").alias("package"), F.regexp_replace("raw", r"^[\^~>=<\s]+", "").alias("version"))


def write_events(stream: DataFrame, **options):
    """A keyed JSON stream for a Kafka sink, if its connector is on the class path."""
    body = stream.select(F.col("partition_key").alias("key"), F.to_json(F.struct("*")).alias("value"), "topic")
    return body.writeStream.format("kafka").options(**options)


def pom_xml(manifests: DataFrame) -> DataFrame:
    """path, package, version of the dependencies of project files."""
    found = F.regexp_extract_all("content", F.lit(r"(?s)<artifactId>([^<]+)</artifactId>.*?<version>([^<]+)</version>"), F.lit(0))
    rows = manifests.select("path", F.explode(found).alias("d"))
    one = lambda tag: F.trim(F.regexp_extract("d", f"<{tag}>([^<]+)</{tag}>", 1))
    return rows.select("path", F.lower(one("artifactId")).alias("package"), one("version").alias("version"))
