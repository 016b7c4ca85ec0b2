"""Structured Streaming operators over the event stream; the same code serves batch tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldenloom.functions.text import present
from goldenloom.operators.trust import scores_dev


def rate_limited(events: DataFrame, limit: int, size: str = "60 seconds", late: str = "1 hour") -> DataFrame:
    """Tumbling request counts per user with a limit flag; rows later than ``late`` are dropped by the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "user_id").agg(F.count("*").alias("requests"))
    return w.select(F.col("window.start").alias("window_start"), "user_id", "requests", (F.col("requests") > limit).alias("limited"))


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows per user (an extension)."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return s.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "user_id", "events")


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """Appends a normalised, deduplicated stream to a table, exactly once per batch; returns the query."""
    clean = deduplicated(stream.where("event_id IS NOT NULL"))
    return clean.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def scored_ingest(stream: DataFrame, path: str, checkpoint: str, bad_path: str):
    """Entities (entity_id, entity_type, source, fields, created_at) of a stream with blanks dropped and their trust, appended batch by batch.

    Rows without an id or without any field go to ``bad_path``; a batch that is run again replaces its own folder, so nothing is written twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("fields", F.map_filter("fields", lambda _, v: present(F.trim(v)))).withColumn("good", F.col("entity_id").isNotNull() & (F.coalesce(F.size("fields"), F.lit(0)) > 0))
        rows.persist()
        good = rows.where("good").drop("good")
        trust = scores_dev(good).select("entity_id", "overall", "tier")
        good.dropDuplicates(["entity_id"]).join(trust.dropDuplicates(["entity_id"]), "entity_id").write.mode("overwrite").parquet(f"{path}/batch={number}")
        rows.where("NOT good").drop("good").write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LATEST = "entity_id string, overall double, change double, computed_at timestamp"


def latest_trust(scores: DataFrame) -> DataFrame:
    """The newest score of each entity whenever one arrives, with its change against the one before; a late score changes nothing.

    State: one score and its time per entity.
    """
    def run(key, frames, state):
        best, at = state.get if state.exists else (None, None)
        out = []
        for pdf in frames:
            for row in pdf.sort_values("computed_at").itertuples(index=False):
                when = row.computed_at.to_pydatetime()
                if at is None or when > at:
                    out.append((key[0], row.overall, None if best is None else row.overall - best, row.computed_at))
                    best, at = float(row.overall), when
        if at is not None:
            state.update((best, at))
        yield pd.DataFrame(out, columns=["entity_id", "overall", "change", "computed_at"])

    rows = scores.where("entity_id IS NOT NULL AND overall IS NOT NULL AND computed_at IS NOT NULL").select("entity_id", "overall", "computed_at")
    return rows.groupBy("entity_id").applyInPandasWithState(run, LATEST, "overall double, at timestamp", "append", "NoTimeout")


def resolutions(events: DataFrame, entity_type: str | None = None, least: float = 0.0) -> DataFrame:
    """Resolution events of a type with at least the confidence; the same over a stream and a table."""
    out = events.where(F.col("combined") >= least)
    return out.where(F.col("entity_type") == entity_type) if entity_type else out


def sliding(events: DataFrame, size: str = "10 minutes", step: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per user in sliding windows (an extension)."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "user_id").agg(F.count("*").alias("events"))
    return w.select(F.col("window.start").alias("window_start"), "user_id", "events")
