"""History of changing attributes: consecutive snapshot differencing.

Captures of one key are numbered; capture k is compared with capture k-1 by a
full outer join on (key, number). Numbering and ``lead`` run in two levels, in
(key, chunk) and then over one row per (key, chunk). A key has one chunk per
LIMIT captures, cut at quantiles of their times, so a key that holds a large part
of all rows is spread over tasks of bounded size however its times lie.

Defined results: rows without key or capture time are not part of any history;
captures of one key that share a time count once, by highest version (null
lowest), then latest arrival, then a deletion before a live state; null, empty
and absent field values are the same, and so are null and empty status; an
empty table gives an empty history; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldenloom.session import Scratch, utc_text

OPEN_END = "9999-12-31 00:00:00"
#: Captures of one key in a chunk, and chunks of one key at most.
LIMIT, CHUNKS = 1_000_000, 1_024


def state_digest(status: Column, fields: Column) -> Column:
    """Digest of status and the non-empty fields, free of key order."""
    kept = F.map_filter(fields, lambda _, v: v.isNotNull() & (v != ""))
    entries = F.coalesce(F.array_sort(F.map_entries(kept)), F.array().cast("array<struct<key:string,value:string>>"))
    return F.unhex(F.sha2(F.to_json(F.struct(F.coalesce(status, F.lit("")).alias("s"), entries.alias("f"))), 256))


def with_chunks(df: DataFrame, key: str, at: str, limit: int) -> DataFrame:
    """Adds ``chunk``: 0 for keys of up to ``limit`` rows, else the number of quantiles of the key's times that a row has passed."""
    hot = df.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit)
    cuts = F.array(*[F.lit(i / CHUNKS) for i in range(1, CHUNKS)])
    times = df.join(hot, key, "left_semi").groupBy(key).agg(F.percentile_approx(F.col(at).cast("double"), cuts, 1_000).alias("_all"))
    # As many of the quantiles as the key needs.
    step = F.greatest(F.lit(1), F.floor(F.lit(CHUNKS) * limit / F.col("_rows")).cast("int"))
    bounds = times.join(hot, key).select(key, F.array_distinct(F.filter("_all", lambda _, i: (i + 1) % step == 0)).alias("_cuts"))
    passed = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c <= F.col(at).cast("double")))
    return df.join(bounds, key, "left").withColumn("chunk", passed).drop("_cuts")


def numbered(df: DataFrame, key: str, at: str) -> DataFrame:
    """Adds ``seq``: 1, 2, ... by ``at`` within ``key``, over its chunks."""
    inner = df.withColumn("_in", F.row_number().over(Window.partitionBy(key, "chunk").orderBy(at)))
    sizes = df.groupBy(key, "chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return inner.join(offsets, [key, "chunk"]).withColumn("seq", F.col("_in") + F.col("_off")).drop("_in", "_off")


def chunked_lead(df: DataFrame, key: str, at: str, out: str) -> DataFrame:
    """``lead(at)`` over ``key``: inside (key, chunk), else the first ``at`` of the key's next chunk."""
    inside = df.withColumn("_lead", F.lead(at).over(Window.partitionBy(key, "chunk").orderBy(at)))
    firsts = df.groupBy(key, "chunk").agg(F.min(at).alias("_first"))
    nexts = firsts.select(
        key, "chunk", F.lead("_first").over(Window.partitionBy(key).orderBy("chunk")).alias("_next")
    )
    return (
        inside.join(nexts, [key, "chunk"])
        .withColumn(out, F.coalesce("_lead", "_next"))
        .drop("_lead", "_next")
    )


def change_events(captures: DataFrame, scratch: Scratch, limit: int = LIMIT) -> tuple[DataFrame, bool]:
    """One row per change: entity_id, at, kind ('inserted', 'changed', 'deleted'), chunk; and whether any key has more than one chunk.

    Where none has, numbering is one window; the numbers are the same.
    """
    rows = captures.where(F.col("entity_id").isNotNull() & F.col("captured_at").isNotNull()).select(
        "entity_id",
        "captured_at",
        F.struct(
            "version",
            "ingested_at",
            F.col("deleted_at").isNotNull().alias("gone"),
            state_digest(F.col("status"), F.col("fields")).alias("state"),
        ).alias("c"),
    )
    single = rows.groupBy("entity_id", "captured_at").agg(F.max("c").alias("c"))
    single = scratch.save(single.select("entity_id", "captured_at", "c.gone", "c.state"), "captures")
    hot = not single.groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n") > limit).isEmpty()
    if hot:
        snaps = numbered(with_chunks(single, "entity_id", "captured_at", limit), "entity_id", "captured_at")
    else:
        snaps = single.withColumn("seq", F.row_number().over(Window.partitionBy("entity_id").orderBy("captured_at"))).withColumn("chunk", F.lit(0))
    snaps = scratch.save(snaps, "snapshots")
    cur = snaps.alias("cur")
    old = snaps.select("entity_id", (F.col("seq") + 1).alias("seq"), "gone", "state").alias("old")
    joined = cur.join(
        old,
        F.col("cur.entity_id").eqNullSafe(F.col("old.entity_id")) & F.col("cur.seq").eqNullSafe(F.col("old.seq")),
        "full_outer",
    )
    here, live = F.col("cur.entity_id").isNotNull(), ~F.col("cur.gone")
    was_live = F.col("old.entity_id").isNotNull() & ~F.col("old.gone")
    kind = (
        F.when(here & live & ~was_live, "inserted")
        .when(here & live & ~F.col("cur.state").eqNullSafe(F.col("old.state")), "changed")
        .when(here & ~live & was_live, "deleted")
    )
    events = joined.select(
        F.col("cur.entity_id").alias("entity_id"),
        F.col("cur.captured_at").alias("at"),
        F.col("cur.chunk").alias("chunk"),
        kind.alias("kind"),
    ).where("kind IS NOT NULL")
    return events, hot


def versions(captures: DataFrame, limit: int = LIMIT) -> DataFrame:
    """entity_id, valid_from, valid_to: one row per period in which one state held."""
    scratch = Scratch(captures.sparkSession, "history")
    events, hot = change_events(captures, scratch, limit)
    events = scratch.save(events, "events")
    scratch.drop("captures", "snapshots")
    if hot:
        ended = chunked_lead(events, "entity_id", "at", "until")
    else:
        ended = events.withColumn("until", F.lead("at").over(Window.partitionBy("entity_id").orderBy("at")))
    return ended.where("kind <> 'deleted'").select(
        "entity_id",
        utc_text(F.col("at")).alias("valid_from"),
        F.coalesce(utc_text(F.col("until")), F.lit(OPEN_END)).alias("valid_to"),
    )
