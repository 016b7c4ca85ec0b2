"""Roll-ups over entities, resolution results, logs and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldenloom import rules


def counts(entities: DataFrame) -> DataFrame:
    """Entities by type, by status and by source in one pass."""
    grouped = entities.groupingSets([["entity_type"], ["status"], ["source"]], "entity_type", "status", "source").agg(
        F.count("*").alias("entities"), F.grouping_id().alias("g")
    )
    kind = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "status").otherwise("source")
    value = F.when(F.col("g") == 3, F.col("entity_type")).when(F.col("g") == 5, F.col("status")).otherwise(F.col("source"))
    return grouped.select(kind.alias("kind"), value.alias("value"), "entities")


def resolution_stats(results: DataFrame) -> DataFrame:
    one = results.dropDuplicates(["result_id"])
    done = F.col("action").isin("auto_merge", "approved")
    return one.groupBy("entity_type").agg(
        F.count("*").alias("results"), F.count_if(done).alias("merged"), F.count_if(F.col("action") == "review").alias("review"),
        F.round(F.avg(done.cast("double")), 4).alias("merge_rate"), F.round(F.avg("combined"), 4).alias("avg_combined"),
    )


def lineage_events(log: DataFrame) -> DataFrame:
    """The log as lineage events: the first capture creates, later ones update, a deletion deletes, a merge merges."""
    first = log.where("entity_id IS NOT NULL AND captured_at IS NOT NULL").groupBy("entity_id").agg(F.min("captured_at").alias("born"))
    rows = log.where("captured_at IS NOT NULL").select("entity_id", "captured_at", "source", "merged_into", "deleted_at").distinct().join(first, "entity_id")
    op = (
        F.when(F.col("deleted_at").isNotNull(), "deleted").when(F.col("merged_into").isNotNull(), "merged")
        .when(F.col("captured_at") == F.col("born"), "created").otherwise("updated")
    )
    return rows.select("entity_id", "captured_at", "source", op.alias("operation"))


def lineage_stats(log: DataFrame) -> DataFrame:
    return lineage_events(log).groupBy("operation").agg(F.count("*").alias("events"), F.count_distinct("entity_id").alias("entities"))


def rate_windows(events: DataFrame, limit: int = 3, size: str = "60 seconds") -> DataFrame:
    """Events per user and window, and whether they exceed the limit."""
    w = events.groupBy("user_id", F.window("ts", size).alias("w")).agg(F.count("*").alias("requests"))
    return w.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests", (F.col("requests") > limit).alias("limited"))


def exact_percentiles(rows: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """``by`` and the interpolated percentiles p0, p1, ... of ``value``, exact, without holding a group's values in one task.

    Values are counted per group first; cumulative counts are summed in two levels, inside ranges of values and over the ranges' totals. The two
    values between which a percentile lies are then picked by rank.
    """
    seen = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ends = seen.groupBy(by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    part = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 256)).otherwise(F.lit(0))
    cut = seen.join(ends, by).withColumn("part", part.cast("int"))
    inside = cut.withColumn("upto", F.sum("n").over(Window.partitionBy(by, "part").orderBy("v")))
    sums = cut.groupBy(by, "part").agg(F.sum("n").alias("m"))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(by, "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("off"))
    ranked = inside.join(offsets, [by, "part"]).withColumn("last", F.col("off") + F.col("upto")).withColumn("first", F.col("last") - F.col("n"))
    out = []
    for i, share in enumerate(shares):
        at = (F.col("total") - 1) * share
        low, high = F.floor(at), F.ceil(at)
        holds = lambda r: (F.col("first") <= r) & (r < F.col("last"))
        x, y = F.max(F.when(holds(low), F.col("v"))), F.max(F.when(holds(high), F.col("v")))
        out.append(F.when((F.max(low) == F.max(high)) | (x == y), x).otherwise(F.max(high - at) * x + F.max(at - low) * y).alias(f"p{i}"))
    return ranked.groupBy(by).agg(*out)


def telemetry(events: DataFrame) -> DataFrame:
    """Per event type: requests, share of all, exact percentiles of the value."""
    out = events.groupBy("event_type").agg(F.count("*").alias("requests"))
    p = exact_percentiles(events, "event_type", "value", (0.5, 0.95, 0.99))
    share = F.col("requests") / F.sum("requests").over(Window.partitionBy())
    return out.join(p, "event_type", "left").select(
        "event_type", "requests", F.round(share, 4).alias("share"), *[F.round(F.col(c), 4).alias(n) for c, n in (("p0", "p50"), ("p1", "p95"), ("p2", "p99"))]
    )


def panels(events: DataFrame, size: str = "2 minutes") -> DataFrame:
    """Per window: events, rate a second, share of errors and users."""
    w = events.groupBy(F.window("ts", size).alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("user_id").alias("users"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "events", F.round(F.col("events") / seconds, 6).alias("rate"), F.round(F.col("errors") / F.col("events"), 6).alias("error_share"), "users")


def tallies(kind: str, df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.lit(kind).alias("measure"), F.count("*").cast("double").alias("amount")).select("measure", "value", "amount")


def totals(**measures: DataFrame) -> DataFrame:
    """measure, value (null), amount: the rows of each frame."""
    out = None
    for name, df in measures.items():
        row = df.agg(F.lit(name).alias("measure"), F.lit(None).cast("string").alias("value"), F.count("*").cast("double").alias("amount"))
        out = row if out is None else out.unionByName(row)
    return out


def summary(entities: DataFrame, trust: DataFrame, quality: DataFrame, violations: DataFrame, merges: DataFrame, waiting: DataFrame, classes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The thirteen measures of the overview in long form: measure, value, amount."""
    out = totals(total_entities=entities, total_violations=violations, total_merges=merges, queue_size=waiting, ontology_classes=classes.select("class_name").distinct(), graph_nodes=nodes, graph_edges=edges)
    for kind, df, column in (("by_type", entities, "entity_type"), ("by_status", entities, "status"), ("by_tier", trust, "tier"), ("by_grade", quality, "grade"), ("violations_by_severity", violations, "severity")):
        out = out.unionByName(tallies(kind, df, column))
    return out.unionByName(trust.agg(F.lit("avg_trust").alias("measure"), F.lit(None).cast("string").alias("value"), F.round(F.avg("overall"), 4).alias("amount")))


def dashboard(entities: DataFrame, trust: DataFrame, quality: DataFrame) -> DataFrame:
    """One row by status: entities, mean trust and quality of three places."""
    rows = entities.select("entity_id", "status").join(trust.select("entity_id", F.col("overall").alias("t")), "entity_id", "left").join(quality.select("entity_id", F.col("overall").alias("q")), "entity_id", "left")
    return rows.groupBy("status").agg(F.count("*").alias("entities"), F.round(F.avg("t"), 3).alias("avg_trust"), F.round(F.avg("q"), 3).alias("avg_quality"))


def topic_of(event_type):
    topics = F.create_map(*[F.lit(x) for kv in rules.TOPICS.items() for x in kv])
    return F.coalesce(topics[event_type], F.concat(F.lit("mdm."), event_type))


def intents(docs: DataFrame) -> DataFrame:
    """The first intent whose words a text holds."""
    text = F.lower("text")
    intent = F.lit("overview")
    for name, keys in reversed(rules.INTENTS):
        hit = F.lit(False)
        for k in keys:
            hit |= text.contains(k)
        intent = F.when(hit, F.lit(name)).otherwise(intent)
    return docs.where("text IS NOT NULL").select("doc_id", intent.alias("intent"))
