"""Time series of events as load metrics: smoothing, forecast, sizing, thrash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldenloom.operators.analytics import exact_percentiles


def hourly(events: DataFrame) -> DataFrame:
    """Mean value per event type and hour, scaled to 0..1 by 100."""
    return events.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.least(F.lit(1.0), F.avg("value") / 100.0), 6).alias("load"))


def smoothed(series: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Exponential smoothing of each series (hours, not rows, per series), an ordered fold; with the slope of its last three points."""
    ordered = series.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("hour", "load"))).alias("s"))
    loads = F.transform("s", lambda x: x["load"])
    level = F.aggregate(loads, F.lit(None).cast("double"), lambda acc, v: F.when(acc.isNull(), v).otherwise(alpha * v + (1 - alpha) * acc))
    slope = F.when(F.size("s") >= 3, (F.element_at(loads, -1) - F.element_at(loads, -3)) / 2.0).otherwise(0.0)
    return ordered.select("event_type", F.size("s").cast("bigint").alias("points"), F.round(level, 4).alias("level"), F.round(slope, 4).alias("slope"))


def multiplier(hour: Column, weekday: Column) -> Column:
    """Day and hour profile; weekday 0 is Monday."""
    return (
        F.when(weekday >= 5, 0.6).when(hour.between(9, 11) | hour.between(14, 16), 1.3).when(hour.between(12, 13), 1.1)
        .when((hour < 7) | (hour >= 22), 0.5).otherwise(1.0)
    )


def scaling(levels: DataFrame, at: str, ahead: int = 30, replicas: int = 4, most: int = 20, least: int = 1) -> DataFrame:
    """Load that is forecast for ``ahead`` minutes after ``at``, by the profile of that hour, and the replicas it asks for; less than three points say nothing."""
    then = F.lit(at).cast("timestamp") + F.make_interval(mins=F.lit(ahead))
    load = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("level") + F.col("slope")) * multiplier(F.hour(then), F.weekday(then)))
    up = F.least(F.lit(most), F.ceil(replicas * F.col("load") / 0.70)).cast("int")
    down = F.greatest(F.lit(least), F.floor(F.lit(0.6 * replicas))).cast("int")
    out = levels.where("points >= 3").select("event_type", F.round(load, 4).alias("load"))
    wanted = F.when(F.col("load") > 0.70, up).when((F.col("load") < 0.30) & F.lit(replicas > least), down).otherwise(replicas)
    action = F.when(F.col("load") > 0.70, "scale_up").when((F.col("load") < 0.30) & F.lit(replicas > least), "scale_down").otherwise("keep")
    return out.select("event_type", "load", action.alias("action"), wanted.cast("int").alias("replicas"))


def right_sizing(events: DataFrame) -> DataFrame:
    """Requests and limits per user from exact percentiles."""
    n = events.groupBy("user_id").agg(F.count("*").alias("samples"))
    p = exact_percentiles(events, "user_id", "value", (0.5, 0.95, 0.99))
    return n.join(p, "user_id", "left").select("user_id", "samples", *[F.round(F.round(F.col(c) * k, 8), 4).alias(n) for c, k, n in (("p0", 1.1, "request"), ("p1", 1.3, "limit"), ("p2", 1.5, "peak"))])


def variation(events: DataFrame) -> DataFrame:
    """Mean, population variance and coefficient of variation per event type."""
    g = events.groupBy("event_type").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    return g.select("event_type", F.round("m", 4).alias("mean"), F.round("v", 4).alias("variance"), F.round(F.sqrt("v") / F.col("m"), 4).alias("cv"))


def thrash(events: DataFrame, minutes: int = 10) -> DataFrame:
    """Users whose consecutive events turn direction within the given minutes: turns and share of all steps."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = events.withColumn("d1", F.sign(F.col("value") - F.lag("value").over(w))).withColumn("gap", F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(w).cast("timestamp").cast("double"))
    steps = steps.withColumn("d0", F.lag("d1").over(w)).where("d0 IS NOT NULL")
    turn = (F.col("d0") * F.col("d1") < 0) & (F.col("gap") <= 60 * minutes)
    return steps.groupBy("user_id").agg(F.count_if(turn).alias("turns"), F.round(F.avg(turn.cast("double")), 4).alias("share"))
