"""Trust and quality scores: projections over the current entities, and aggregates over score logs."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldenloom import rules
from goldenloom.functions.text import age_days, grade, norm, present, tier
from goldenloom.operators.entities import AS_OF, field

DIMENSIONS = ("completeness", "consistency", "recency", "source_reliability", "validity")


def _by_type(of, otherwise: Column, profile: str) -> Column:
    out = F.lit(None)
    for kind, fields in rules.REQUIRED[profile].items():
        out = F.when(F.col("entity_type") == kind, of(fields)).otherwise(out)
    return F.when(F.col("entity_type").isin(*rules.REQUIRED[profile]), out).otherwise(otherwise)


def _filled(fields) -> Column:
    return reduce(add, [present(field(f)).cast("int") for f in fields])


def completeness(profile: str) -> Column:
    """Share of required fields present; service adds 0.01 per further field, 0.10 at most."""
    if profile == "dev":
        return _by_type(lambda fs: _filled(fs) / F.lit(float(len(fs))), present(field("name")).cast("double"), profile)
    populated = F.coalesce(F.size(F.map_filter("fields", lambda _, v: present(v))), F.lit(0))

    def one(fs):
        bonus = F.least(F.lit(0.10), F.greatest(F.lit(0.0), 0.01 * (populated - len(fs))))
        return F.least(F.lit(1.0), _filled(fs) / F.lit(float(len(fs))) + bonus)

    return _by_type(one, one(("name",)), profile)


def source_trust(profile: str, source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in rules.SOURCE_TRUST[profile].items() for x in kv])
    return F.coalesce(table[source], F.lit(rules.UNKNOWN_SOURCE[profile]))


def _checks(profile: str) -> list[tuple[str, Column]]:
    out = [(f, field(f).rlike(p)) for f, p in rules.VALID[profile].items()]
    if profile == "dev":
        out += [("phone", F.length(F.regexp_replace(field("phone"), r"\D", "")) >= 7), ("tax_id", F.length(F.trim(field("tax_id"))) >= 5)]
    return out


def validity(profile: str) -> Column:
    checks = _checks(profile)
    seen = reduce(add, [present(field(f)).cast("int") for f, _ in checks])
    good = reduce(add, [(present(field(f)) & ok).cast("int") for f, ok in checks])
    # Of the service profile's scores, an entity without fields is half valid, one with nothing to check .8.
    empty = F.coalesce(F.size(F.map_filter("fields", lambda _, v: present(v))), F.lit(0)) == 0
    none = F.lit(0.0) if profile == "dev" else F.when(empty, 0.50).otherwise(0.80)
    return F.when(seen > 0, F.coalesce(good, F.lit(0)) / seen).otherwise(none)


def recency(at: Column, as_of: str = AS_OF) -> Column:
    return F.coalesce(F.round(F.exp(-F.greatest(age_days(at, as_of), F.lit(0)) / 180.0), 4), F.lit(0.5))


def scores_dev(entities: DataFrame, as_of: str = AS_OF) -> DataFrame:
    rated = entities.select(
        "entity_id", "entity_type", completeness("dev").alias("completeness"), recency(F.col("created_at"), as_of).alias("recency"),
        source_trust("dev", F.col("source")).alias("source_reliability"),
    )
    overall = F.round(0.35 * F.col("completeness") + 0.20 * F.col("recency") + 0.30 * F.col("source_reliability") + 0.15, 4)
    return rated.withColumn("overall", overall).withColumn("tier", tier(F.col("overall")))


def scores_service(entities: DataFrame, as_of: str = AS_OF, weights=(0.30, 0.20, 0.18, 0.22, 0.10)) -> DataFrame:
    rated = entities.select(
        "entity_id", "entity_type", completeness("service").alias("completeness"), F.lit(1.0).alias("consistency"),
        recency(F.col("updated_at"), as_of).alias("recency"), source_trust("service", F.col("source")).alias("source_reliability"),
        validity("service").alias("validity"),
    )
    total = sum(weights)
    overall = reduce(add, [w / total * F.col(d) for w, d in zip(weights, DIMENSIONS)])
    return rated.withColumn("overall", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), overall)), 4)).withColumn("tier", tier(F.col("overall")))


def rollup_by_type(scores: DataFrame) -> DataFrame:
    o = F.coalesce("overall", F.lit(0.0))
    return scores.groupBy("entity_type").agg(
        F.round(F.avg(o), 4).alias("avg_trust"), F.round(F.min(o), 4).alias("min_trust"), F.round(F.max(o), 4).alias("max_trust"),
        F.count("*").alias("entities"),
    )


def latest(log: DataFrame) -> DataFrame:
    """Latest score of every entity in an append-only log."""
    order = F.struct("computed_at", "overall", "completeness")
    best = log.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.max_by(F.struct("overall", "completeness", "computed_at"), order).alias("r"))
    return best.select("entity_id", "r.*")


def latest_tier(log: DataFrame) -> DataFrame:
    """entity_id and the tier of its latest score."""
    return latest(log).select("entity_id", tier(F.col("overall")).alias("tier"))


def anomalies(log: DataFrame) -> DataFrame:
    """Drops of the latest score against the mean of the earlier ones: overall by 0.15, a dimension by 0.20."""
    rows = log.where("entity_id IS NOT NULL AND computed_at IS NOT NULL").select("entity_id", "computed_at", "overall", *DIMENSIONS).distinct()
    last = rows.groupBy("entity_id").agg(F.max("computed_at").alias("last"))
    both = rows.join(last, "entity_id")
    names = ("overall", *DIMENSIONS)
    now, past = F.col("computed_at") == F.col("last"), F.col("computed_at") < F.col("last")
    agg = both.groupBy("entity_id").agg(*[F.max(F.when(now, F.col(n))).alias(f"now_{n}") for n in names],
                                        *[F.avg(F.when(past, F.col(n))).alias(f"past_{n}") for n in names])
    found = F.array(*[
        F.struct(F.lit(n).alias("dimension"), F.round(F.col(f"past_{n}") - F.col(f"now_{n}"), 8).alias("drop"), F.lit(0.15 if n == "overall" else 0.20).alias("limit"))
        for n in names
    ])
    out = agg.select("entity_id", F.explode(found).alias("a")).select("entity_id", "a.*").where(F.col("drop") > F.col("limit"))
    severity = F.when((F.col("dimension") == "overall") & (F.col("drop") > 0.25), "high").otherwise("medium")
    return out.select("entity_id", "dimension", "drop", severity.alias("severity"))


def consistency_by_group(candidates: DataFrame) -> DataFrame:
    """Share of a group's keys with at most one distinct normalised value."""
    rows = candidates.where("golden_record_id IS NOT NULL").select("golden_record_id", F.explode("fields").alias("field", "value")).where(present(F.col("value")))
    per = rows.groupBy("golden_record_id", "field").agg(F.count_distinct(F.lower(F.trim("value"))).alias("n"))
    return per.groupBy("golden_record_id").agg(F.round(F.avg((F.col("n") <= 1).cast("double")), 4).alias("consistency"))


def reliability_by_group(candidates: DataFrame, profile: str = "service") -> DataFrame:
    """0.7 best + 0.3 mean of the trust of a group's distinct sources."""
    t = source_trust(profile, F.col("source"))
    rows = candidates.where("golden_record_id IS NOT NULL AND source IS NOT NULL").select("golden_record_id", "source").distinct()
    return rows.groupBy("golden_record_id").agg(F.round(0.7 * F.max(t) + 0.3 * F.avg(t), 8).alias("source_reliability"))


def name_of() -> Column:
    return F.coalesce(field("name"), field("full_name"))


def quality(entities: DataFrame, trust: DataFrame) -> DataFrame:
    """Completeness .35, validity .25, uniqueness .25, timeliness .15, with a grade. Names are counted by a pre-aggregated join; merged records count too."""
    rows = entities.select("entity_id", "entity_type", norm(field("name")).alias("name"), completeness("dev").alias("completeness"), validity("dev").alias("validity"))
    same = rows.where(present(F.col("name"))).groupBy("entity_type", "name").agg((F.count("*") - 1).alias("others"))
    rows = rows.join(same, ["entity_type", "name"], "left").join(trust.select("entity_id", F.col("recency").alias("timeliness")), "entity_id", "left")
    unique = F.when(present(F.col("name")), F.greatest(F.lit(0.0), 1 - 0.3 * F.coalesce("others", F.lit(0)))).otherwise(0.5)
    rows = rows.withColumn("uniqueness", unique).withColumn("timeliness", F.coalesce("timeliness", F.lit(0.5)))
    overall = 0.35 * F.col("completeness") + 0.25 * F.col("validity") + 0.25 * F.col("uniqueness") + 0.15 * F.col("timeliness")
    return rows.select("entity_id", "entity_type", "completeness", "validity", "uniqueness", "timeliness", F.round(F.round(overall, 8), 4).alias("overall")).withColumn(
        "grade", grade(F.col("overall"))
    )


def quality_averages(scores: DataFrame) -> DataFrame:
    """One row a grade: entities and mean scores."""
    return scores.groupBy("grade").agg(F.count("*").alias("entities"), *[F.round(F.avg(c), 4).alias(f"avg_{c}") for c in ("overall", "completeness", "validity", "uniqueness")])


def low_trust(scores: DataFrame, below: float = 0.70, k: int = 10) -> DataFrame:
    """The k least trusted entities below the bound."""
    return scores.where(F.col("overall") < below).orderBy("overall", "entity_id").limit(k).select("entity_id", "entity_type", "overall", "tier")


def missing_fields(entities: DataFrame, profile: str = "dev") -> DataFrame:
    """Required fields that an entity lacks, one row each."""
    names = {k: F.array(*[F.lit(f) for f in fs]) for k, fs in rules.REQUIRED[profile].items()}
    need = F.create_map(*[x for k, a in names.items() for x in (F.lit(k), a)])
    rows = entities.select("entity_id", "entity_type", "fields", F.explode(need[F.col("entity_type")]).alias("field"))
    return rows.where(~present(F.col("fields")[F.col("field")])).select("entity_id", "entity_type", "field")


def running_mean(log: DataFrame) -> DataFrame:
    """Mean of an entity's scores up to each one, in two levels: inside months, and over the months' sums, so an entity's scores are not one task's."""
    rows = log.where("entity_id IS NOT NULL AND computed_at IS NOT NULL").groupBy("entity_id", "computed_at").agg(F.max("overall").alias("overall"))
    rows = rows.withColumn("month", F.date_trunc("month", "computed_at"))
    inside = Window.partitionBy("entity_id", "month").orderBy("computed_at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("entity_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    months = rows.groupBy("entity_id", "month").agg(F.sum("overall").alias("s"), F.count("overall").alias("n"))
    months = months.select("entity_id", "month", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    rows = rows.withColumn("own", F.coalesce(F.sum("overall").over(inside), F.lit(0.0))).withColumn("k", F.count("overall").over(inside))
    return rows.join(months, ["entity_id", "month"]).select("entity_id", "computed_at", F.round(F.try_divide(F.col("s") + F.col("own"), F.col("n") + F.col("k")), 8).alias("mean_so_far"))
