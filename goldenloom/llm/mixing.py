"""Mixing sources to target weights: capped water-filling and seeded repetitions.

The mixture is as large as the listed sources together (or ``budget`` tokens).
Each source is given its target share; a source that could only reach it with
more than ``max_repeats`` uses of every document is clamped at that many, and
what it cannot take is shared out over the others in proportion to their
weights, until no further source is clamped. A source then uses all its
documents a whole number of times and a seeded part of them once more.

That part is cut by a hash of the document: token sums of 65,536 hash slots per
source give the slot in which the part ends, so no source is sorted in one
task. Inside that one slot of each source documents are taken by their own hash
as long as they bring the sum nearer to the wanted tokens. The choice is the same
however the table is partitioned.

The report has one row per listed source, at most as many as the weights table
has; only these per-source sums meet on the driver.

Defined results: documents of a null or unlisted source take no part; a null
or empty text has no tokens; a listed source without tokens is reported with
share 0 and 0 repeats; null or negative weights and repeats count 0; of a
source listed twice the weights are added and the greater cap holds; weights
are scaled to 1; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldenloom.llm.encoding import encode_texts
from goldenloom.session import Scratch, table

SLOTS = 65_536
SEED = 20_240_601


def water_fill(weights: dict[str, float], capacity: dict[str, float], budget: float) -> dict[str, float]:
    """Tokens of each source: proportional to weight, none above its capacity, excess passed on."""
    given = {s: 0.0 for s in weights}
    free = {s for s, w in weights.items() if w > 0}
    left = budget
    while free and left > 0:
        total = sum(weights[s] for s in free)
        level = {s: left * weights[s] / total for s in free}
        over = {s for s in free if level[s] >= capacity.get(s, 0.0)}
        if not over:
            given.update(level)
            break
        for s in over:
            given[s] = capacity.get(s, 0.0)
            left -= given[s]
        free -= over
    return given


def plan(targets: list[tuple], tokens: dict[str, int], budget: float | None = None) -> dict[str, dict]:
    """Per listed source: target share, cap, tokens held, tokens given, whole repeats and the fraction beyond them."""
    listed: dict[str, list] = {}
    for source, share, cap in targets:
        if source is not None:
            row = listed.setdefault(source, [0.0, 0])
            row[0] += max(share or 0.0, 0.0)
            row[1] = max(row[1], cap or 0)
    total = sum(w for w, _ in listed.values()) or 1.0
    weights = {s: w / total for s, (w, _) in listed.items()}
    held = {s: tokens.get(s, 0) for s in listed}
    given = water_fill(weights, {s: float(held[s] * cap) for s, (_, cap) in listed.items()},
                       float(sum(held.values())) if budget is None else budget)
    out = {}
    for s, (_, cap) in listed.items():
        uses = given[s] / held[s] if held[s] else 0.0
        whole = min(int(uses + 1e-9), cap)
        out[s] = {"target": weights[s], "cap": cap, "held": held[s], "whole": whole,
                  "part": max(0.0, uses - whole) if whole < cap else 0.0}
    return out


def mixture(docs: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, source, tokens, copies; report: one row per listed source)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixture")
    rows = [tuple(r) for r in targets.groupBy("source").agg(F.sum("target_share"), F.max("max_repeats")).collect()]
    names = targets.select("source").where("source IS NOT NULL").distinct()
    counted = encode_texts(docs.where("source IS NOT NULL").join(names, "source", "left_semi"), ["doc_id", "source"], counts_only=True)
    counted = scratch.save(counted.withColumn("slot", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SLOTS))), "tokens")
    slots = counted.groupBy("source", "slot").agg(F.sum("tokens").alias("tokens"))
    sums = {r["source"]: r["n"] for r in slots.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    chosen = plan(rows, sums, budget)
    steps = spark.createDataFrame(
        [(s, p["target"], p["cap"], p["held"], p["whole"], p["part"]) for s, p in chosen.items()],
        "source string, target_share double, max_repeats int, tokens_held bigint, whole int, part double",
    )
    # Slots that lie below the wanted tokens as a whole; the one after the last of them is cut by documents.
    running = F.sum("tokens").over(W.partitionBy("source").orderBy("slot"))
    wanted = F.col("part") * F.col("tokens_held")
    ends = slots.withColumn("upto", running).join(F.broadcast(steps.select("source", "part", "tokens_held")), "source").where(wanted > 0)
    ends = ends.groupBy("source").agg(
        F.min(F.when(F.col("upto") > wanted, F.col("slot"))).alias("cut_slot"), F.coalesce(F.max(F.when(F.col("upto") <= wanted, F.col("upto"))), F.lit(0)).alias("whole_slots")
    )
    steps = F.broadcast(steps.join(ends, "source", "left"))
    rows = counted.join(steps.select("source", "whole", "part", "tokens_held", "cut_slot", "whole_slots"), "source")
    at = W.partitionBy("source").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    edge = rows.where(F.col("slot") == F.col("cut_slot")).withColumn("upto", F.sum("tokens").over(at) + F.col("whole_slots"))
    # A document is taken if more of it lies below the wanted tokens than above.
    edge = edge.withColumn("extra", (F.col("upto") - F.col("tokens") / 2 <= wanted).cast("int")).drop("upto")
    inside = F.when(wanted > 0, (F.col("cut_slot").isNull() | (F.col("slot") < F.col("cut_slot"))).cast("int")).otherwise(0)
    rest = rows.where(F.col("cut_slot").isNull() | (F.col("slot") != F.col("cut_slot"))).withColumn("extra", inside)
    used = rest.unionByName(edge).select("doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).alias("copies"))
    made = used.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.count("*").alias("documents")
    )
    share = F.coalesce("tokens_used", F.lit(0)) / F.sum("tokens_used").over(W.partitionBy())
    report = steps.join(made, "source", "left").select(
        "source", "target_share", F.coalesce(share, F.lit(0.0)).alias("actual_share"), "max_repeats",
        F.coalesce("documents", F.lit(0)).alias("documents"), "tokens_held",
        F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.col("whole").alias("whole_repeats"),
        F.when(F.col("tokens_held") > 0, F.coalesce("tokens_used", F.lit(0)) / F.col("tokens_held")).otherwise(0.0).alias("repeats"),
    )
    report = report.withColumn("reached", F.col("actual_share") >= F.col("target_share") - 0.001)
    return used.where("copies > 0"), report


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


QUERIES = {
    "p9_mix": lambda spark, d: _mixture(spark, d)[1],
    "p9_documents": lambda spark, d: _mixture(spark, d)[0],
}
ORACLES: dict[str, str] = {}
