"""Deployment risk of runs from five weighted dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldenloom import rules

# Weight of a finding by severity.
SEVERITY = {"CRITICAL": 100.0, "HIGH": 75.0, "MEDIUM": 40.0, "LOW": 15.0, "INFO": 5.0}


def finding_risk(findings: DataFrame, by: str) -> DataFrame:
    """findings, critical and finding_risk: mean severity weight plus 3 per finding, 30 at most; 100 at most."""
    weights = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    w = F.coalesce(weights[F.col("severity")], F.lit(15.0))
    risk = F.least(F.lit(100.0), F.avg(w) + F.least(F.lit(30.0), 3.0 * F.count("*")))
    return findings.groupBy(by).agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.round(risk, 4).alias("finding_risk"))


def branch_risk(branch: Column) -> Column:
    b = F.lower(branch)
    return F.when(b.isin(*rules.PROD_BRANCHES) | b.startswith("release/"), 80.0).otherwise(20.0)


def change_risk(files: Column) -> Column:
    """10 and more for risky paths, infrastructure and manifests among the changed files, and for their number."""
    def some(test) -> Column:
        return F.exists(files, test)

    risky = some(lambda f: F.lower(f).rlike("|".join(rules.RISKY_PATHS)))
    infra = some(lambda f: f.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in rules.INFRA_ENDINGS) + ")$"))
    deps = some(lambda f: f.rlike("|".join(m.replace(".", r"\.") for m in rules.MANIFESTS)))
    n = F.size(files)
    risk = 10.0 + F.when(risky, 40.0).otherwise(0.0) + F.when(infra, 25.0).otherwise(0.0) + F.when(deps, 20.0).otherwise(0.0) + F.least(F.lit(20.0), n * 0.5)
    return F.when(files.isNull() | (n == 0), 10.0).otherwise(F.least(F.lit(100.0), risk))


def blast(services: Column, users: Column) -> Column:
    return F.least(F.lit(50.0), services * 10.0) + F.least(F.lit(50.0), F.log10(F.greatest(F.lit(1), users)) * 15.0)


def history_risk(runs: DataFrame, by: str, order: list[str], last: int = 10) -> DataFrame:
    """runs and history_risk of the last ten (by ``order``): 80 times the share of failures, 10 per incident, 15 per rollback; 100 at most."""
    newest = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    kept = runs.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= last)
    share = F.avg(F.col("failed").cast("double")) * 80.0 + F.count_if("incident") * 10.0 + F.count_if("rollback") * 15.0
    return kept.groupBy(by).agg(F.count("*").alias("runs"), F.round(F.least(F.lit(100.0), share), 4).alias("history_risk"))


def level(score: Column) -> Column:
    return F.when(score <= 25, "LOW").when(score <= 50, "MEDIUM").when(score <= 70, "HIGH").when(score <= 85, "VERY_HIGH").otherwise("CRITICAL")


def canary_share(score: Column) -> Column:
    """Per cent of a canary deployment, null where there is none."""
    return F.when((score > 60) & (score <= 70), 10).when((score > 50) & (score <= 60), 25)


def decision(score: Column) -> Column:
    return F.when(score <= 30, "approve").when(score <= 65, "canary").when(score <= 85, "hold").otherwise("block")


def run_risks(runs: DataFrame, findings: DataFrame, history: DataFrame, by: str) -> DataFrame:
    """Five dimensions, score, level, decision, canary share and number of recommendations of runs.

    ``runs`` has ``by``, branch, files, services and users; ``findings`` a severity and ``history`` the outcomes of earlier runs, both by ``by``.
    A run without findings has finding risk 0, one without history 20.
    """
    f = finding_risk(findings, by)
    rows = runs.join(f, by, "left").join(history, by, "left").select(
        by, branch_risk(F.col("branch")).alias("branch_risk"), F.coalesce("finding_risk", F.lit(0.0)).alias("finding_risk"), change_risk(F.col("files")).alias("change_risk"),
        F.coalesce("history_risk", F.lit(20.0)).alias("history_risk"), F.round(blast(F.col("services"), F.col("users")), 4).alias("blast_radius"),
        F.coalesce("critical", F.lit(0)).alias("critical"),
    )
    c = F.col
    total = 0.20 * c("branch_risk") + 0.30 * c("finding_risk") + 0.20 * c("change_risk") + 0.15 * c("history_risk") + 0.15 * c("blast_radius")
    rows = rows.withColumn("score", F.round(F.least(F.lit(100.0), total), 8))
    advice = F.array(
        F.when((c("finding_risk") > 50) & (c("critical") > 0), "resolve critical findings"), F.when(c("history_risk") > 40, "verify in staging"),
        F.when(c("change_risk") > 50, "have a rollback plan"), F.when(c("score") > 65, "watch closely"), F.when(c("score") > 50, "deploy step by step"),
    )
    kept = F.array_compact(advice)
    return rows.withColumn("level", level(c("score"))).withColumn("decision", decision(c("score"))).withColumn("canary", canary_share(c("score"))).withColumn(
        "advice", F.when(F.size(kept) == 0, "standard checklist").otherwise(F.array_join(kept, "; "))
    )
