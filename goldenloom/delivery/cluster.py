"""Desired against actual state: drift of applications and manifests, health of pods, use of resources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldenloom import rules


def _events(rows: DataFrame, key: list[str], *cases) -> DataFrame:
    """One row per case (condition, drift_type, severity, auto_reconcilable) that holds."""
    hits = [F.when(c, F.struct(F.lit(t).alias("drift_type"), F.lit(s).alias("severity"), F.lit(a).alias("auto_reconcilable"))) for c, t, s, a in cases]
    return rows.select(*key, F.explode(F.array_compact(F.array(*hits))).alias("h")).select(*key, "h.*")


def app_drift(apps: DataFrame) -> DataFrame:
    """Drift of applications (resource, sync, health): out of sync, degraded, missing."""
    s, h = F.col("sync"), F.col("health")
    return _events(apps, ["resource"], (s == "OutOfSync", "out_of_sync", "HIGH", True), (h == "Degraded", "degraded", "CRITICAL", False), (h == "Missing", "missing", "CRITICAL", False))


def reconcile_drift(kustomizations: DataFrame) -> DataFrame:
    """Drift of kustomizations (resource, conditions array<struct<type,status>>): the first Ready that is not True, the first Stalled that is."""
    first = lambda kind: F.get(F.filter("conditions", lambda c: c["type"] == kind), F.lit(0))["status"]
    return _events(kustomizations, ["resource"], (first("Ready") != "True", "out_of_sync", "HIGH", True), (first("Stalled") == "True", "degraded", "CRITICAL", False))


def path_severity(path: Column) -> Column:
    out = F.lit("LOW")
    for severity, parts in reversed(rules.DRIFT_PATHS.items()):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(path, F.lit(p)) for p in parts]), severity).otherwise(out)
    return out


def manifest_drift(desired: DataFrame, actual: DataFrame) -> DataFrame:
    """Differences of two manifests' leaves (resource, path, value) by a full outer join; a critical one is not reconciled by itself."""
    d, a = (t.select("resource", "path", F.col("value").alias(n), F.lit(True).alias(f"has_{n}")) for t, n in ((desired, "desired"), (actual, "actual")))
    rows = d.join(a, ["resource", "path"], "full_outer").where("has_desired IS NULL OR has_actual IS NULL OR NOT desired <=> actual")
    rows = rows.withColumn("severity", path_severity(F.col("path")))
    return rows.select("resource", "path", "desired", "actual", "severity", (F.col("severity") != "CRITICAL").alias("auto_reconcilable"))


def text_drift(pairs: DataFrame) -> DataFrame:
    """Images, pairwise as far as both have some, and replicas that differ between two manifest texts (resource, desired, actual)."""
    images = lambda c: F.regexp_extract_all(c, F.lit(r"image:\s*(\S+)"), F.lit(1))
    n = F.least(F.size(images("desired")), F.size(images("actual")))
    zipped = F.arrays_zip(F.slice(images("desired"), 1, n).alias("d"), F.slice(images("actual"), 1, n).alias("a"))
    image = pairs.select("resource", F.explode(zipped).alias("z")).select("resource", F.lit("image").alias("what"), F.col("z.d").alias("desired"), F.col("z.a").alias("actual"), F.lit("HIGH").alias("severity"), F.lit(False).alias("auto_reconcilable"))
    count = lambda c: F.regexp_extract(c, r"replicas:\s*(\d+)", 1)
    replicas = pairs.select("resource", F.lit("replicas").alias("what"), count("desired").alias("desired"), count("actual").alias("actual"), F.lit("MEDIUM").alias("severity"), F.lit(True).alias("auto_reconcilable"))
    return image.unionByName(replicas.where("desired <> '' AND actual <> ''")).where("desired <> actual")


def reconciliation(drift: DataFrame, by: str) -> DataFrame:
    """Numbered steps by group: critical events to review at once, then those that reconcile by themselves, then manual ones.

    A critical event has a step of review and one of its own kind. ``drift`` has resource, severity and auto_reconcilable.
    """
    auto = F.col("auto_reconcilable")
    steps = F.array_compact(F.array(
        F.when(F.col("severity") == "CRITICAL", F.struct(F.lit(1).alias("phase"), F.lit("IMMEDIATE_REVIEW").alias("action"))),
        F.when(auto, F.struct(F.lit(2).alias("phase"), F.lit("AUTO_RECONCILE").alias("action"))), F.when(~auto, F.struct(F.lit(3).alias("phase"), F.lit("MANUAL_FIX").alias("action"))),
    ))
    rest = [c for c in ("resource", "path") if c in drift.columns and c != by]
    rows = drift.select(by, *rest, F.explode(steps).alias("s")).select(by, *rest, "s.*")
    return rows.withColumn("step", F.row_number().over(Window.partitionBy(by).orderBy("phase", *rest))).drop("phase")


def pod_issues(pods: DataFrame) -> DataFrame:
    """pod, container, issue_type, severity of pods (pod, phase, reason, containers array<struct<name,restarts,waiting,terminated,ready>>).

    A pending or evicted pod has that one issue. Of a container, a crash loop, an image that cannot be pulled and many restarts exclude each
    other in this order; memory kills and containers that run but are not ready come besides.
    """
    stuck = F.col("phase") == "Pending"
    evicted = ~stuck & F.coalesce(F.col("reason") == "Evicted", F.lit(False))
    whole = pods.select("pod", F.lit("").alias("container"), F.when(stuck, "Pending").when(evicted, "Evicted").alias("issue_type"), F.when(stuck, "HIGH").otherwise("MEDIUM").alias("severity"))
    each = pods.where(~stuck & ~evicted).select("pod", "phase", F.explode("containers").alias("c")).select("pod", "phase", "c.*")
    issue = lambda t, s: F.struct(F.lit(t).alias("issue_type"), F.lit(s).alias("severity"))
    waiting = F.coalesce("waiting", F.lit(""))
    hits = F.array_compact(F.array(
        F.when(waiting == "CrashLoopBackOff", issue("CrashLoopBackOff", "CRITICAL")).when(waiting.isin("ImagePullBackOff", "ErrImagePull"), issue("ImagePullBackOff", "HIGH"))
        .when(F.col("restarts") > 5, issue("HighRestartCount", "HIGH")),
        F.when(F.col("terminated") == "OOMKilled", issue("OOMKilled", "CRITICAL")),
        F.when(~F.coalesce("ready", F.lit(True)) & (F.col("phase") == "Running"), issue("NotReady", "MEDIUM")),
    ))
    return whole.where("issue_type IS NOT NULL").unionByName(each.select("pod", F.col("name").alias("container"), F.explode(hits).alias("h")).select("pod", "container", "h.*"))


def resource_issues(metrics: DataFrame) -> DataFrame:
    """pod, issue_type, severity of pods near their limits (cpu, cpu_limit, memory, memory_limit); a limit of 0 is none."""
    share = lambda used, limit: F.when(F.col(limit) > 0, F.col(used) / F.col(limit) * 100)
    cpu, memory = share("cpu", "cpu_limit"), share("memory", "memory_limit")
    issue = lambda t, s: F.struct(F.lit(t).alias("issue_type"), F.lit(s).alias("severity"))
    hits = F.array_compact(F.array(F.when(cpu > 90, issue("CPUThrottled", "HIGH")).when(cpu > 75, issue("CPUPressure", "MEDIUM")), F.when(memory > 90, issue("MemoryPressure", "CRITICAL"))))
    return metrics.select("pod", F.explode(hits).alias("h")).select("pod", "h.*")


def health(issues: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """Status, issues and critical ones of every group: critical, a warning with any issue, else healthy."""
    n = issues.groupBy(by).agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
    rows = groups.select(by).distinct().join(n, by, "left").fillna(0, ["issues", "critical"])
    return rows.withColumn("status", F.when(F.col("critical") > 0, "critical").when(F.col("issues") > 0, "warning").otherwise("healthy"))
