"""Pipelines: webhook events, runs and their stages, suggestions for CI files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldenloom.delivery import risk

_COMMITS = "commits array<struct<added:array<string>,modified:array<string>,removed:array<string>>>"
# Payloads of webhooks, by source and event.
PAYLOADS = {
    "github_push": f"ref string, after string, repository struct<full_name:string>, pusher struct<name:string>, {_COMMITS}",
    "github_pr": "repository struct<full_name:string>, pull_request struct<head:struct<ref:string,sha:string>,user:struct<login:string>>",
    "gitlab_push": f"ref string, after string, project struct<path_with_namespace:string>, user_name string, {_COMMITS}",
}
# Production branches, parts of names of infrastructure files and of manifests.
PRODUCTION = ("main", "master", "production", "release")
INFRA_FILES = (".yaml", ".yml", ".tf", ".json", ".dockerfile", "Dockerfile")
DEPENDENCY_FILES = ("requirements.txt", "package.json", "package-lock.json", "Pipfile", "pyproject.toml", "go.mod", "pom.xml", "build.gradle")


def webhook_events(raw: DataFrame) -> DataFrame:
    """Events of webhooks (event_id, hook, body): type, source, repository, branch, commit_sha, author, sorted distinct files and what they touch.

    A body that is no JSON has unknown parts; a hook of another kind is a manual event.
    """
    p, q, g = (F.from_json(F.when(F.col("hook") == h, F.col("body")), s) for h, s in PAYLOADS.items())
    rows = raw.select("event_id", "hook", p.alias("p"), q.alias("q"), g.alias("g"))
    by = lambda push, pr, lab, other: F.when(F.col("hook") == "github_push", push).when(F.col("hook") == "github_pr", pr).when(F.col("hook") == "gitlab_push", lab).otherwise(other)
    text = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    branch = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("refs/heads/main")), "refs/heads/", "")
    sha = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, 8)

    def changed(c: str) -> Column:
        empty = F.array().cast("array<string>")
        each = F.transform(c, lambda k: F.concat(*[F.coalesce(k[f], empty) for f in ("added", "modified", "removed")]))
        return F.coalesce(F.array_sort(F.array_distinct(F.flatten(each))), empty)

    out = rows.select(
        "event_id", by(F.lit("push"), F.lit("pull_request"), F.lit("push"), F.lit("manual")).alias("event_type"), by(F.lit("github"), F.lit("github"), F.lit("gitlab"), F.lit("internal")).alias("source"),
        by(text("p.repository.full_name"), text("q.repository.full_name"), text("g.project.path_with_namespace"), F.lit("unknown")).alias("repository"),
        by(branch("p.ref"), text("q.pull_request.head.ref"), branch("g.ref"), F.lit("unknown")).alias("branch"), by(sha("p.after"), sha("q.pull_request.head.sha"), sha("g.after"), F.lit("manual")).alias("commit_sha"),
        by(text("p.pusher.name"), text("q.pull_request.user.login"), text("g.user_name"), F.lit("user")).alias("author"),
        by(changed("p.commits"), F.array().cast("array<string>"), changed("g.commits"), F.array().cast("array<string>")).alias("files"),
    )
    touches = lambda parts: F.exists("files", lambda f: F.exists(F.array(*[F.lit(x) for x in parts]), lambda x: F.contains(f, x)))
    return out.select("*", F.col("branch").isin(*PRODUCTION).alias("production"), touches(INFRA_FILES).alias("infra"), touches(DEPENDENCY_FILES).alias("dependencies"))


def signature(body: Column, secret: str) -> Column:
    """"sha256=" and the keyed digest (HMAC-SHA256) of a text in hex, from built-in digests."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ x for k in key)) for x in (0x36, 0x5C))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256))), 256))


def genuine(hooks: DataFrame, secret: str) -> DataFrame:
    """Webhooks (body, signature) whose signature is right; without a secret all are."""
    return hooks.where(F.coalesce(F.col("signature") == signature(F.col("body"), secret), F.lit(False))) if secret else hooks


def event_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", "source").agg(F.count("*").alias("events"), F.count_if("production").alias("production"))


#: Stages in their order; a failed secret scan ends a run.
STAGES = ("secret_scan", "vulnerability_scan", "dependency_scan", "config_audit", "optimization", "risk_scoring", "deploy_decision")


def run_summaries(findings: DataFrame, risks: DataFrame) -> DataFrame:
    """Stages run and passed, findings, critical or high ones, blocking, decision of every run.

    ``findings`` has run_id, stage, severity and blocking; ``risks`` run_id and score. A stage fails by a blocking finding. A run whose secret scan
    fails stops there: its decision is block and what later stages found does not count.
    """
    per = findings.groupBy("run_id", "stage").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("severe"), F.count_if("blocking").alias("blocking")
    )
    secret = F.col("stage") == STAGES[0]
    total = per.groupBy("run_id").agg(
        F.max(secret & (F.col("blocking") > 0)).alias("stopped"),
        *[F.sum(c).alias(c) for c in ("n", "severe", "blocking")], *[F.sum(F.when(secret, F.col(c))).alias(f"first_{c}") for c in ("n", "severe", "blocking")],
        F.count_if(F.col("blocking") > 0).alias("failed"),
    )
    rows = risks.select("run_id", "score").join(total, "run_id", "left")
    stopped = F.coalesce("stopped", F.lit(False))
    pick = lambda c: F.coalesce(F.when(stopped, F.col(f"first_{c}")).otherwise(F.col(c)), F.lit(0))
    return rows.select(
        "run_id", F.when(stopped, 1).otherwise(len(STAGES)).alias("stages"), F.when(stopped, 0).otherwise(len(STAGES) - F.coalesce("failed", F.lit(0))).alias("passed"),
        pick("n").alias("findings"), pick("severe").alias("severe"), (pick("blocking") > 0).alias("has_blocking"), F.when(stopped, "block").otherwise(risk.decision(F.col("score"))).alias("decision"),
    )


def run_stats(summaries: DataFrame, risks: DataFrame) -> DataFrame:
    return summaries.join(risks.select("run_id", "score"), "run_id").groupBy("decision").agg(F.count("*").alias("runs"), F.sum("findings").alias("findings"), F.round(F.avg("score"), 2).alias("avg_risk"))


def ci_suggestions(files: DataFrame, history: DataFrame) -> DataFrame:
    """path, rule_id, priority, savings (seconds a run) of CI files (path, content) with the history (path, seconds, failed, retries) of their runs."""
    has = lambda t: F.contains(F.col("content"), F.lit(t))
    count = lambda *ts: sum((F.regexp_count("content", F.lit(t)) for t in ts), F.lit(0))
    slow, flaky = F.col("seconds") > 600, F.col("failed") & (F.col("retries") > 0)
    past = history.groupBy("path").agg(F.count_if(slow).alias("slow"), F.avg(F.when(slow, F.col("seconds"))).alias("mean"), F.count_if(flaky).alias("flaky"))
    rows = files.where("content IS NOT NULL").join(past, "path", "left").fillna(0, ["slow", "flaky"])
    checkouts, installs = count("actions/checkout"), count("pip install", "npm install")
    found = (
        ("O001", has("pip install") & ~has("cache"), "HIGH", F.lit(120)), ("O002", has("npm install") & ~has("cache"), "HIGH", F.lit(180)),
        ("O003", has("docker build") & ~has("--cache-from"), "HIGH", F.lit(240)), ("O004", (has("mvn") | has("gradle")) & ~has("cache"), "HIGH", F.lit(300)),
        ("O010", (count("pytest", "jest", "rspec") > 0) & ~has("matrix:"), "MEDIUM", F.lit(180)),
        ("O011", (F.regexp_count("content", F.lit(r"(?m)^\s{2}[a-zA-Z_\-]+:\s*$")) > 2) & ~F.col("content").rlike(r"needs:\s*\[[^\]]+\]"), "MEDIUM", F.lit(120)),
        ("O020", ~has("timeout-minutes:"), "MEDIUM", F.lit(0)), ("O030", checkouts > 1, "LOW", checkouts * 10), ("O031", installs > 1, "MEDIUM", (installs - 1) * 60),
        ("O040", has("COPY . .") | has("COPY . /app"), "HIGH", F.lit(90)), ("O050", F.col("slow") > 2, "HIGH", F.floor(F.col("mean") * 0.4).cast("int")),
        ("O060", F.col("flaky") > 2, "HIGH", (F.col("flaky") * 45).cast("int")),
    )
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("rule_id"), F.lit(p).alias("priority"), s.cast("int").alias("savings"))) for i, c, p, s in found]))
    return rows.select("path", F.explode(hits).alias("h")).select("path", "h.*")


def monthly_savings(suggestions: DataFrame, runs_per_day: int = 20) -> DataFrame:
    """Seconds a run, minutes and dollars a month by file."""
    per = suggestions.groupBy("path").agg(F.sum("savings").alias("seconds_a_run"))
    minutes = F.col("seconds_a_run") * (runs_per_day * 30) / 60
    return per.select("path", "seconds_a_run", F.round(minutes, 0).alias("minutes_a_month"), F.round(minutes * 0.008, 2).alias("dollars_a_month"))
