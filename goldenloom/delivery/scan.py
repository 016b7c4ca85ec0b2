"""Scans of code and configuration files (path, content): rules of lines and files, secrets, fixes, advisories, build failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldenloom import rules
from goldenloom.functions.text import version_parts

# Secret type and pattern, from the public formats of tokens.
SECRET_RULES = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), ("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b"), ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), ("hex_digest", r"\b[0-9a-f]{40,64}\b"),
)
#: A digest may be a key or not; the others are keys by their form.
SECRET_SEVERITY = {"hex_digest": "HIGH"}
# Kind of failure, pattern, text of the cause around the pattern's first group, and its greatest length, in order.
FAILURES = (
    ("missing_dependency", r"ModuleNotFoundError: No module named '([^']+)'", "Install missing package: pip install ", "", 100_000),
    ("syntax_error", r"SyntaxError: ([^\n]+)", "Fix syntax error: ", "", 100_000),
    ("import_error", r"ImportError: cannot import name '([^']+)' from '[^']+'", "Symbol not found: ", "", 100_000),
    ("test_failure", r"AssertionError: ([^\n]*)", "Test assertion failed: ", "", 100),
    ("type_error", r"TypeError: ([^\n]+)", "Type mismatch: ", "", 100),
    ("permission_error", r"PermissionError: ([^\n]+)", "Permission denied: ", ". Check file/directory permissions.", 80),
)
NO_CAUSE = "Unable to automatically diagnose failure -- manual review required"
_BREAK = r"\r\n|\r|\n"


def lines(files: DataFrame) -> DataFrame:
    """The lines of ``content`` as ``line`` (from 1) and ``text``, beside all other columns."""
    rest = [c for c in files.columns if c != "content"]
    return files.where("content IS NOT NULL").select(*rest, F.posexplode(F.split("content", _BREAK)).alias("_at", "text")).withColumn("line", F.col("_at") + 1).drop("_at")


def any_of(patterns) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def code_findings(files: DataFrame) -> DataFrame:
    """path, line, rule_id, cwe, severity, blocking, fixable, text: one row per code rule and line; comments and other languages are left out.

    The rules are one row of literals, so a line is looked at once and nothing is shuffled.
    """
    rows = lines(files.select("path", "content", "language")).where(~F.ltrim("text").rlike(r"^(#|//)"))
    hits = [
        F.when(F.col("language").isin(*langs) & F.col("text").rlike(any_of(patterns)),
               F.struct(F.lit(i).alias("rule_id"), F.lit(cwe).alias("cwe"), F.lit(sev).alias("severity"), F.lit(block).alias("blocking"), F.lit(fix).alias("fixable")))
        for i, cwe, _, sev, block, fix, langs, patterns in rules.CODE_RULES
    ]
    return rows.select("path", "line", "text", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("path", "line", "h.*", "text")


def config_kind(content: Column) -> Column:
    has = lambda *parts: F.expr(" AND ".join(f"contains(content, '{p}')" for p in parts))
    return (
        F.when(content.rlike(r"(?m)^FROM\s+\S+"), "dockerfile").when(has("jobs:", "steps:"), "github_actions").when(has("stages:", "script:"), "gitlab_ci")
        .when(F.contains(content, F.lit("replicaCount:")) | F.contains(content, F.lit("image:\n")), "helm_values").otherwise("unknown")
    )


def config_findings(files: DataFrame) -> DataFrame:
    """path, kind, line, rule_id, severity, blocking: one row per configuration rule and line, line 0 for what a whole file lacks.

    The kind is told by the content; a file of no known kind is looked at as each of the three.
    """
    every = ("dockerfile", "ci_yaml", "helm")
    kind = config_kind(F.col("content"))
    kinds = (
        F.when(kind == "dockerfile", F.array(F.lit("dockerfile"))).when(kind.isin("github_actions", "gitlab_ci"), F.array(F.lit("ci_yaml")))
        .when(kind == "helm_values", F.array(F.lit("helm"))).otherwise(F.array(*[F.lit(k) for k in every]))
    )
    rows = files.where("content IS NOT NULL").select("path", "content", F.explode(kinds).alias("kind"))

    def hits(text: str, whole: bool) -> Column:
        out = []
        for i, of, _, severity, blocking, pattern in rules.CONFIG_RULES:
            if pattern.startswith("!") == whole:
                hit = ~F.col(text).rlike(pattern[1:]) if whole else F.col(text).rlike("(?im)" + pattern)
                out.append(F.when((F.col("kind") == of) & hit, F.struct(F.lit(i).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(blocking).alias("blocking"))))
        return F.explode(F.array_compact(F.array(*out))).alias("h")

    of_file = rows.select("path", "kind", F.lit(0).alias("line"), hits("content", True))
    of_line = lines(rows).select("path", "kind", "line", hits("text", False))
    return of_file.unionByName(of_line).select("path", "kind", "line", "h.*")


def fixed_dockerfiles(files: DataFrame) -> DataFrame:
    """path and content of Dockerfiles with a user before the first command where none is named, and stable for latest tags."""
    rows = files.where("content IS NOT NULL").select("path", F.split("content", _BREAK).alias("l"), F.col("content").rlike(r"(?im)^USER\s+").alias("user"))
    first = F.array_position(F.transform("l", lambda x: x.rlike(r"(?i)^(CMD|ENTRYPOINT)")), F.lit(True))
    stable = lambda x: F.when(x.rlike(r"(?i)^FROM\s+\S+:latest"), F.replace(x, F.lit(":latest"), F.lit(":stable"))).otherwise(x)
    fixed = F.transform("l", lambda x, i: F.when(~F.col("user") & (i + 1 == first), F.concat(F.lit("USER nonroot\n"), stable(x))).otherwise(stable(x)))
    return rows.select("path", F.array_join(fixed, "\n").alias("content"))


def line_fixes(findings: DataFrame) -> DataFrame:
    """path, line, rule_id, fixed, confidence of findings whose rule has a fix that changes the line."""
    fixed, sure = F.lit(None), F.lit(None)
    for rule, pattern, put, case, confidence in rules.LINE_FIXES:
        hit = F.col("rule_id") == rule
        fixed = F.when(hit, F.regexp_replace("text", pattern if case else "(?i)" + pattern, put)).otherwise(fixed)
        sure = F.when(hit, confidence).otherwise(sure)
    rows = findings.select("path", "line", "rule_id", "text", fixed.alias("fixed"), sure.alias("confidence"))
    return rows.where("fixed IS NOT NULL AND fixed <> text").drop("text")


def secrets(files: DataFrame) -> DataFrame:
    """path, line, secret_type, severity, blocking; comments are left out."""
    rows = lines(files.select("path", "content")).where(~F.ltrim("text").rlike(r"^(#|//)"))
    hits = [
        F.when(F.col("text").rlike(p), F.struct(F.lit(n).alias("secret_type"), F.lit(SECRET_SEVERITY.get(n, "CRITICAL")).alias("severity"), F.lit(n not in SECRET_SEVERITY).alias("blocking")))
        for n, p in SECRET_RULES
    ]
    return rows.select("path", "line", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("path", "line", "h.*")


def finding_summary(findings: DataFrame, *by: str) -> DataFrame:
    """Findings, blocking and fixable ones by the given columns."""
    return findings.groupBy(*by).agg(F.count("*").alias("findings"), F.count_if("blocking").alias("blocking"), F.count_if("fixable").alias("fixable"))


def build_failures(logs: DataFrame) -> DataFrame:
    """path, error_type, cause, confidence of every log (path, content): the first pattern that it holds, or Unknown."""
    kind, cause = F.lit("Unknown"), F.lit(NO_CAUSE)
    for name, p, before, after, most in reversed(FAILURES):
        hit = F.col("content").rlike(p)
        text = F.concat(F.lit(before), F.substring(F.regexp_extract("content", p, 1), 1, most), F.lit(after))
        kind, cause = F.when(hit, F.lit(name)).otherwise(kind), F.when(hit, text).otherwise(cause)
    return logs.where("content IS NOT NULL").select("path", kind.alias("error_type"), cause.alias("cause")).withColumn(
        "confidence", F.when(F.col("error_type") == "Unknown", 0.0).otherwise(0.55)
    )


def advisories(dependencies: DataFrame) -> DataFrame:
    """dependencies (package, version) below the first fixed version of a known advisory; the advisory list is fixed and broadcast."""
    spark = dependencies.sparkSession
    known = F.broadcast(spark.createDataFrame(list(rules.ADVISORIES), "package string, fixed string, advisory string, score double, severity string"))
    deps = dependencies.withColumn("package", F.regexp_replace(F.lower("package"), "_", "-"))
    hit = deps.join(known, "package").where(version_parts(F.col("version")) < version_parts(F.col("fixed")))
    return hit.select("package", "version", "advisory", "score", "severity")
