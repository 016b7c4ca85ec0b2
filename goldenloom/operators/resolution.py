"""Resolution by fields: strategies of the service profile, scores of pairs, the resolve pipeline, and queues of review."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldenloom import rules
from goldenloom.functions.strings import Strings, coded, rounded
from goldenloom.functions.text import indel_ratio_of, jaro_winkler_of, partial_token_sort_ratio_of, present, token_sort_ratio_of, words
from goldenloom.operators import cells
from goldenloom.operators.similarity import BATCH, clean, filled, profiles

FIELDS = tuple(rules.FUZZY_WEIGHTS_SERVICE)
#: Weight of a field that the table does not list.
OTHER = 0.05
AUTO, REVIEW, ASK = 0.95, 0.75, 0.60


def soundex_match(a: str, b: str) -> float:
    """1 for equal codes, .5 for equal first letters."""
    digits = {c: d for d, letters in zip("123456", ("bfpv", "cgjkqsxz", "dt", "l", "mn", "r")) for c in letters}

    def code(w: str) -> str:
        w = "".join(c for c in w.lower() if c.isalpha())
        if not w:
            return ""
        out, last = w[0].upper(), digits.get(w[0], "")
        for c in w[1:]:
            d = digits.get(c, "")
            if d and d != last:
                out += d
            if c not in "hw":
                last = d
        return (out + "000")[:4]

    x, y = code(a), code(b)
    return 0.0 if not x or not y else 1.0 if x == y else 0.5 if x[0] == y[0] else 0.0


def match_field(a: str | None, b: str | None, strategy: str) -> float | None:
    """Score of two values; None if both are missing, 0 if one is."""
    if not a and not b:
        return None
    if not a or not b:
        return 0.0
    if strategy == "phone_normalized":
        x, y = ("".join(c for c in v if c.isdecimal()) for v in (a, b))
        return float(bool(x and y) and x[-10:] == y[-10:])
    if strategy == "phonetic":
        return soundex_match(a, b)
    of = {"exact_normalized": lambda x, y: float(x == y), "jaro_winkler": jaro_winkler_of, "token_sort": token_sort_ratio_of, "token_partial": partial_token_sort_ratio_of}
    return of.get(strategy, indel_ratio_of)(clean(a), clean(b))


def field_scores(a: Column, b: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """Scores of the fields of two maps, in the order of ``fields``; equal pairs of values are compared once a batch."""
    values = [F.array(*[m[f] for f in fields]) for m in (a, b)]
    how = [rules.STRATEGIES.get(f, "jaro_winkler") for f in fields]

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        seen: dict = {}

        def one(v, w, s):
            key = (v, w, s)
            if key not in seen:
                seen[key] = match_field(v, w, s)
            return seen[key]

        return pd.Series([[one(v, w, s) for v, w, s in zip(p, q, how)] for p, q in zip(x, y)])

    return run(*values)


def overall(scores: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """Weighted mean of the scores that are there; 0 without any."""
    weights = [rules.FUZZY_WEIGHTS_SERVICE.get(f, OTHER) for f in fields]
    parts = [(F.get(scores, F.lit(i)), w) for i, w in enumerate(weights)]
    top = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in parts), F.lit(0.0))
    bottom = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts), F.lit(0.0))
    return F.round(F.when(bottom > 0, top / bottom).otherwise(0.0), 4)


def breakdown(scores: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """Array of (field, score, method) of the fields that either has."""
    parts = [F.struct(F.lit(f).alias("field"), F.get(scores, F.lit(i)).alias("score"), F.lit(rules.STRATEGIES.get(f, "jaro_winkler")).alias("method")) for i, f in enumerate(fields)]
    return F.filter(F.array(*parts), lambda p: p["score"].isNotNull())


def matching_fields(scores: Column, least: float = 0.85) -> Column:
    return F.transform(F.filter(breakdown(scores), lambda p: p["score"] >= least), lambda p: p["field"])


def service_terms(fields: Column) -> Column:
    """Terms of the first twelve values of an entity: descriptive fields in their order, then the others by key."""
    first = F.filter(F.array(*[fields[k] for k in rules.TEXT_FIRST]), lambda v: present(v))
    others = F.transform(F.filter(filled(fields), lambda e: ~e["key"].isin(*rules.TEXT_FIRST)), lambda e: e["value"])
    return words(F.array_join(F.slice(F.concat(first, others), 1, 12), " "))


def cosine_of(x: Column, y: Column) -> Column:
    """Cosine of the counts of two term arrays; 0 if one is empty."""
    def dot(p, q):
        return F.aggregate(p, F.lit(0.0), lambda s, t: s + F.size(F.filter(q, lambda u: u == t)))

    return F.coalesce(F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y))), F.lit(0.0))


def prior_decision(prior: Column) -> Column:
    """What is decided where no language model answers: by the prior score alone."""
    return F.when(prior >= 0.85, "merge").when(prior >= 0.60, "review").otherwise("reject")


def recommendation(final: Column) -> Column:
    return F.when(final >= AUTO, "auto_merge").when(final >= REVIEW, "review").otherwise("reject")


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Scores of pairs (id_a, id_b, a, b: maps of fields): fuzzy, semantic, combined, final, decision, recommendation, matching fields.

    In the band from ASK to AUTO a language model would be asked; without one its confidence is the prior, so the final score is the combined one.
    """
    rows = pairs.select("id_a", "id_b", field_scores(F.col("a"), F.col("b")).alias("scores"), F.round(cosine_of(service_terms(F.col("a")), service_terms(F.col("b"))), 4).alias("semantic"))
    return judged(rows)


def judged(rows: DataFrame) -> DataFrame:
    """What follows from the scores of the fields and the semantic score of pairs (id_a, id_b, scores, semantic)."""
    rows = rows.withColumn("fuzzy", overall(F.col("scores"))).withColumn("combined", F.round(0.5 * F.col("fuzzy") + 0.5 * F.col("semantic"), 6))
    asked = (F.col("combined") >= ASK) & (F.col("combined") < AUTO)
    rows = rows.withColumn("decision", F.when(asked, prior_decision(F.col("combined")))).withColumn("final", F.col("combined"))
    return rows.select("id_a", "id_b", "scores", "fuzzy", "semantic", "combined", "final", "decision", recommendation(F.col("final")).alias("recommendation"), matching_fields(F.col("scores")).alias("fields"))


class FieldPairs:
    """Scores of the fields of a cell's rows; its ``values`` are in the order of FIELDS."""

    def __init__(self, values: pa.ListArray):
        flat = values.flatten()
        self.fields = []
        for i, f in enumerate(FIELDS):
            how, column = rules.STRATEGIES.get(f, "jaro_winkler"), flat.take(pa.array(np.arange(i, len(flat), len(FIELDS))))
            form = {"exact_normalized": clean, "jaro_winkler": clean, "phone_normalized": lambda v: "".join(c for c in v if c.isdecimal())[-10:] or None}.get(how, str)
            number, texts = coded(column, form)
            self.fields.append((i, how, rules.FUZZY_WEIGHTS_SERVICE[f], number, Strings(texts) if how == "jaro_winkler" else texts))
        self.fields.sort(key=lambda x: ("exact_normalized", "phone_normalized", "jaro_winkler").index(x[1]) if x[1] in ("exact_normalized", "phone_normalized", "jaro_winkler") else 3)
        self.seen: dict = {}

    def one(self, how: str, a: str, b: str) -> float:
        key = how, a, b
        if key not in self.seen:
            self.seen[key] = match_field(a, b, how)
        return self.seen[key]

    def scores(self, p: np.ndarray, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs can have a weighted mean of ``least``, and their scores (pairs x FIELDS, NaN where both lack a value).

        After each field, the dearest last, pairs are left out that would not reach it with 1 in all fields to come.
        """
        at, out = np.arange(len(p)), np.full((len(p), len(FIELDS)), np.nan)
        whole, open_, top = np.zeros(len(p)), np.zeros(len(p)), np.zeros(len(p))
        for i, _, weight, number, _ in self.fields:
            x, y = number[p] != -1, number[q] != -1
            out[x ^ y, i] = 0.0
            whole += weight * (x | y)
            open_ += weight * (x & y)
        for i, how, weight, number, texts in self.fields:
            at = at[top[at] + open_[at] >= (least[at] - 1e-9) * whole[at]]
            k = at[(number[p[at]] != -1) & (number[q[at]] != -1)]
            a, b = number[p[k]], number[q[k]]
            if how == "jaro_winkler":
                score = texts.jaro_winkler(a, b)
            elif how in ("exact_normalized", "phone_normalized"):
                score = ((a == b) & (a >= 0)).astype(np.float64)
            else:
                score = np.array([self.one(how, texts[x], texts[y]) for x, y in zip(a, b)], np.float64)
            out[k, i] = score
            top[k] += weight * score
            open_[k] -= weight
        at = at[top[at] >= (least[at] - 1e-9) * whole[at]]
        return at, out[at]


def near_pairs(p: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b, scores, semantic) of the pairs of profiles that can reach ``threshold``, scored where they are found.

    Fuzzy scores reach 1 at most, so texts below the cosine 2 t - 1 can't reach t; with the cosine known the fields must have what lacks to 2 t.
    """

    def judge(table: pa.Table, v: cells.Vectors, found: Iterator) -> Iterator[pa.RecordBatch]:
        fields, ids = FieldPairs(table["values"].combine_chunks()), table["id"].combine_chunks()
        for p, q, dot in found:
            semantic = rounded(dot / np.sqrt(v.square[p] * v.square[q]), 4)
            # Fuzzy scores are rounded to four places.
            at, scores = fields.scores(p, q, 2 * threshold - semantic - 1e-4)
            for k in range(0, len(at), BATCH):
                own, rows = at[k : k + BATCH], scores[k : k + BATCH]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, len(FIELDS)), pa.int32()), pa.array(rows.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(p[own])), ids.take(pa.array(q[own])), lists, pa.array(semantic[own])], ["id_a", "id_b", "scores", "semantic"])

    rows = p.select("entity_type", "id", service_terms(F.col("fields")).alias("terms"), F.array(*[F.col("fields")[f] for f in FIELDS]).alias("values"))
    return cells.pairs(rows, max(2 * threshold - 1.0001, 0.0), judge, "id_a string, id_b string, scores array<double>, semantic double")


def resolve(entities: DataFrame, threshold: float = REVIEW) -> DataFrame:
    """entity_id, candidate, fuzzy, semantic, confidence, method, rank: the candidates of every profile, best first; no number of candidates is cut off."""
    scored = judged(near_pairs(profiles(entities), threshold)).where(F.col("final") >= threshold)
    method = F.when(F.col("decision").isNull(), "fuzzy+semantic").otherwise("fuzzy+semantic+llm")
    ends = F.array(F.struct(F.col("id_a").alias("entity_id"), F.col("id_b").alias("candidate")), F.struct(F.col("id_b").alias("entity_id"), F.col("id_a").alias("candidate")))
    both = scored.select(F.explode(ends).alias("e"), "fuzzy", "semantic", F.col("final").alias("confidence"), method.alias("method"), F.array_join("fields", ",").alias("fields"))
    both = both.select("e.*", "fuzzy", "semantic", "confidence", "method", "fields")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("confidence"), "candidate")))


def golden_ids(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """entity_id, golden_record_id, is_new, confidence of every profile: the best candidate where it is sure, else itself.

    Candidates below AUTO decide nothing here, so ``resolved`` may leave them out.
    """
    best = resolved.where((F.col("rank") == 1) & (F.col("confidence") >= AUTO)).select("entity_id", "candidate", "confidence")
    rows = profiles(entities).select(F.col("id").alias("entity_id")).join(best, "entity_id", "left")
    return rows.select("entity_id", F.coalesce("candidate", "entity_id").alias("golden_record_id"), F.col("candidate").isNull().alias("is_new"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def cache_key(a: Column, b: Column) -> Column:
    """Sixteen hex digits that name a pair of field maps, whatever the order of their keys."""
    return F.substring(F.sha2(F.to_json(F.struct(F.array_sort(F.map_entries(a)).alias("a"), F.array_sort(F.map_entries(b)).alias("b"))), 256), 1, 16)


def queue(scored: DataFrame) -> DataFrame:
    """The pairs (id_a, id_b, combined) that wait for review, with a stable id and the status pending."""
    waiting = scored.where((F.col("combined") >= 0.82) & (F.col("combined") < AUTO))
    return waiting.select(F.substring(F.sha2(F.concat_ws("|", "id_a", "id_b"), 256), 1, 16).alias("queue_id"), "id_a", "id_b", "combined", F.lit("pending").alias("status"))


def listing(items: DataFrame, status: str | None = None) -> DataFrame:
    """Items of a status, best first, beside how many of them are pending."""
    kept = items.where(F.col("status") == status) if status else items
    pending = kept.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.lit(1).alias("one"))
    return kept.withColumn("one", F.lit(1)).join(pending, "one").drop("one").orderBy(F.desc("combined"), "id_a", "id_b")


def remediation(clusters: DataFrame, auto: float = AUTO, review: float = 0.80) -> DataFrame:
    """Clusters (cluster, members, max_score) by band with the action that it asks for."""
    sure, likely = F.col("max_score") >= auto, F.col("max_score") >= review
    band = F.when(sure, "high_confidence").when(likely, "medium_confidence").otherwise("low_confidence")
    action = F.when(sure, "auto_merge").when(likely, "queue_for_review").otherwise("flag")
    return clusters.select("cluster", "members", "max_score", band.alias("band"), action.alias("action"))


def decided(items: DataFrame, decisions: DataFrame, known: DataFrame) -> DataFrame:
    """The queue after decisions (queue_id, approve, reason): pending items are approved, failed if one entity is unknown, or rejected with a reason."""
    ids = known.select("entity_id").distinct()
    a, b = (ids.select(F.col("entity_id").alias(f"id_{x}"), F.lit(True).alias(f"has_{x}")) for x in "ab")
    rows = items.join(decisions, "queue_id", "left").join(a, "id_a", "left").join(b, "id_b", "left")
    both = F.col("has_a").isNotNull() & F.col("has_b").isNotNull()
    done = F.when(F.col("approve"), F.when(both, "approved").otherwise("failed")).otherwise("rejected")
    status = F.when((F.col("status") == "pending") & F.col("approve").isNotNull(), done).otherwise(F.col("status"))
    out = rows.select("queue_id", "id_a", "id_b", "combined", status.alias("status"), "reason")
    return out.withColumn("reason", F.when(F.col("status") == "rejected", F.coalesce("reason", F.lit("Manual rejection"))))


def auto_merges(scored: DataFrame, at_least: float = AUTO) -> DataFrame:
    """Pairs to merge at once: those at or above the score that are the best (then smallest) of both their ends, so that none is merged twice."""
    sure = scored.where(F.col("combined") >= at_least).select("id_a", "id_b", "combined")
    ends = sure.select(F.col("id_a").alias("id"), "*").unionByName(sure.select(F.col("id_b").alias("id"), "*"))
    best = ends.groupBy("id").agg(F.min(F.struct((-F.col("combined")).alias("s"), "id_a", "id_b")).alias("m"))
    return best.groupBy("m.id_a", "m.id_b", F.col("m.s").alias("s")).agg(F.count("*").alias("n")).where("n = 2").select("id_a", "id_b", (-F.col("s")).alias("combined"))
