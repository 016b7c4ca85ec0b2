"""Similarity of entities: term vectors of their texts, exact cosine joins, weighted field scores, clusters, search.

Entities of one type whose filled fields are all the same are one profile,
named by its smallest id; pairs are pairs of profiles, and ``membership`` says
which entities a profile stands for, so copies are never paired out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldenloom.functions.strings import Strings, coded, rounded
from goldenloom.functions.text import jaro_winkler, present, words
from goldenloom.operators import cells
from goldenloom.operators.components import components
from goldenloom.rules import FUZZY_WEIGHTS_DEV, TEXT_TWICE
from goldenloom.session import Scratch

#: Pairs of a batch.
BATCH = 1 << 16
FUZZY, SEMANTIC = 0.65, 0.35
SCORES = ("fuzzy", "cosine", "combined")


def least_cosine(threshold: float) -> float:
    """The cosine without which no pair reaches ``threshold``, whatever its fields; both scores are rounded to four places."""
    return max((threshold - 0.00005 - FUZZY) / SEMANTIC - 0.00005, 0.0)


def filled(fields: Column) -> Column:
    """Entries with a value, by key."""
    return F.array_sort(F.map_entries(F.map_filter(fields, lambda _, v: present(v))))


def text_terms(fields: Column) -> Column:
    """Terms of an entity's text: every value once, those of some descriptive fields twice."""
    own = filled(fields)
    twice = F.filter(own, lambda e: e["key"].isin(*TEXT_TWICE))
    return words(F.array_join(F.transform(F.concat(own, twice), lambda e: e["value"]), " "))


def _profile_key() -> Column:
    return F.sha2(F.to_json(F.struct(filled(F.col("fields")).alias("f"))), 256)


def profiles(entities: DataFrame) -> DataFrame:
    """entity_type, id, members, fields: one row for all entities of a type with the same filled fields."""
    rows = entities.select("entity_type", "entity_id", "fields", _profile_key().alias("key"))
    return rows.groupBy("entity_type", "key").agg(F.min("entity_id").alias("id"), F.count("*").alias("members"), F.min_by("fields", "entity_id").alias("fields"))


def membership(entities: DataFrame) -> DataFrame:
    """entity_id and the id of its profile."""
    rows = entities.select("entity_type", "entity_id", _profile_key().alias("key"))
    return rows.join(profiles(entities).select("entity_type", "key", "id"), ["entity_type", "key"]).select("entity_id", "id")


def term_counts(rows: DataFrame, key: list[str], terms: str) -> DataFrame:
    """Counts of the terms of an array column in long form, with the total per key."""
    counts = rows.select(*key, F.explode(terms).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    total = counts.groupBy(*key).agg(F.sum("tf").alias("total"))
    return counts.join(total, key)


def cosine_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(entity_type, id_a, id_b, cosine) of all pairs of (entity_type, id, terms) with cosine of term counts >= threshold; no pair is sent or written."""

    def judge(table: pa.Table, v: cells.Vectors, found: Iterator) -> Iterator[pa.RecordBatch]:
        for p, q, dot in found:
            cosine = rounded(dot / (v.norm[p] * v.norm[q]), 4)
            k = cosine >= threshold
            yield from pair_batches(table, p[k], q[k], cosine=cosine[k])

    return cells.pairs(rows.select("entity_type", "id", "terms"), threshold, judge, "entity_type string, id_a string, id_b string, cosine double")


def arranged(second: np.ndarray, p: np.ndarray, q: np.ndarray, score: np.ndarray) -> np.ndarray:
    """An order of pairs in which one id stays the same, first ``a`` and then ``b``, and equal scores follow each other, so files of pairs are small."""
    turned = second[p]
    row = np.where(turned, q, p)
    row += turned * (row.max(initial=-1) + 1) - row.min(initial=0)
    order = np.argsort(np.rint(score * 10_000).astype(np.uint16), kind="stable")
    row = row[order]
    # Whole numbers of 16 bits are sorted in one pass.
    return order[np.argsort(row.astype(np.uint16) if row.max(initial=0) < 1 << 16 else row, kind="stable")]


def pair_batches(table: pa.Table, p: np.ndarray, q: np.ndarray, **values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The ids of pairs of a cell's rows beside their values, in the order of ``arranged`` by the first value."""
    order = arranged(np.asarray(table["second"]), p, q, next(iter(values.values())))
    p, q, values = p[order], q[order], {k: x[order] for k, x in values.items()}
    kind, ids = (table[c].combine_chunks() for c in ("entity_type", "id"))
    for at in range(0, len(p), BATCH):
        i, j = pa.array(p[at : at + BATCH]), pa.array(q[at : at + BATCH])
        yield pa.RecordBatch.from_arrays([kind.take(i), ids.take(i), ids.take(j), *(pa.array(x[at : at + BATCH]) for x in values.values())], ["entity_type", "id_a", "id_b", *values])


def clean(v: str) -> str:
    """Compatibility form, lower case, white space collapsed."""
    return " ".join(unicodedata.normalize("NFKC", v).lower().split())


class WeightedFields:
    """Mean Jaro-Winkler, by weight, of the fields that both rows of a pair have; a cell's ``values`` are in the order of FUZZY_WEIGHTS_DEV."""

    def __init__(self, values: pa.ListArray):
        width = len(FUZZY_WEIGHTS_DEV)
        flat = values.flatten()
        self.fields = []
        for f, weight in enumerate(FUZZY_WEIGHTS_DEV.values()):
            number, texts = coded(flat.take(pa.array(np.arange(f, len(flat), width))), clean)
            self.fields.append((weight, number, Strings(texts)))

    def scores(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        total, got = np.zeros(len(p)), np.zeros(len(p))
        for weight, number, strings in self.fields:
            k = np.flatnonzero((number[p] >= 0) & (number[q] >= 0))
            total[k] += weight
            got[k] += strings.jaro_winkler(number[p[k]], number[q[k]]) * weight
        return np.where(total > 0, got / np.where(total > 0, total, 1.0), 0.0)


def gathered(found: Iterator[tuple]) -> Iterator[tuple]:
    """Arrays of pairs, several together until they hold BATCH, so that steps with few pairs are not scored singly."""
    own = []
    for x in found:
        own.append(x)
        if sum(len(y[0]) for y in own) >= BATCH:
            yield tuple(map(np.concatenate, zip(*own)))
            own = []
    if own:
        yield tuple(map(np.concatenate, zip(*own)))


def scored_pairs(table: pa.Table, v: cells.Vectors, found: Iterator, least: float) -> Iterator[tuple]:
    """(p, q, fuzzy, cosine, combined) of a cell's pairs of at least the cosine ``least``, in arrays."""
    fields = WeightedFields(table["values"].combine_chunks())
    for p, q, dot in gathered(found):
        cosine = rounded(dot / (v.norm[p] * v.norm[q]), 4)
        k = cosine >= least
        p, q, cosine = p[k], q[k], cosine[k]
        exact = fields.scores(p, q)
        yield p, q, rounded(exact, 4), cosine, rounded(FUZZY * exact + SEMANTIC * cosine, 4)


def text_pairs(entities: DataFrame, threshold: float) -> DataFrame:
    """Pairs of profiles whose texts have at least the cosine ``threshold``."""
    return cosine_pairs(profiles(entities).select("entity_type", "id", text_terms(F.col("fields")).alias("terms")), threshold)


def _scorable(entities: DataFrame) -> DataFrame:
    """The profiles as rows of cells: with terms and the values of the weighted fields."""
    values = F.array(*[F.coalesce(F.col("fields")[f], F.lit("")) for f in FUZZY_WEIGHTS_DEV])
    return profiles(entities).select("entity_type", "id", text_terms(F.col("fields")).alias("terms"), values.alias("values"))


def pair_scores(entities: DataFrame, threshold: float = 0.80, reached: bool = False, asked: DataFrame | None = None, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """(entity_type, id_a, id_b, fuzzy, cosine, combined) of all pairs of profiles that can reach ``threshold``.

    ``reached``: only those that do. ``asked`` (column id): only those with a profile that is asked for. ``scores``: which of the three are given.
    """
    least = least_cosine(threshold)

    def judge(table: pa.Table, v: cells.Vectors, found: Iterator) -> Iterator[pa.RecordBatch]:
        for p, q, fuzzy, cosine, combined in scored_pairs(table, v, found, least):
            k = combined >= threshold if reached else slice(None)
            of = {"fuzzy": fuzzy, "cosine": cosine, "combined": combined}
            yield from pair_batches(table, p[k], q[k], **{c: of[c][k] for c in scores})

    rows = _scorable(entities)
    if asked is not None:
        rows = rows.join(asked.select("id", F.lit(True).alias("asks")).distinct(), "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    return cells.pairs(rows, least, judge, ", ".join(["entity_type string, id_a string, id_b string", *(f"{c} double" for c in scores)]))


class Forest:
    """Connected rows of a cell, with the highest and the lowest score of each component."""

    def __init__(self, n: int):
        self.root, self.high, self.low = np.arange(n), np.full(n, -np.inf), np.full(n, np.inf)

    def add(self, p: np.ndarray, q: np.ndarray, score: np.ndarray) -> None:
        np.maximum.at(self.high, p, score)
        np.minimum.at(self.low, p, score)
        x, y = self.root[p], self.root[q]
        n = len(self.root)
        edges = np.unique(np.minimum(x, y) * n + np.maximum(x, y))
        edges = edges[edges // n != edges % n]
        parent = np.arange(n)

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for i, j in zip((edges // n).tolist(), (edges % n).tolist()):
            i, j = top(i), top(j)
            parent[max(i, j)] = min(i, j)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        self.root = parent[self.root]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, least row of its component, and the component's scores, of all connected rows."""
        n = len(self.root)
        high, low = np.full(n, -np.inf), np.full(n, np.inf)
        np.maximum.at(high, self.root, self.high)
        np.minimum.at(low, self.root, self.low)
        own = np.flatnonzero(np.isfinite(high[self.root]))
        return own, self.root[own], high[self.root[own]], low[self.root[own]]


def reached_edges(entities: DataFrame, threshold: float) -> DataFrame:
    """(a, b, high, low): edges that connect the same profiles as all pairs with scores at or above the threshold, b the least of its component in
    a cell, itself included; high and low are the extremes of the scores of all pairs of that component."""
    least = least_cosine(threshold)

    def judge(table: pa.Table, v: cells.Vectors, found: Iterator) -> Iterator[pa.RecordBatch]:
        forest = Forest(table.num_rows)
        for p, q, _, _, combined in scored_pairs(table, v, found, least):
            k = combined >= threshold
            forest.add(p[k], q[k], combined[k])
        p, q, high, low = forest.rows()
        ids = table["id"].combine_chunks()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(p)), ids.take(pa.array(q)), pa.array(high), pa.array(low)], ["a", "b", "high", "low"])

    return cells.pairs(_scorable(entities), least, judge, "a string, b string, high double, low double")


def clusters(entities: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """cluster, members, max_score, min_score of entities connected by scores at or above the threshold; see ``connected``."""
    edges = scored.where(F.col("combined") >= threshold).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("combined").alias("high"), F.col("combined").alias("low"))
    return connected(entities, edges)


def connected(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster, members, max_score, min_score of entities connected by edges (a, b, high, low).

    Entities of one profile are connected by the score 1 if it has a term and a weighted field; ``members`` counts entities.
    """
    scratch = Scratch(entities.sparkSession, "clusters")
    kept = scratch.save(edges, "kept")
    p = profiles(entities)
    able = F.exists(F.array(*[F.coalesce(F.col("fields")[f], F.lit("")) for f in FUZZY_WEIGHTS_DEV]), lambda v: v != "") & (F.size(text_terms(F.col("fields"))) > 0)
    sizes = p.select("id", F.when(able, F.col("members")).otherwise(F.lit(1)).alias("n"))
    of = components(kept.select("a", "b"))
    inside = sizes.join(of, "id", "left").where("component IS NOT NULL OR n > 1").select(F.coalesce("component", "id").alias("cluster"), "n")
    members = inside.groupBy("cluster").agg(F.sum("n").alias("members"), F.max((F.col("n") > 1).cast("int")).alias("copies"))
    best = kept.join(of.select(F.col("id").alias("a"), "component"), "a").groupBy(F.col("component").alias("cluster")).agg(
        F.max("high").alias("high"), F.min("low").alias("low")
    )
    high = F.when(F.col("copies") == 1, 1.0).otherwise(F.col("high"))
    return members.join(best, "cluster", "left").select("cluster", "members", high.alias("max_score"), F.coalesce("low", F.lit(1.0)).alias("min_score"))


def duplicates_of(scored: DataFrame, ids: DataFrame, threshold: float = 0.75, k: int | None = None) -> DataFrame:
    """The profiles that score at least ``threshold`` against each asked one (column id), best first, as ``rank``."""
    ends = F.array(F.struct(F.col("id_a").alias("id"), F.col("id_b").alias("candidate")), F.struct(F.col("id_b").alias("id"), F.col("id_a").alias("candidate")))
    both = scored.where(F.col("combined") >= threshold).select(F.explode(ends).alias("e"), "fuzzy", "cosine", "combined").select("e.*", "fuzzy", "cosine", "combined")
    found = both.join(ids.select("id").distinct(), "id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("combined"), "candidate"))
    found = found.withColumn("rank", rank)
    return found.where(F.col("rank") <= k) if k else found


def band(c: Column) -> Column:
    return F.when(c >= 0.92, "high").when(c >= 0.84, "medium").otherwise("low")


def triage(c: Column) -> Column:
    return F.when(c >= 0.95, "auto_merge").when(c >= 0.82, "queue").when(c >= 0.75, "flag").otherwise("none")


def confidence(fuzzy: Column, semantic: Column, matching: Column, same_source: Column) -> Column:
    """Blend without a language model: its weight is shared out; field overlap adds 0.05 at most, one source costs 0.03."""
    base = (0.30 * fuzzy + 0.35 * semantic) / 0.65
    out = base + F.least(F.lit(0.05), 0.01 * matching) - F.when(same_source, 0.03).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), out)), 4)


def search(rows: DataFrame, queries: list[str], k: int | None = 5, floor: float = 0.05) -> DataFrame:
    """The k entities (entity_id, terms) nearest to each query by cosine of term counts, or all above the floor; the few query terms are broadcast."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(x,) for x in queries], "query string").withColumn("terms", words(F.col("query")))
    q = term_counts(asked, ["query"], "terms")
    qn = q.groupBy("query").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("qnorm"))
    terms = term_counts(rows, ["entity_id"], "terms")
    norms = terms.groupBy("entity_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    hits = terms.join(F.broadcast(q.select("query", "term", F.col("tf").alias("qtf"))), "term").groupBy("query", "entity_id").agg(
        F.sum(F.col("tf") * F.col("qtf")).alias("dot")
    )
    out = hits.join(norms, "entity_id").join(F.broadcast(qn), "query")
    out = out.select("query", "entity_id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 4).alias("score")).where(F.col("score") > floor)
    return top_k(out, ["query"], [F.desc("score"), F.col("entity_id")], k) if k else out


def hybrid_search(entities: DataFrame, queries: list[str], k: int = 10) -> DataFrame:
    """query, entity_id, score, method: a field that holds the query scores 1, a name near to it .85, else the cosine of the texts counts."""
    asked = [clean(q) for q in queries]
    own = F.transform(F.map_entries(F.map_filter("fields", lambda _, v: present(v))), lambda e: F.lower(F.concat(F.lit('"'), e["key"], F.lit('": "'), e["value"], F.lit('"'))))
    rows = entities.select("entity_id", own.alias("own"), F.coalesce(F.col("fields")["name"], F.lit("")).alias("name"), text_terms(F.col("fields")).alias("terms"))
    each = rows.select("entity_id", "own", "name", F.explode(F.array(*[F.lit(q) for q in asked])).alias("query"))
    exact = F.exists("own", lambda v: F.contains(v, F.col("query")))
    sure = each.where(exact).select("query", "entity_id", F.lit(1.0).alias("score"), F.lit("exact").alias("method"))
    near = each.where(~exact & (F.col("name") != "")).where(jaro_winkler(cleaned(F.col("name")), F.col("query")) > 0.75)
    near = near.select("query", "entity_id", F.lit(0.85).alias("score"), F.lit("fuzzy").alias("method"))
    far = search(rows, asked, None).select("query", "entity_id", "score", F.lit("semantic").alias("method"))
    first = F.min_by(F.struct("score", "method"), F.when(F.col("method") == "exact", 0).when(F.col("method") == "fuzzy", 1).otherwise(2))
    best = sure.unionByName(near).unionByName(far).groupBy("query", "entity_id").agg(first.alias("s")).select("query", "entity_id", "s.*")
    return top_k(best, ["query"], [F.desc("score"), F.col("entity_id")], k)


def cleaned(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else clean(x))

    return run(c)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows per group as ``rank`` 1..k; Spark keeps k rows per group and task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1_000, chunk: int = 20_000) -> DataFrame:
    """The k vectors of largest cosine to each query vector, exact.

    The stated queries meet all vectors in blocks: one matrix product per block of queries and chunk of vectors, which
    keeps k of each; the k best of all chunks are then taken per query.
    """
    blocks, chunks = (max(1, -(-df.count() // n)) for df, n in ((queries, block), (vectors, chunk)))

    def bucket(n):
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def spread(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = queries.select("vec_id", "embedding", F.lit(True).alias("asks"), bucket(blocks).alias("b")).withColumn("c", spread(chunks))
    v = vectors.select("vec_id", "embedding", F.lit(False).alias("asks"), bucket(chunks).alias("c")).withColumn("b", spread(blocks))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, have = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(ask) or not len(have):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, y = (np.stack(f["embedding"].to_numpy()).astype(np.float64) for f in (ask, have))
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
        scores, ids = np.round(x @ y.T, 4), have["vec_id"].to_numpy()
        out = []
        for i, own in enumerate(ask["vec_id"]):
            best = np.lexsort((ids, -scores[i]))[: k + 1]
            out += [(own, ids[j], scores[i, j]) for j in best if ids[j] != own]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = q.unionByName(v).groupBy("b", "c").applyInPandas(product, "query_id bigint, vec_id bigint, score double")
    return top_k(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k)
