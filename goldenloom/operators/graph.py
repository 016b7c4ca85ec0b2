"""Property graph: edges, bounded traversals, impact, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldenloom.session import Scratch


def trade_edges(customer: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Distinct edges source, target, type: parties in nations, nations in regions."""
    located = customer.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target")).unionByName(
        supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target"))
    )
    regions = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"))
    return located.unionByName(regions).withColumn("type", F.lit("LOCATED_IN")).distinct()


def merge_edges(results: DataFrame) -> DataFrame:
    """Distinct DERIVED_FROM edges of accepted matches: the golden record is derived from the entity."""
    ok = results.where(F.col("action").isin("auto_merge", "approved") & F.col("golden_record_id").isNotNull() & F.col("entity_id").isNotNull())
    return ok.where("golden_record_id <> entity_id").select(
        F.col("golden_record_id").alias("source"), F.col("entity_id").alias("target"), F.lit("DERIVED_FROM").alias("type")
    ).distinct()


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, node, hops of all nodes within ``depth`` undirected hops of each seed (column node). One frontier join a hop."""
    scratch = Scratch(edges.sparkSession, "neighborhood")
    step = _undirected(edges)
    seen = scratch.save(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops")).distinct(), "0")
    for hop in range(1, depth + 1):
        front = seen.where(F.col("hops") == hop - 1).join(step, F.col("node") == F.col("source")).select("seed", F.col("target").alias("node")).distinct()
        new = front.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop))
        seen = scratch.save(seen.unionByName(new), str(hop))
        scratch.drop(str(hop - 1))
    return seen


def shortest_hops(edges: DataFrame, pairs: DataFrame, max_hops: int) -> DataFrame:
    """source, target, hops of each pair that is at most ``max_hops`` undirected hops apart; a node is 0 hops from itself."""
    near = neighborhood(edges, pairs.select(F.col("source").alias("node")), max_hops)
    return pairs.select("source", "target").distinct().join(near, (F.col("source") == F.col("seed")) & (F.col("target") == F.col("node"))).select("source", "target", "hops")


def impact(edges: DataFrame) -> DataFrame:
    """Edges in, out and distinct neighbours of every node."""
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("edges_out"))
    into = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("edges_in"))
    near = _undirected(edges).groupBy(F.col("source").alias("node")).agg(F.count("*").alias("neighbours"))
    return near.join(out, "node", "left").join(into, "node", "left").fillna(0, ["edges_out", "edges_in"])


def provenance(edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """node, origin, hops along directed edges up to ``max_depth``, each once at its least depth; cycles end."""
    scratch = Scratch(edges.sparkSession, "provenance")
    step = edges.select("source", "target").distinct()
    seen = scratch.save(step.where("source <> target").select(F.col("source").alias("node"), F.col("target").alias("origin"), F.lit(1).alias("hops")), "1")
    for hop in range(2, max_depth + 1):
        front = seen.where(F.col("hops") == hop - 1).join(step, F.col("origin") == F.col("source")).select("node", F.col("target").alias("origin")).distinct()
        new = front.where("node <> origin").join(seen.select("node", "origin"), ["node", "origin"], "left_anti").withColumn("hops", F.lit(hop))
        grown = scratch.save(new, f"new{hop}")
        if grown.isEmpty():
            break
        seen = scratch.save(seen.unionByName(grown), str(hop))
        scratch.drop(str(hop - 1), f"new{hop}")
    return seen


def stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("edges"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent union: an edge exists once."""
    return edges.unionByName(new).dropDuplicates(["source", "target", "type"])


def subgraph(edges: DataFrame, near: DataFrame, types: tuple[str, ...] = ()) -> DataFrame:
    """seed, source, target, type of the edges between nodes of a seed's neighbourhood (seed, node); of the given types, if there are any."""
    kept = edges.where(F.col("type").isin(*types)) if types else edges
    a, b = near.select("seed", F.col("node").alias("source")), near.select("seed", F.col("node").alias("target"))
    return kept.join(a, "source").join(b, ["seed", "target"]).select("seed", "source", "target", "type")


def typed_neighborhood(edges: DataFrame, seeds: DataFrame, depth: int, types: tuple[str, ...]) -> DataFrame:
    """As ``neighborhood``, but only edges of the types are walked along."""
    return neighborhood(edges.where(F.col("type").isin(*types)), seeds, depth)


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int) -> DataFrame:
    """source, target, hops, path of each pair: of the shortest paths the one whose nodes are smallest from the target back.

    One frontier join a hop; a node keeps its least predecessor of each source, so no path is carried along while searching, and the paths of the
    asked pairs are read back from their targets.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    step = _undirected(edges)
    seen = scratch.save(pairs.select(F.col("source").alias("seed"), F.col("source").alias("node"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("before")).distinct(), "0")
    for hop in range(1, max_hops + 1):
        front = seen.where(F.col("hops") == hop - 1).join(step, F.col("node") == F.col("source"))
        new = front.groupBy("seed", F.col("target").alias("to")).agg(F.min("node").alias("before")).withColumnRenamed("to", "node")
        new = new.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(hop).alias("hops"), "before")
        seen = scratch.save(seen.unionByName(new), str(hop))
        scratch.drop(str(hop - 1))
    back = pairs.select(F.col("source").alias("seed"), "target").distinct().join(seen.withColumnRenamed("node", "target"), ["seed", "target"])
    back = back.select("seed", "target", "hops", F.array("target").alias("path"), F.col("before").alias("at"))
    for hop in range(max_hops):
        prior = seen.select("seed", F.col("node").alias("at"), F.col("before").alias("next"))
        back = back.join(prior, ["seed", "at"], "left").select("seed", "target", "hops", F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat(F.array("at"), "path")).alias("path"), F.col("next").alias("at"))
    return back.select(F.col("seed").alias("source"), "target", "hops", F.array_join("path", ">").alias("path"))


def inbound(edges: DataFrame, seeds: DataFrame, max_hops: int = 4, types: tuple[str, ...] = ("DERIVED_FROM", "SOURCED_FROM")) -> DataFrame:
    """node, dependents: distinct nodes that lead to each seed (node) along edges of the types within the hops."""
    scratch = Scratch(edges.sparkSession, "inbound")
    step = edges.where(F.col("type").isin(*types)).select("source", "target").distinct()
    seen = scratch.save(seeds.select("node", F.col("node").alias("at"), F.lit(0).alias("hops")).distinct(), "0")
    for hop in range(1, max_hops + 1):
        front = seen.where(F.col("hops") == hop - 1).join(step, F.col("at") == F.col("target")).select("node", F.col("source").alias("at")).distinct()
        new = scratch.save(front.join(seen.select("node", "at"), ["node", "at"], "left_anti").withColumn("hops", F.lit(hop)), f"new{hop}")
        if new.isEmpty():
            break
        seen = scratch.save(seen.unionByName(new), str(hop))
    return seen.groupBy("node").agg(F.count_if(F.col("hops") > 0).alias("dependents"))


def nodes(entities: DataFrame) -> DataFrame:
    """id, label, name of the entities as nodes."""
    name = F.coalesce(F.col("fields")["name"], F.col("fields")["full_name"], F.substring("entity_id", 1, 8))
    return entities.select(F.col("entity_id").alias("id"), F.initcap("entity_type").alias("label"), name.alias("name"))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by id; a new one replaces."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new.dropDuplicates(["id"]))


def broken_constraints(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """rule, broken: ids that occur twice, edges without an end, edges that occur twice."""
    twice = lambda df, *by: df.groupBy(*by).count().where("count > 1")
    known = nodes_.select("id").distinct()
    loose = edges.join(known.withColumnRenamed("id", "source"), "source", "left_anti").unionByName(edges.join(known.withColumnRenamed("id", "target"), "target", "left_anti").select(*edges.columns))
    rows = (("node_id_unique", twice(nodes_, "id")), ("edge_ends_known", loose.distinct()), ("edge_unique", twice(edges, "source", "target", "type")))
    out = None
    for name, df in rows:
        one = df.agg(F.lit(name).alias("rule"), F.count("*").alias("broken"))
        out = one if out is None else out.unionByName(one)
    return out
