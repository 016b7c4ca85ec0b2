"""Consolidating pairwise matches into groups.

The graph is shrunk until nothing is left to shrink: vertices of degree one are
stripped, chains of vertices of degree two are compressed to one edge between
their two ends. The ends of a chain are found by list ranking (every arc of a
chain points to the next one, and pointers are doubled, so a chain of n takes
log n rounds). What remains, with three or more neighbours everywhere, is the
core; alternating large-star and small-star joins solve it. Every removed
vertex keeps a pointer to a vertex of its component that outlived it, and the
labels are restored along these pointers in reverse order.

Degrees and neighbours are count, min and max, which are pre-aggregated; no
step collects a vertex's neighbours. Where edges meet a table of vertices (one
row each), a hub that holds a large part of all edges is split by adaptive
execution: the joins are plain equi-joins, and the side of the vertices is read
by every part. Counts are taken while a table is written, so a round costs one
job for the degrees and one for each table it leaves behind.

Defined results: rows with a null id, an id paired with itself and repeated
pairs in either direction add nothing; ids without a link are no group; an
empty table gives no groups; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldenloom.operators.components import star_forest
from goldenloom.session import Scratch, table


def _both(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, as u, v."""
    return edges.select(
        F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                          F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
    ).select("e.u", "e.v")


def _degrees(edges: DataFrame) -> DataFrame:
    return _both(edges).groupBy("u").agg(F.count("*").alias("deg"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges with no end in ``gone`` (id)."""
    return edges.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(
        gone.select(F.col("id").alias("b")), "b", "left_anti"
    ).select("a", "b")


class Shrinking:
    """Edges (a < b, distinct) shrunk round by round; ``log`` holds the removed vertices (id, parent)."""

    def __init__(self, scratch: Scratch, edges: DataFrame):
        self.scratch, self.step, self.log = scratch, 0, []
        self.edges = self.save(edges, "edges")
        self.measure()

    def save(self, df: DataFrame, label: str) -> DataFrame:
        self.step += 1
        return self.scratch.save(df, f"{label}-{self.step}")

    def measure(self) -> None:
        """Degrees of the edges left, and how many vertices have one or two."""
        self.step += 1
        count = lambda d: F.count_if(F.col("deg") == d).alias(f"of{d}")
        self.degrees, self.seen = self.scratch.save_and(_degrees(self.edges), f"degrees-{self.step}", count(1), count(2), F.count(F.lit(1)).alias("all"))

    def replace(self, edges: DataFrame) -> None:
        self.edges = self.save(edges, "edges")
        self.measure()

    def strip(self) -> None:
        """Removes vertices of degree one; of two that have only each other, the greater."""
        leaves = self.degrees.where("deg = 1").select(F.col("u").alias("id"), F.col("lo").alias("parent"))
        other = leaves.select(F.col("id").alias("parent"), F.col("parent").alias("id"), F.lit(True).alias("mutual"))
        gone = leaves.join(other, ["id", "parent"], "left").where("mutual IS NULL OR id > parent").select("id", "parent")
        gone = self.save(gone, "stripped")
        self.log.append(gone)
        self.replace(_without(self.edges, gone))

    def compress(self) -> None:
        """Removes chains of degree-two vertices; closed rings become one group at once."""
        far = self.rank(self.degrees.where("deg = 2").select("u", "lo", "hi"))
        ends = far.groupBy("v").agg(
            F.min("tv").alias("t1"), F.max("tv").alias("t2"), F.min("m").alias("m"), F.bool_or("ring").alias("ring")
        )
        ends = self.save(ends, "ends")
        gone = ends.select(F.col("v").alias("id"), F.when(F.col("ring"), F.col("m")).otherwise(F.col("t1")).alias("parent"))
        self.log.append(gone.where("id <> parent"))
        bridges = ends.where("NOT ring AND t1 <> t2").select(F.col("t1").alias("a"), F.col("t2").alias("b"))
        self.replace(_without(self.edges, gone).unionByName(bridges).distinct())

    def rank(self, chain: DataFrame) -> DataFrame:
        """List ranking: for each arc v -> n out of a chain vertex the end (tv) reached that way."""
        arcs = chain.select("u", F.explode(F.array("lo", "hi")).alias("n"), F.col("u").alias("v")).select("v", "n")
        nxt = chain.select(F.col("u").alias("n"), "lo", "hi")
        arcs = arcs.join(nxt, "n", "left").select(
            "v", "n", F.col("n").alias("tv"),
            F.when(F.col("lo").isNotNull(), F.when(F.col("lo") == F.col("v"), F.col("hi")).otherwise(F.col("lo"))).alias("tn"),
            F.least("v", "n").alias("m"),
        )
        before = None
        while True:
            self.step += 1
            open_ = F.col("tn").isNotNull()
            arcs, now = self.scratch.save_and(arcs, f"arcs-{self.step}", F.count_if(open_).alias("open"), F.bit_xor(F.when(open_, F.xxhash64("v", "n", "m"))).alias("mix"))
            if before:
                self.scratch.drop(f"arcs-{self.step - 1}")
            # Any open chain finishes some arc in every round: no change means that only rings are left.
            if not now["open"] or now == before:
                return arcs.withColumn("ring", F.col("tn").isNotNull())
            before = now
            to = arcs.select(F.col("v").alias("tv"), F.col("n").alias("tn"), F.col("tv").alias("tv2"),
                             F.col("tn").alias("tn2"), F.col("m").alias("m2"))
            jumped = arcs.where("tn IS NOT NULL").join(to, ["tv", "tn"]).select(
                "v", "n", F.col("tv2").alias("tv"), F.col("tn2").alias("tn"), F.least("m", "m2").alias("m")
            )
            arcs = arcs.where("tn IS NULL").unionByName(jumped)

    def core(self) -> DataFrame:
        """Component minimum of every vertex left, by alternating large-star and small-star."""
        stars = star_forest(self.edges.select(F.col("b").alias("u"), F.col("a").alias("v")), self.scratch)
        return stars.select(F.col("u").alias("id"), F.col("v").alias("root"))


def connected_groups(pairs: DataFrame) -> DataFrame:
    """id, group_id for every id of ``pairs`` (a, b) that is linked to another; group_id is the smallest id."""
    spark = pairs.sparkSession
    edges = (
        pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    graph = Shrinking(Scratch(spark, "groups"), edges)
    while graph.seen["of2"] or graph.seen["of1"]:
        graph.compress() if graph.seen["of2"] else graph.strip()
    labels = graph.core() if graph.seen["all"] else spark.createDataFrame([], "id string, root string")
    for gone in reversed(graph.log):
        labels = graph.save(
            gone.join(labels.select(F.col("id").alias("parent"), "root"), "parent", "left")
            .select("id", F.coalesce("root", "parent").alias("root"))
            .unionByName(labels),
            "labels",
        )
    least = labels.groupBy("root").agg(F.min("id").alias("m")).select("root", F.least("root", "m").alias("group_id"))
    return labels.join(least, "root").select("id", "group_id").unionByName(
        least.select(F.col("root").alias("id"), "group_id")
    )


def result_groups(results: DataFrame) -> DataFrame:
    linked = results.where(F.col("action").isin("auto_merge", "approved"))
    return connected_groups(linked.select(F.col("golden_record_id").alias("a"), F.col("entity_id").alias("b"))).select(
        F.col("id").alias("entity_id"), "group_id"
    )


QUERIES = {"p5_found": lambda spark, d: result_groups(table(spark, d, "resolution_results"))}

ORACLES = {
    "p5_found": """
WITH RECURSIVE e AS (
  SELECT DISTINCT golden_record_id AS a, entity_id AS b FROM resolution_results
  WHERE action IN ('auto_merge', 'approved') AND golden_record_id IS NOT NULL AND entity_id IS NOT NULL
    AND golden_record_id <> entity_id
), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS m FROM n UNION SELECT n.b, r.m FROM r JOIN n ON n.a = r.id)
SELECT id AS entity_id, min(m) AS group_id FROM r GROUP BY id""",
}
