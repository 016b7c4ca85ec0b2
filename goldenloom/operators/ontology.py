"""Ontology: class inference by keywords, taxonomy and reasoning over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldenloom import rules
from goldenloom.functions.text import present

# Fields that describe an entity in the service profile, in order.
DESCRIPTIVE = ("name", "full_name", "company_name", "description", "category", "industry", "department", "title", "sector")
#: Confidence below which a classification is flagged.
LOW = 0.55


def entity_text(profile: str) -> Column:
    """Values of all fields by key (dev) or of the descriptive fields in their order (service), lower case."""
    if profile == "dev":
        pairs = F.array_sort(F.map_entries(F.map_filter("fields", lambda _, v: present(v))))
        return F.lower(F.array_join(F.transform(pairs, lambda e: e["value"]), " "))
    return F.lower(F.concat_ws(" ", *[F.when(present(F.col("fields")[f]), F.col("fields")[f]) for f in DESCRIPTIVE]))


def title(c: Column) -> Column:
    """Every run of letters capitalised, without blanks."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.replace(F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), ""), F.lit(" "), F.lit(""))


def infer(entities: DataFrame, profile: str = "dev") -> DataFrame:
    """entity_id, entity_type, class_name, parent_class, confidence; the first class with most keywords wins.

    The rules are a fixed table of a few types, so they are broadcast and folded per row.
    """
    spark = entities.sparkSession
    table = [(k, [(-i, c, list(rules.ONTOLOGY[profile][k][c])) for i, c in enumerate(cs)]) for k, cs in rules.ONTOLOGY[profile].items()]
    rules_df = F.broadcast(spark.createDataFrame(table, "entity_type string, rules array<struct<p:int,c:string,words:array<string>>>"))
    rows = entities.select("entity_id", "entity_type", F.col("fields")["category"].alias("category"), entity_text(profile).alias("text"))
    hits = F.transform("rules", lambda r: F.struct(F.size(F.filter(r["words"], lambda w: F.contains(F.col("text"), w))).alias("n"), r["p"].alias("p"), r["c"].alias("c")))
    rows = rows.join(rules_df, "entity_type", "left").select("entity_id", "entity_type", "category", F.array_max(hits).alias("best"))
    category = title(F.col("category")) if profile == "dev" else F.regexp_replace(title(F.col("category")), "[^a-zA-Z0-9]", "")
    other = F.when(present(F.col("category")), F.concat(category, title(F.col("entity_type")))).otherwise(title(F.col("entity_type")))
    parents = F.create_map(*[F.lit(x) for kv in rules.PARENTS.items() for x in kv])
    parent = title(F.col("entity_type")) if profile == "dev" else F.coalesce(parents[F.col("entity_type")], F.lit("Entity"))
    confidence = F.round(F.least(F.lit(1.0), 0.55 + 0.10 * F.coalesce("best.n", F.lit(0))), 3)
    return rows.select("entity_id", "entity_type", F.when(F.col("best.n") > 0, F.col("best.c")).otherwise(other).alias("class_name"), parent.alias("parent_class"), confidence.alias("confidence"))


def distribution(classes: DataFrame) -> DataFrame:
    return classes.groupBy("class_name").agg(F.count("*").alias("entities"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))


def taxonomy(classes: DataFrame) -> DataFrame:
    """Parent class with its sorted distinct children."""
    return classes.select("parent_class", "class_name").distinct().groupBy("parent_class").agg(F.array_join(F.array_sort(F.collect_set("class_name")), ",").alias("children"))


def class_pairs(classes: DataFrame) -> DataFrame:
    """Distinct child, parent classes."""
    return classes.select(F.col("class_name").alias("child"), F.col("parent_class").alias("parent")).distinct()


def class_edges(classes: DataFrame) -> DataFrame:
    """child, parent edges of the class hierarchy; a class that is its own parent is a root."""
    return class_pairs(classes).where("child <> parent")


def ancestors(edges: DataFrame) -> DataFrame:
    """child, ancestor, depth over all levels; recursion carries the path and stops at a repeated class."""
    spark = edges.sparkSession
    return spark.sql(
        """
        WITH RECURSIVE up(child, ancestor, depth, path) AS (
          SELECT child, parent, 1, array(child, parent) FROM {edges}
          UNION ALL
          SELECT u.child, e.parent, u.depth + 1, array_append(u.path, e.parent)
          FROM up u JOIN {edges} e ON u.ancestor = e.child WHERE NOT array_contains(u.path, e.parent) AND u.depth < 20
        ) SELECT child, ancestor, min(depth) AS depth FROM up GROUP BY child, ancestor""",
        edges=edges,
    )


def descendants(edges: DataFrame) -> DataFrame:
    """class_name, descendants, depth: how many classes lie below each class, and how far it is from a root."""
    up = ancestors(edges)
    below = up.groupBy(F.col("ancestor").alias("class_name")).agg(F.count_distinct("child").alias("descendants"))
    above = up.groupBy(F.col("child").alias("class_name")).agg(F.count_distinct("ancestor").alias("depth"))
    return below.join(above, "class_name", "full_outer").fillna(0, ["descendants", "depth"])


def siblings(pairs: DataFrame) -> DataFrame:
    """class_name, parent, siblings: how many other classes have its parent, and the first five of them.

    Each class stands beside its parent's first six children, so no parent's children are paired out.
    """
    few = Window.partitionBy("parent").orderBy("child")
    first = pairs.withColumn("n", F.row_number().over(few)).where("n <= 6").groupBy("parent").agg(F.array_sort(F.collect_list("child")).alias("first"))
    sizes = pairs.groupBy("parent").agg((F.count("*") - 1).alias("siblings"))
    rows = pairs.join(sizes, "parent").join(first, "parent")
    others = F.slice(F.array_remove("first", F.col("child")), 1, 5)
    return rows.select(F.col("child").alias("class_name"), "parent", "siblings", F.array_join(others, ",").alias("related"))


def reasoning(classes: DataFrame) -> DataFrame:
    """entity_id, class_name, parent, related, flags of each entity whose class has low confidence or neither siblings nor descendants.

    A class has the least confidence of its entities.
    """
    edges = class_edges(classes)
    about = siblings(class_pairs(classes)).join(descendants(edges).select("class_name", "descendants"), "class_name", "left")
    sure = classes.groupBy("class_name").agg(F.min("confidence").alias("sure"))
    rows = classes.select("entity_id", "class_name").join(sure, "class_name").join(about, "class_name", "left")
    alone = (F.coalesce("siblings", F.lit(0)) == 0) & (F.coalesce("descendants", F.lit(0)) == 0)
    flags = F.array_compact(F.array(F.when(F.col("sure") < LOW, "low_confidence_classification"), F.when(alone, "isolated_class_assignment")))
    return rows.select("entity_id", "class_name", F.array_join(flags, ",").alias("flags")).where("flags <> ''")


def similar_entities(classes: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """The k entities of an asked entity's class (similarity 1), then of its sibling classes (.7), by id.

    Only the first k + 1 entities of a class can be among the answers, so a class of any size gives k + 1 rows.
    """
    of = classes.select("entity_id", "class_name", "parent_class")
    first = of.withColumn("n", F.row_number().over(Window.partitionBy("class_name").orderBy("entity_id"))).where(F.col("n") <= k + 1).drop("n")
    want = of.join(asked.select("entity_id").distinct(), "entity_id", "left_semi").select(F.col("entity_id").alias("asked"), F.col("class_name").alias("own"), "parent_class")
    same = want.join(first.select("entity_id", F.col("class_name").alias("own")), "own").select("asked", "entity_id", F.lit(1.0).alias("similarity"))
    beside = want.join(first, "parent_class").where("own <> class_name").select("asked", "entity_id", F.lit(0.7).alias("similarity"))
    order = Window.partitionBy("asked").orderBy(F.desc("similarity"), "entity_id")
    return same.unionByName(beside).where("asked <> entity_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def summary(classes: DataFrame) -> DataFrame:
    """One row: classes, entities and the greatest depth of a class."""
    depth = descendants(class_edges(classes)).join(classes.select("class_name").distinct(), "class_name", "left_semi").agg(F.max("depth").alias("max_depth"))
    return classes.agg(F.count_distinct("class_name").alias("classes"), F.count("*").alias("entities"), F.lit(1).alias("one")).join(depth.withColumn("one", F.lit(1)), "one").drop("one")


def listing(classes: DataFrame, k: int = 5) -> DataFrame:
    """class_name, parent_class, members and the first k ids of each class; Spark keeps k rows a class and task before it shuffles."""
    sizes = classes.groupBy("class_name").agg(F.count("*").alias("members"))
    first = classes.withColumn("n", F.row_number().over(Window.partitionBy("class_name").orderBy("entity_id"))).where(F.col("n") <= k)
    few = first.groupBy("class_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "entity_id"))), lambda e: e["entity_id"]), ",").alias("first_ids"), F.min_by("parent_class", "n").alias("parent_class"))
    return sizes.join(few, "class_name")


def display_name(class_name: Column) -> Column:
    return F.trim(F.regexp_replace(class_name, r"([A-Z])", " $1"))


def tags(profile: str, entities: DataFrame, classes: DataFrame) -> DataFrame:
    """entity_id, class_name, added: the first four keywords of its class that an entity has no tag of yet."""
    words = [(k, c, list(w)[:4]) for k, cs in rules.ONTOLOGY[profile].items() for c, w in cs.items()]
    known = F.broadcast(entities.sparkSession.createDataFrame(words, "entity_type string, class_name string, words array<string>"))
    rows = classes.join(known, ["entity_type", "class_name"]).join(entities.select("entity_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")), "entity_id")
    return rows.select("entity_id", "class_name", F.array_except("words", "tags").alias("added")).where(F.size("added") > 0)


def relationships(pairs: DataFrame) -> DataFrame:
    """relationship, direction, confidence of pairs (type_a, type_b) by the fixed table of types, a general one where it has none."""
    table = [(*k, *v) for k, v in rules.RELATIONSHIPS.items()]
    known = F.broadcast(pairs.sparkSession.createDataFrame(table, "type_a string, type_b string, r string, d string, c double"))
    r, d, c = rules.ANY_RELATIONSHIP
    return pairs.join(known, ["type_a", "type_b"], "left").select(*pairs.columns, F.coalesce("r", F.lit(r)).alias("relationship"), F.coalesce("d", F.lit(d)).alias("direction"), F.coalesce("c", F.lit(c)).alias("confidence"))


def schemas(entities: DataFrame) -> DataFrame:
    """Per entity type and field, by name: required (the first four) or not, personal data or not, key for matching or not."""
    fields = entities.select("entity_type", F.explode(F.map_keys("fields")).alias("field")).distinct()
    rank = F.row_number().over(Window.partitionBy("entity_type").orderBy("field"))
    return fields.select("entity_type", "field", (rank <= 4).alias("required"), F.col("field").isin(*rules.SCHEMA_PII).alias("personal"), F.col("field").isin(*rules.SCHEMA_KEYS).alias("identifier"))


def field_profile(entities: DataFrame) -> DataFrame:
    """Per entity type and field: how many entities fill it, and its rank by that; the four first are required."""
    rows = entities.select("entity_type", F.explode("fields").alias("field", "value")).where(present(F.col("value")))
    return rows.groupBy("entity_type", "field").agg(F.count("*").alias("filled"), F.count_distinct("value").alias("distinct_values"))
