"""Golden records by one strategy per field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldenloom import rules
from goldenloom.functions.text import present
from goldenloom.operators.trust import source_trust


def values(candidates: DataFrame) -> DataFrame:
    """Distinct (group, entity, field, value) with source trust and time."""
    rows = candidates.where("golden_record_id IS NOT NULL AND entity_id IS NOT NULL").select(
        "golden_record_id", "entity_id", source_trust("service", F.col("source")).alias("trust"), "updated_at", F.explode("fields").alias("field", "value")
    )
    return rows.where(present(F.col("value"))).distinct()


def by_trust(v: DataFrame) -> DataFrame:
    return _best(v, F.struct((-F.col("trust")).alias("k"), "entity_id", "value"))


def by_recency(v: DataFrame) -> DataFrame:
    return _best(v, F.struct((-F.coalesce(F.unix_micros("updated_at"), F.lit(-(2**62)))).alias("k"), "entity_id", "value"))


def by_length(v: DataFrame, longest: bool = True) -> DataFrame:
    n = F.length("value")
    return _best(v, F.struct((-n if longest else n).alias("k"), "entity_id", "value"))


def by_majority(v: DataFrame) -> DataFrame:
    """The value most entities have; of equals the one of the smallest entity id."""
    counts = v.groupBy("golden_record_id", "field", "value").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))
    return _best(counts, F.struct((-F.col("n")).alias("k"), "entity_id", "value"))


def _best(v: DataFrame, order) -> DataFrame:
    return v.groupBy("golden_record_id", "field").agg(F.min(order)["value"].alias("value"))


STRATEGIES = {"trust": by_trust, "recency": by_recency, "majority": by_majority, "longest": by_length, "shortest": lambda v: by_length(v, False)}


def strategy(custom: dict[str, str] | None = None):
    """The strategy of a field: a rule of one's own, else that of the fixed lists, else majority."""
    out = F.when(F.col("field").isin(*rules.TRUST_FIELDS), "trust").when(F.col("field").isin(*rules.RECENCY_FIELDS), "recency").otherwise("majority")
    for field, name in (custom or {}).items():
        out = F.when(F.col("field") == field, name).otherwise(out)
    return out


def golden(candidates: DataFrame, custom: dict[str, str] | None = None) -> DataFrame:
    """golden_record_id, field, value and the strategy that chose it; ``custom`` gives fields another one of STRATEGIES, an unknown one is trust."""
    custom = {f: n if n in STRATEGIES else "trust" for f, n in (custom or {}).items()}
    v = values(candidates).withColumn("strategy", strategy(custom))
    out = None
    for s in dict.fromkeys(("trust", "recency", "majority", *custom.values())):
        part = STRATEGIES[s](v.where(F.col("strategy") == s)).withColumn("strategy", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out
