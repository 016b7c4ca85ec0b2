"""Best representative of each duplicate group, field by field.

One aggregation per table: for every field the extreme of a composite struct
(rank columns, entity id, value), so a group may hold any part of all rows.

Defined results: values without information never survive; a field of which a
group has no other value gives no row; a missing, blank or unlisted source
counts 0.5; no or no valid date is the oldest; no score is completeness 0;
rows without group or entity id are ignored; repeated rows change nothing;
fields other than the eight are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldenloom.session import table

FIELDS = ("name", "tax_id", "email", "phone", "address", "city", "country", "category")

ORDER = {
    "name": ("trust", "date", "completeness"),
    "tax_id": ("trust", "date", "completeness"),
    "email": ("date", "trust", "completeness"),
    "phone": ("date", "trust", "completeness"),
    "address": ("date", "trust", "completeness"),
    "city": ("completeness", "date", "trust"),
    "country": ("completeness", "date", "trust"),
    "category": ("completeness", "date", "trust"),
}

# Letters and digits of stand-ins for a missing value, in several languages.
STAND_INS = (
    "na", "nan", "nil", "null", "none", "no", "notapplicable", "notavailable", "notprovided", "notgiven", "notknown",
    "notset", "nodata", "novalue", "noinfo", "unknown", "unk", "undefined", "unspecified", "missing", "empty", "blank",
    "tbd", "tba", "tbc", "tobeconfirmed", "tobedetermined", "tobeadvised", "tobeprovided", "pending", "todo",
    "masked", "redacted", "confidential", "hidden", "dummy", "test", "testtest", "testing", "sample", "example",
    "donotuse", "donotcall", "dontuse", "delete", "deleted", "deleteme", "ignore", "invalid", "obsolete", "asdf", "qwerty", "abc",
    "noname", "noaddress", "noemail", "nophone", "nocity", "nocountry", "notaxid", "nocategory", "noone",
    "sameasabove", "asabove", "seeabove", "ditto", "same", "other", "misc",
    "ka", "keineangabe", "keineangaben", "unbekannt", "nichtangegeben", "nichtbekannt", "ohneangabe", "leer", "offen",
    "inconnu", "inconnue", "nonrenseigne", "nonrenseignee", "nonfourni", "sansobjet", "nc", "ndsp", "vide", "aucun", "adefinir",
    "desconocido", "desconocida", "sindatos", "sindato", "sd", "noaplica", "ninguno", "ninguna", "nodisponible", "vacio",
    "onbekend", "geen", "nvt", "nietbekend", "leeg", "niettoegepast",
)


def informative(field: str, value: Column) -> Column:
    """False for null, blanks, stand-ins, filler of one repeated sign, and for addresses of mail that name no host."""
    core = F.translate(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", ""), "éèêóíáúñ", "eeeoiaun")
    said = (
        value.isNotNull()
        & (core != "")
        & ~core.isin(*STAND_INS)
        & ~core.rlike(r"^x+$")
        & ~core.rlike(r"^[a-z]{0,3}(\p{N})\1*$")
    )
    if field == "email":
        host = F.lower(F.trim(F.element_at(F.split(value, "@"), -1)))
        local = F.regexp_replace(F.lower(F.element_at(F.split(value, "@"), 1)), r"[^\p{L}\p{N}]", "")
        said &= value.contains("@") & host.contains(".") & ~host.rlike(r"\.invalid\W*$") & ~local.isin(*STAND_INS)
    if field in ("phone", "tax_id"):
        digits = F.regexp_replace(value, r"\P{Nd}", "")
        said &= (F.length(digits) >= 5) & ~digits.isin("12345", "123456", "1234567", "12345678", "123456789", "1234567890", "0123456789")
    return F.coalesce(said, F.lit(False))


def ranked(candidates: DataFrame, scores: DataFrame, sources: DataFrame) -> DataFrame:
    """golden_record_id, entity_id, fields and the three ranks, negated so that the best is smallest."""
    latest = scores.where("entity_id IS NOT NULL").groupBy("entity_id").agg(
        F.max(F.struct("computed_at", "completeness"))["completeness"].alias("completeness")
    )
    trust = sources.where("source_name IS NOT NULL").groupBy("source_name").agg(F.max("trust_weight").alias("trust_weight"))
    date = F.when(F.col("updated_at") < F.to_timestamp(F.lit("2026-01-01T00:00:00Z")), F.unix_micros("updated_at"))
    return (
        candidates.where("golden_record_id IS NOT NULL AND entity_id IS NOT NULL")
        .select("golden_record_id", "entity_id", "source", "fields", F.coalesce(-date, F.lit(2**62)).alias("date"))
        .join(trust, F.col("source") == F.col("source_name"), "left")
        .join(latest, "entity_id", "left")
        .select(
            "golden_record_id", "entity_id", "fields", "date",
            (-F.coalesce("trust_weight", F.lit(0.5))).alias("trust"),
            (-F.coalesce("completeness", F.lit(0.0))).alias("completeness"),
        )
    )


def survivorship_map(candidates: DataFrame, scores: DataFrame, sources: DataFrame) -> DataFrame:
    """golden_record_id, field, entity_id, value of the surviving value of each field."""
    rows = ranked(candidates, scores, sources)
    best = [
        F.min(F.when(informative(f, F.col("fields")[f]),
                     F.struct(*ORDER[f], "entity_id", F.col("fields")[f].alias("value")))).alias(f)
        for f in FIELDS
    ]
    wide = rows.groupBy("golden_record_id").agg(*best)
    return wide.select(
        "golden_record_id",
        F.explode(F.array(*[
            F.struct(F.lit(f).alias("field"), F.col(f"{f}.entity_id").alias("entity_id"), F.col(f"{f}.value").alias("value"))
            for f in FIELDS
        ])).alias("s"),
    ).select("golden_record_id", "s.*").where("entity_id IS NOT NULL")


def _load(spark, d):
    return [table(spark, d, t) for t in ("resolution_candidates", "trust_scores", "data_sources")]


QUERIES = {
    "p7_found": lambda spark, d: survivorship_map(*_load(spark, d)).select("golden_record_id", "field", "entity_id"),
    "p7_golden_values": lambda spark, d: survivorship_map(*_load(spark, d)).select("golden_record_id", "field", "value"),
}

_STAND_INS_SQL = ", ".join(f"'{w}'" for w in STAND_INS)
_RANKED_SQL = f"""
WITH latest AS (
  SELECT entity_id, completeness FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY computed_at DESC NULLS LAST, completeness DESC NULLS LAST) AS rn
    FROM trust_scores) WHERE rn = 1
), c AS (
  SELECT golden_record_id, entity_id, fields,
    coalesce(trust_weight, 0.5) AS trust, coalesce(completeness, 0) AS completeness,
    CASE WHEN updated_at < TIMESTAMPTZ '2026-01-01 00:00:00+00' THEN updated_at ELSE TIMESTAMPTZ '0001-01-01 00:00:00+00' END AS date
  FROM resolution_candidates LEFT JOIN data_sources ON source = source_name LEFT JOIN latest USING (entity_id)
  WHERE golden_record_id IS NOT NULL AND entity_id IS NOT NULL
), v AS (
  SELECT c.*, field, fields[field] AS value FROM c, unnest({list(FIELDS)!r}) AS f(field)
), k AS (
  SELECT *, translate(regexp_replace(lower(value), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 'éèêóíáúñ', 'eeeoiaun') AS core,
    regexp_replace(value, '\\P{{Nd}}', '', 'g') AS digits, lower(trim(split_part(value, '@', -1))) AS host,
    regexp_replace(lower(split_part(value, '@', 1)), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS lp
  FROM v WHERE value IS NOT NULL
), s AS (
  SELECT * FROM k WHERE core <> '' AND core NOT IN ({_STAND_INS_SQL}) AND NOT regexp_matches(core, '^x+$')
    AND NOT regexp_matches(core, '^[a-z]{{0,3}}(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$')
    AND (field <> 'email' OR (contains(value, '@') AND contains(host, '.') AND NOT regexp_matches(host, '\\.invalid\\W*$')
         AND lp NOT IN ({_STAND_INS_SQL})))
    AND (field NOT IN ('phone', 'tax_id') OR (length(digits) >= 5
         AND digits NOT IN ('12345', '123456', '1234567', '12345678', '123456789', '1234567890', '0123456789')))
), r AS (
  SELECT *, row_number() OVER (PARTITION BY golden_record_id, field ORDER BY
    CASE WHEN field IN ('name', 'tax_id') THEN trust WHEN field IN ('email', 'phone', 'address') THEN epoch_us(date) ELSE completeness END DESC,
    CASE WHEN field IN ('email', 'phone', 'address') THEN trust ELSE epoch_us(date) END DESC,
    CASE WHEN field IN ('city', 'country', 'category') THEN trust ELSE completeness END DESC, entity_id, value) AS rn
  FROM s
)
"""

ORACLES = {
    "p7_found": _RANKED_SQL + "SELECT golden_record_id, field, entity_id FROM r WHERE rn = 1",
    "p7_golden_values": _RANKED_SQL + "SELECT golden_record_id, field, value FROM r WHERE rn = 1",
}
