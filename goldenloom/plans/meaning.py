"""Queries and oracles: ontology, similarity, search, golden records."""

from pyspark.sql import functions as F

from goldenloom import rules
from goldenloom.operators import entities as E
from goldenloom.operators import ontology as O
from goldenloom.operators import similarity as S
from goldenloom.operators import survivorship as V
from goldenloom.plans.scores import CUR
from goldenloom.session import table

SEARCHES = ["steel bracket", "sorting line north hall", "valve", "pallet rack"]


def _cur(s, d):
    return E.current(table(s, d, "entities"))


def _active(s, d):
    return _cur(s, d).where("status = 'active'")


def _classes(s, d, profile="dev"):
    return O.infer(_cur(s, d), profile)


def _service(s, d):
    return _classes(s, d, "service")


def _scored(s, d, score):
    return S.pair_scores(_active(s, d), scores=(score,))


def _terms(s, d):
    return _cur(s, d).select("entity_id", S.text_terms(F.col("fields")).alias("terms"))


def _asked(df, column="entity_id"):
    """Every fiftieth id asks."""
    return df.where(F.substring(F.col(column), -2, 2).isin("00", "50"))


def _results(s, d):
    return table(s, d, "resolution_results").dropDuplicates(["result_id"])


def _confidence(s, d):
    r = _results(s, d).where("fuzzy IS NOT NULL AND semantic IS NOT NULL")
    source = _cur(s, d).select("entity_id", "source")
    r = r.join(source.select("entity_id", F.col("source").alias("sa")), "entity_id", "left")
    r = r.join(source.select(F.col("entity_id").alias("golden_record_id"), F.col("source").alias("sb")), "golden_record_id", "left")
    n = F.coalesce(F.size("matching_fields"), F.lit(0))
    return r.select("result_id", S.confidence(F.col("fuzzy"), F.col("semantic"), n, F.coalesce(F.col("sa") == F.col("sb"), F.lit(False))).alias("confidence"))


def _bands(s, d):
    r = _results(s, d).where("combined IS NOT NULL")
    return r.groupBy(S.band(F.col("combined")).alias("band"), S.triage(F.col("combined")).alias("triage")).agg(F.count("*").alias("pairs"))


def _pair_bands(s, d):
    r = S.pair_scores(_active(s, d), 0.8, reached=True)
    return r.groupBy(S.band(F.col("combined")).alias("band"), S.triage(F.col("combined")).alias("triage")).agg(F.count("*").alias("pairs"))


def _vectors(s, d):
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    return S.vector_top_k(v, v.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id", "score")


def _clusters(s, d):
    e = _active(s, d)
    return S.connected(e, S.reached_edges(e, 0.8))


def _duplicates(s, d):
    asked = _asked(_cur(s, d)).select(F.col("entity_id").alias("id"))
    return S.duplicates_of(S.pair_scores(_cur(s, d), 0.75, reached=True, asked=asked), asked, 0.75)


def _type_pairs(s, d):
    """Types of entities that one source holds, pairwise; a source holds a handful of types."""
    t = _cur(s, d).where("source IS NOT NULL").select("source", "entity_type").distinct()
    pairs = t.withColumnRenamed("entity_type", "type_a").join(t.withColumnRenamed("entity_type", "type_b"), "source").where("type_a <> type_b")
    return O.relationships(pairs)


QUERIES = {
    "ontology_infer_dev": lambda s, d: _classes(s, d),
    "ontology_infer_service": lambda s, d: _service(s, d).withColumn("display_name", O.display_name(F.col("class_name"))),
    "class_distribution": lambda s, d: O.distribution(_service(s, d)),
    "taxonomy_tree": lambda s, d: O.taxonomy(_service(s, d)),
    "taxonomy_summary": lambda s, d: O.summary(_service(s, d)),
    "class_listing": lambda s, d: O.listing(_classes(s, d)),
    "reasoning_ancestors": lambda s, d: O.ancestors(O.class_edges(_service(s, d))),
    "reasoning_descendants": lambda s, d: O.descendants(O.class_edges(_service(s, d))),
    "reasoning_siblings": lambda s, d: O.siblings(O.class_pairs(_service(s, d))),
    "reasoning_flags": lambda s, d: O.reasoning(_service(s, d)),
    "similar_entities": lambda s, d: O.similar_entities(_service(s, d), _asked(_cur(s, d))),
    "relationship_types": _type_pairs,
    "schema_profile": lambda s, d: O.field_profile(_cur(s, d)),
    "schema_description": lambda s, d: O.schemas(_cur(s, d)),
    "tag_enrichment": lambda s, d: O.tags("dev", _cur(s, d), _classes(s, d)).withColumn("added", F.array_join("added", ",")),
    "tf_vectors": lambda s, d: S.term_counts(_terms(s, d), ["entity_id"], "terms"),
    "tf_cosine_pairs": lambda s, d: S.text_pairs(_active(s, d), S.least_cosine(0.80)),
    "profile_membership": lambda s, d: S.membership(_active(s, d)),
    "fuzzy_pair_scores": lambda s, d: _scored(s, d, "fuzzy"),
    "combined_pair_scores": lambda s, d: _scored(s, d, "combined"),
    "find_duplicates": _duplicates,
    "dup_clusters": _clusters,
    "pair_bands": _pair_bands,
    "confidence_breakdown": _confidence,
    "duplicate_bands": _bands,
    "semantic_search_topk": lambda s, d: S.search(_terms(s, d), SEARCHES).select("query", "entity_id", "score", "rank"),
    "hybrid_search": lambda s, d: S.hybrid_search(_cur(s, d), SEARCHES).select("query", "entity_id", "score", "method"),
    "embedding_topk": _vectors,
    "golden_records_trust": lambda s, d: V.by_trust(V.values(table(s, d, "resolution_candidates"))),
    "golden_records_recency": lambda s, d: V.by_recency(V.values(table(s, d, "resolution_candidates"))),
    "golden_records_majority": lambda s, d: V.by_majority(V.values(table(s, d, "resolution_candidates"))),
    "golden_records_longest": lambda s, d: V.by_length(V.values(table(s, d, "resolution_candidates"))),
    "golden_records_shortest": lambda s, d: V.by_length(V.values(table(s, d, "resolution_candidates")), False),
    "golden_records": lambda s, d: V.golden(table(s, d, "resolution_candidates")),
}

_FILLED = "list_sort(list_filter(map_entries({0}), lambda e: e.value IS NOT NULL AND e.value <> ''))"
_TWICE = ", ".join(f"'{f}'" for f in rules.TEXT_TWICE)


def _text(fields: str = "fields") -> str:
    own = _FILLED.format(fields)
    return f"array_to_string(list_transform(list_concat({own}, list_filter({own}, lambda e: e.key IN ({_TWICE}))), lambda e: e.value), ' ')"


def _onto_text(profile: str) -> str:
    if profile == "dev":
        return f"lower(array_to_string(list_transform({_FILLED.format('fields')}, lambda e: e.value), ' '))"
    return "lower(concat_ws(' ', " + ", ".join(f"CASE WHEN fields['{f}'] <> '' THEN fields['{f}'] END" for f in O.DESCRIPTIVE) + "))"


_TITLE = "replace(array_to_string(list_transform(regexp_extract_all(lower({0}), '\\p{{L}}+|\\P{{L}}+'), lambda w: upper(left(w, 1)) || substr(w, 2)), ''), ' ', '')"


def _classes_sql(profile: str) -> str:
    """One row per entity and class of its type with the number of keywords it holds."""
    parts = []
    for kind, classes in rules.ONTOLOGY[profile].items():
        for i, (c, words) in enumerate(classes.items()):
            n = " + ".join(f"CAST(contains(text, '{k}') AS INT)" for k in words)
            parts.append(f"SELECT entity_id, {i} AS pos, '{c}' AS c, {n} AS n FROM x WHERE entity_type = '{kind}'")
    parents = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.PARENTS.items()) + " ELSE 'Entity' END" if profile == "service" else "et"
    cat = _TITLE.format("fields['category']")
    cat = cat if profile == "dev" else f"regexp_replace({cat}, '[^a-zA-Z0-9]', '', 'g')"
    return f"""{CUR}, x AS (SELECT entity_id, entity_type, fields, {_onto_text(profile)} AS text, {_TITLE.format('entity_type')} AS et FROM cur),
      h AS ({' UNION ALL '.join(parts)}),
      b AS (SELECT entity_id, c, n FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, pos) AS rn FROM h WHERE n > 0) WHERE rn = 1),
      k AS (SELECT entity_id, entity_type, coalesce(c, CASE WHEN fields['category'] <> '' THEN {cat} || et ELSE et END) AS class_name,
        {parents} AS parent_class, round(least(1.0::DOUBLE, 0.55::DOUBLE + 0.10::DOUBLE * coalesce(n, 0)), 3) AS confidence FROM x LEFT JOIN b USING (entity_id))"""


_SERVICE = _classes_sql("service")
_EDGES = _SERVICE + """, cp AS (SELECT DISTINCT class_name AS child, parent_class AS parent FROM k), ce AS (SELECT * FROM cp WHERE child <> parent),
      up AS (SELECT child, parent AS ancestor, 1 AS depth FROM ce UNION ALL SELECT up.child, ce.parent, depth + 1 FROM up JOIN ce ON ce.child = up.ancestor WHERE depth < 20),
      anc AS (SELECT child, ancestor, min(depth) AS depth FROM up WHERE child <> ancestor GROUP BY 1, 2),
      de AS (SELECT class_name, coalesce(d.n, 0) AS descendants, coalesce(u.n, 0) AS depth FROM (SELECT ancestor AS class_name, count(DISTINCT child) AS n FROM anc GROUP BY 1) d FULL OUTER JOIN (SELECT child AS class_name, count(DISTINCT ancestor) AS n FROM anc GROUP BY 1) u USING (class_name)),
      sib AS (SELECT child AS class_name, parent, count(*) OVER (PARTITION BY parent) - 1 AS siblings FROM cp)"""
_WORDS = "[\\p{L}\\p{N}_]+"
PROFILES = f"""{CUR}, act AS (SELECT entity_id, entity_type, fields, CAST({_FILLED.format('fields')} AS VARCHAR) AS key FROM cur WHERE status = 'active'),
      prof AS (SELECT entity_type, key, min(entity_id) AS id, count(*) AS members, arg_min(fields, entity_id) AS fields FROM act GROUP BY 1, 2)"""


def _pairs_sql(base: str, least: float) -> str:
    return base + f""", w AS (SELECT entity_type, id, unnest(regexp_extract_all(lower({_text()}), '{_WORDS}')) AS term FROM prof),
      tf AS (SELECT entity_type, id, term, count(*) AS tf FROM w WHERE length(term) > 2 GROUP BY 1, 2, 3), nm AS (SELECT id, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY 1),
      pairs AS (SELECT * FROM (SELECT a.entity_type, a.id AS id_a, b.id AS id_b, round(sum(a.tf * b.tf) / (max(x.norm) * max(y.norm)), 4) AS cosine FROM tf a JOIN tf b ON a.entity_type = b.entity_type AND a.term = b.term AND a.id < b.id
        JOIN nm x ON x.id = a.id JOIN nm y ON y.id = b.id GROUP BY 1, 2, 3) WHERE cosine >= {least})"""


# The SQL's Jaro-Winkler counts bytes: letters beyond ASCII become capitals, which no lower-case text holds, so that each is one byte.
_BEYOND, _BYTES = "ßàáâäçèéëêíïñóôöøúüæ°‐–“„", "ABCDEFGHIJKLMNOPQRSTUVWXY"


def clean_sql(c: str) -> str:
    compat = f"translate(lower(nfc_normalize({c})), chr(160) || chr(8201) || chr(8239) || chr(8199) || 'ºª' || chr(8209), '    oa' || chr(8208))"
    return f"translate(trim(regexp_replace({compat}, '\\s+', ' ', 'g')), '{_BEYOND}', '{_BYTES}')"


def _scores_sql(base: str, least: float) -> str:
    one = lambda f: f"CASE WHEN a.fields['{f}'] <> '' AND b.fields['{f}'] <> '' THEN {{0}} ELSE 0.0::DOUBLE END"
    top = " + ".join(one(f).format(f"{w}::DOUBLE * (CASE WHEN {clean_sql(f'a.fields[{chr(39)}{f}{chr(39)}]')} = {clean_sql(f'b.fields[{chr(39)}{f}{chr(39)}]')} THEN 1.0::DOUBLE ELSE jaro_winkler_similarity({clean_sql(f'a.fields[{chr(39)}{f}{chr(39)}]')}, {clean_sql(f'b.fields[{chr(39)}{f}{chr(39)}]')}) END)") for f, w in rules.FUZZY_WEIGHTS_DEV.items())
    bottom = " + ".join(one(f).format(f"{w}::DOUBLE") for f, w in rules.FUZZY_WEIGHTS_DEV.items())
    return _pairs_sql(base, least) + f""", sc AS (SELECT entity_type, id_a, id_b, cosine, round(exact, 4) AS fuzzy, round(0.65::DOUBLE * exact + 0.35::DOUBLE * cosine, 4) AS combined FROM (
      SELECT pairs.*, CASE WHEN ({bottom}) > 0 THEN ({top}) / ({bottom}) ELSE 0.0::DOUBLE END AS exact FROM pairs JOIN prof a ON a.id = id_a JOIN prof b ON b.id = id_b))"""


SCORED = _scores_sql(PROFILES, S.least_cosine(0.80))
_ALL = PROFILES.replace(" FROM cur WHERE status = 'active')", " FROM cur)")
_ABLE = "(" + " OR ".join(f"coalesce(fields['{f}'], '') <> ''" for f in rules.FUZZY_WEIGHTS_DEV) + f") AND len(list_filter(regexp_extract_all(lower({_text()}), '{_WORDS}'), lambda w: length(w) > 2)) > 0"
_QUERIES_SQL = "q AS (SELECT unnest(" + str(SEARCHES) + ") AS query)"
SEARCH = f"""{CUR}, {_QUERIES_SQL}, w AS (SELECT entity_id, unnest(regexp_extract_all(lower({_text()}), '{_WORDS}')) AS term FROM cur), te AS (SELECT entity_id, term, count(*) AS tf FROM w WHERE length(term) > 2 GROUP BY 1, 2),
      nm AS (SELECT entity_id, sqrt(sum(tf * tf)) AS norm FROM te GROUP BY 1), qw AS (SELECT query, unnest(regexp_extract_all(query, '{_WORDS}')) AS term FROM q),
      qt AS (SELECT query, term, count(*) AS tf FROM qw WHERE length(term) > 2 GROUP BY 1, 2), qn AS (SELECT query, sqrt(sum(tf * tf)) AS norm FROM qt GROUP BY 1),
      hits AS (SELECT * FROM (SELECT query, entity_id, round(sum(te.tf * qt.tf) / (max(nm.norm) * max(qn.norm)), 4) AS score FROM te JOIN qt USING (term) JOIN nm USING (entity_id) JOIN qn USING (query) GROUP BY 1, 2) WHERE score > 0.05)"""
_ASKED = "right({0}, 2) IN ('00', '50')"
_R = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id) AS rn FROM resolution_results) WHERE rn = 1)"
_TRUST_SQL = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.SOURCE_TRUST["service"].items()) + " ELSE 0.5 END"
VALUES = f"""v AS (SELECT DISTINCT golden_record_id, entity_id, {_TRUST_SQL}::DOUBLE AS trust, updated_at, e.key AS field, e.value AS value
      FROM resolution_candidates, unnest(map_entries(fields)) AS u(e) WHERE golden_record_id IS NOT NULL AND entity_id IS NOT NULL AND e.value <> '')"""


def _golden(order: str, source: str = "v") -> str:
    return f"""SELECT golden_record_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY golden_record_id, field ORDER BY {order}, entity_id, value) AS rn FROM {source}) WHERE rn = 1"""


_MAJORITY = "m AS (SELECT golden_record_id, field, value, count(DISTINCT entity_id) AS n, min(entity_id) AS entity_id FROM v GROUP BY 1, 2, 3)"
_T, _RC = (", ".join(f"'{f}'" for f in x) for x in (rules.TRUST_FIELDS, rules.RECENCY_FIELDS))

ORACLES = {
    "ontology_infer_dev": f"WITH {_classes_sql('dev')} SELECT * FROM k",
    "ontology_infer_service": f"WITH {_SERVICE} SELECT *, trim(regexp_replace(class_name, '([A-Z])', ' \\1', 'g')) AS display_name FROM k",
    "class_distribution": f"WITH {_SERVICE} SELECT class_name, count(*) AS entities, round(avg(confidence), 4) AS avg_confidence FROM k GROUP BY 1",
    "taxonomy_tree": f"WITH {_SERVICE} SELECT parent_class, array_to_string(list_sort(list(DISTINCT class_name)), ',') AS children FROM k GROUP BY 1",
    "taxonomy_summary": f"WITH RECURSIVE {_EDGES} SELECT count(DISTINCT class_name) AS classes, count(*) AS entities, (SELECT max(depth) FROM de WHERE class_name IN (SELECT class_name FROM k)) AS max_depth FROM k",
    "class_listing": f"""WITH {_classes_sql('dev')} SELECT class_name, count(*) AS members, array_to_string(list_sort(list(entity_id))[1:5], ',') AS first_ids, arg_min(parent_class, entity_id) AS parent_class FROM k GROUP BY 1""",
    "reasoning_ancestors": f"WITH RECURSIVE {_EDGES} SELECT * FROM anc",
    "reasoning_descendants": f"WITH RECURSIVE {_EDGES} SELECT * FROM de",
    "reasoning_siblings": f"""WITH RECURSIVE {_EDGES}, f AS (SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY child) AS n FROM cp), o AS (SELECT sib.class_name, sib.parent, list_sort(list(f.child) FILTER (f.child <> sib.class_name))[1:5] AS related FROM sib JOIN f ON f.parent = sib.parent AND n <= 6 GROUP BY 1, 2)
      SELECT class_name, parent, siblings, coalesce(array_to_string(related, ','), '') AS related FROM sib JOIN o USING (class_name, parent)""",
    "reasoning_flags": f"""WITH RECURSIVE {_EDGES}, su AS (SELECT class_name, min(confidence) AS sure FROM k GROUP BY 1) SELECT entity_id, class_name, flags FROM (SELECT k.entity_id, class_name, concat_ws(',', CASE WHEN sure < 0.55 THEN 'low_confidence_classification' END,
      CASE WHEN coalesce(siblings, 0) = 0 AND coalesce(descendants, 0) = 0 THEN 'isolated_class_assignment' END) AS flags FROM k JOIN su USING (class_name) LEFT JOIN sib USING (class_name) LEFT JOIN de USING (class_name)) WHERE flags <> ''""",
    "similar_entities": f"""WITH {_SERVICE}, a AS (SELECT * FROM k WHERE {_ASKED.format('entity_id')}), f AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY entity_id) AS n FROM k),
      z AS (SELECT a.entity_id AS asked, f.entity_id, CASE WHEN a.class_name = f.class_name THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS similarity FROM a JOIN f ON a.class_name = f.class_name OR a.parent_class = f.parent_class WHERE f.n <= 11 AND a.entity_id <> f.entity_id)
      SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY asked ORDER BY similarity DESC, entity_id) AS INT) AS rank FROM z) WHERE rank <= 10""",
    "relationship_types": f"""WITH {CUR}, t AS (SELECT DISTINCT source, entity_type FROM cur WHERE source IS NOT NULL), r(type_a, type_b, r, d, c) AS (VALUES {', '.join(str((*k, *v)) for k, v in rules.RELATIONSHIPS.items())})
      SELECT source, a.entity_type AS type_a, b.entity_type AS type_b, coalesce(r, 'RELATED_TO') AS relationship, coalesce(d, 'bidirectional') AS direction, coalesce(c::DOUBLE, 0.3::DOUBLE) AS confidence FROM t a JOIN t b USING (source) LEFT JOIN r ON r.type_a = a.entity_type AND r.type_b = b.entity_type WHERE a.entity_type <> b.entity_type""",
    "schema_profile": f"""WITH {CUR} SELECT entity_type, e.key AS field, count(*) AS filled, count(DISTINCT e.value) AS distinct_values FROM cur, unnest(map_entries(fields)) AS u(e) WHERE e.value <> '' GROUP BY 1, 2""",
    "schema_description": f"""WITH {CUR}, f AS (SELECT DISTINCT entity_type, unnest(map_keys(fields)) AS field FROM cur) SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY field) <= 4 AS required, field IN ({', '.join(f"'{x}'" for x in rules.SCHEMA_PII)}) AS personal,
      field IN ({', '.join(f"'{x}'" for x in rules.SCHEMA_KEYS)}) AS identifier FROM f""",
    "tag_enrichment": f"""WITH {_classes_sql('dev')}, t(entity_type, class_name, words) AS (VALUES {', '.join(f"('{k}', '{c}', {list(w)[:4]})" for k, cs in rules.ONTOLOGY['dev'].items() for c, w in cs.items())})
      SELECT entity_id, class_name, array_to_string(added, ',') AS added FROM (SELECT k.entity_id, class_name, list_filter(words, lambda w: NOT list_contains(coalesce(cur.tags, []), w)) AS added FROM k JOIN t USING (entity_type, class_name) JOIN cur USING (entity_id)) WHERE len(added) > 0""",
    "tf_vectors": f"""WITH {CUR}, w AS (SELECT entity_id, unnest(regexp_extract_all(lower({_text()}), '{_WORDS}')) AS term FROM cur), t AS (SELECT entity_id, term, count(*) AS tf FROM w WHERE length(term) > 2 GROUP BY 1, 2)
      SELECT *, sum(tf) OVER (PARTITION BY entity_id)::BIGINT AS total FROM t""",
    "tf_cosine_pairs": f"WITH {_pairs_sql(PROFILES, S.least_cosine(0.80))} SELECT * FROM pairs",
    "profile_membership": f"WITH {PROFILES} SELECT entity_id, id FROM act JOIN prof USING (entity_type, key)",
    "fuzzy_pair_scores": f"WITH {SCORED} SELECT entity_type, id_a, id_b, fuzzy FROM sc",
    "combined_pair_scores": f"WITH {SCORED} SELECT entity_type, id_a, id_b, combined FROM sc",
    "find_duplicates": f"""WITH {_scores_sql(_ALL, S.least_cosine(0.75))}, b AS (SELECT id_a AS id, id_b AS candidate, fuzzy, cosine, combined FROM sc UNION ALL SELECT id_b, id_a, fuzzy, cosine, combined FROM sc)
      SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY combined DESC, candidate) AS INT) AS rank FROM b WHERE combined >= 0.75 AND {_ASKED.format('id')}""",
    "dup_clusters": f"""WITH RECURSIVE {SCORED}, e AS (SELECT id_a AS a, id_b AS b, combined FROM sc WHERE combined >= 0.8), n AS (SELECT id, CASE WHEN {_ABLE} THEN members ELSE 1 END AS n FROM prof),
      u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS m FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.id), g AS (SELECT id, min(m) AS cluster FROM r GROUP BY 1),
      z AS (SELECT coalesce(cluster, id) AS cluster, sum(n)::BIGINT AS members, max(n) AS most FROM n LEFT JOIN g USING (id) WHERE cluster IS NOT NULL OR n > 1 GROUP BY 1), x AS (SELECT cluster, max(combined) AS high, min(combined) AS low FROM e JOIN g ON g.id = e.a GROUP BY 1)
      SELECT cluster, members, CASE WHEN most > 1 THEN 1.0::DOUBLE ELSE high END AS max_score, coalesce(low, 1.0::DOUBLE) AS min_score FROM z LEFT JOIN x USING (cluster)""",
    "pair_bands": f"""WITH {SCORED} SELECT CASE WHEN combined >= 0.92 THEN 'high' WHEN combined >= 0.84 THEN 'medium' ELSE 'low' END AS band,
      CASE WHEN combined >= 0.95 THEN 'auto_merge' WHEN combined >= 0.82 THEN 'queue' WHEN combined >= 0.75 THEN 'flag' ELSE 'none' END AS triage, count(*) AS pairs FROM sc WHERE combined >= 0.8 GROUP BY 1, 2""",
    "confidence_breakdown": f"""WITH {CUR}, {_R} SELECT result_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (0.30::DOUBLE * fuzzy + 0.35::DOUBLE * semantic) / 0.65::DOUBLE + least(0.05::DOUBLE, 0.01::DOUBLE * coalesce(len(matching_fields), 0))
      - CASE WHEN a.source = b.source THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END)), 4) AS confidence FROM r LEFT JOIN cur a ON a.entity_id = r.entity_id LEFT JOIN cur b ON b.entity_id = r.golden_record_id WHERE fuzzy IS NOT NULL AND semantic IS NOT NULL""",
    "duplicate_bands": f"""WITH {_R} SELECT CASE WHEN combined >= 0.92 THEN 'high' WHEN combined >= 0.84 THEN 'medium' ELSE 'low' END AS band,
      CASE WHEN combined >= 0.95 THEN 'auto_merge' WHEN combined >= 0.82 THEN 'queue' WHEN combined >= 0.75 THEN 'flag' ELSE 'none' END AS triage, count(*) AS pairs FROM r WHERE combined IS NOT NULL GROUP BY 1, 2""",
    "semantic_search_topk": f"WITH {SEARCH} SELECT query, entity_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, entity_id) AS INT) AS rank FROM hits) WHERE rank <= 5",
    "hybrid_search": f"""WITH {SEARCH}, o AS (SELECT query, entity_id, CASE WHEN len(list_filter(map_entries(fields), lambda e: e.value <> '' AND contains(lower('"' || e.key || '": "' || e.value || '"'), query))) > 0 THEN 1.0::DOUBLE
        WHEN fields['name'] <> '' AND jaro_winkler_similarity({clean_sql("fields['name']")}, query) > 0.75 THEN 0.85::DOUBLE END AS score FROM cur, q),
      al AS (SELECT query, entity_id, score, CASE WHEN score = 1 THEN 'exact' ELSE 'fuzzy' END AS method, score = 1 AS first, FALSE AS last FROM o WHERE score IS NOT NULL UNION ALL SELECT query, entity_id, score, 'semantic', FALSE, TRUE FROM hits),
      bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, entity_id ORDER BY last) AS k FROM al) WHERE k = 1)
      SELECT query, entity_id, score, method FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, entity_id) AS rn FROM bst) WHERE rn <= 10""",
    "embedding_topk": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(list_transform(v.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE)), 4) AS score
      FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
      SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 10""",
    "golden_records_trust": f"WITH {VALUES} {_golden('trust DESC')}",
    "golden_records_recency": f"WITH {VALUES} {_golden('updated_at DESC NULLS LAST')}",
    "golden_records_majority": f"WITH {VALUES}, {_MAJORITY} {_golden('n DESC', 'm')}",
    "golden_records_longest": f"WITH {VALUES} {_golden('length(value) DESC')}",
    "golden_records_shortest": f"WITH {VALUES} {_golden('length(value)')}",
    "golden_records": f"""WITH {VALUES}, {_MAJORITY} SELECT *, 'trust' AS strategy FROM ({_golden('trust DESC')}) WHERE field IN ({_T})
      UNION ALL SELECT *, 'recency' FROM ({_golden('updated_at DESC NULLS LAST')}) WHERE field IN ({_RC})
      UNION ALL SELECT *, 'majority' FROM ({_golden('n DESC', 'm')}) WHERE field NOT IN ({_T}, {_RC})""",
}
