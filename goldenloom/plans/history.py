"""Query and oracle of the attribute history."""

from goldenloom.operators import history
from goldenloom.session import table

QUERIES = {"p4_found": lambda spark, d: history.versions(table(spark, d, "entities"))}

ORACLES = {
    "p4_found": """
WITH c AS (
  SELECT entity_id, captured_at, deleted_at IS NOT NULL AS gone,
         coalesce(status, '') || '|' || CAST(list_sort(list_filter(map_entries(fields),
             lambda e: e.value IS NOT NULL AND e.value <> '')) AS VARCHAR) AS state,
         row_number() OVER (PARTITION BY entity_id, captured_at
             ORDER BY version DESC NULLS LAST, ingested_at DESC NULLS LAST, deleted_at IS NOT NULL DESC) AS rn
  FROM entities WHERE entity_id IS NOT NULL AND captured_at IS NOT NULL
), o AS (
  SELECT *, lag(state) OVER w AS old_state, coalesce(lag(gone) OVER w, TRUE) AS old_gone
  FROM c WHERE rn = 1 WINDOW w AS (PARTITION BY entity_id ORDER BY captured_at)
), e AS (
  SELECT entity_id, captured_at, gone FROM o
  WHERE (NOT gone AND (old_gone OR state <> old_state)) OR (gone AND NOT old_gone)
), v AS (
  SELECT *, lead(captured_at) OVER (PARTITION BY entity_id ORDER BY captured_at) AS until FROM e
)
SELECT entity_id, strftime(captured_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS valid_from,
       coalesce(strftime(until AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), '9999-12-31 00:00:00') AS valid_to
FROM v WHERE NOT gone""",
}
