"""p5: log lines whose schema drifts from file to file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeweave.operators import drift
from lakeweave.sources.tables import materialize, table


def _catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return drift.field_catalogue(table(spark, folder, "raw_log"))


def _changes(spark: SparkSession, folder: str, catalogue: DataFrame) -> DataFrame:
    numbered = drift.number_files(table(spark, folder, "session_files"), "agent_id", "written_at")
    return drift.changes(catalogue, numbered)


def _aliases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    # the catalogue is read by several steps
    catalogue = materialize(_catalogue(spark, folder), "drift-catalogue")
    return catalogue, drift.alias_table(_changes(spark, folder, catalogue))


def found(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(spark, folder, _catalogue(spark, folder)).select("file_id", "field", "change", "new_field")


def lifespans(spark: SparkSession, folder: str) -> DataFrame:
    numbered = drift.number_files(table(spark, folder, "session_files"), "agent_id", "written_at")
    return drift.lifespans(_catalogue(spark, folder), numbered).drop("island")


def casts(spark: SparkSession, folder: str) -> DataFrame:
    return drift.cast_table(*_aliases(spark, folder))


def unified(spark: SparkSession, folder: str) -> DataFrame:
    """One consistent table of all records' values, under one name and in one type each."""
    catalogue, aliases = _aliases(spark, folder)
    values = drift.record_values(table(spark, folder, "raw_log"), drift.mixed_fields(catalogue, aliases))
    return drift.unify(values, aliases, drift.cast_table(catalogue, aliases))


QUERIES = {"p5_found": found, "p5_lifespans": lifespans, "p5_casts": casts, "p5_unified": unified}

_CHANGES = r"""l AS (SELECT DISTINCT file_id, line FROM raw_log WHERE json_valid(line)), o AS (SELECT file_id, line, coalesce(json_extract_string(line, '$.type'), '') AS type FROM l WHERE json_type(line) = 'OBJECT'),
v AS (SELECT file_id, o.type || regexp_replace(k.fullkey[2:], '\[[0-9]+\]', '[]', 'g') AS field, CASE k.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind
  FROM o, json_tree(o.line) AS k WHERE k.type <> 'NULL'),
c AS (SELECT file_id, field, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, CASE WHEN field LIKE '%[]' THEN field[:-3] WHEN contains(field, '.') THEN regexp_replace(field, '\.[^.]*$', '') ELSE '' END AS parent FROM v GROUP BY file_id, field),
f AS (SELECT agent_id, file_id, lag(file_id) OVER (PARTITION BY agent_id ORDER BY written_at, file_id) AS old_id FROM session_files),
pr AS (SELECT * FROM f WHERE old_id IS NOT NULL),
a AS (SELECT pr.file_id, c.field, c.parent, c.kinds FROM pr JOIN c ON c.file_id = pr.old_id), b AS (SELECT pr.file_id, c.field, c.parent, c.kinds FROM pr JOIN c ON c.file_id = pr.file_id),
e AS (SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.field, b.field) AS field, coalesce(a.parent, b.parent) AS parent, a.kinds AS old_kinds, b.kinds AS kinds FROM a FULL JOIN b ON a.file_id = b.file_id AND a.field = b.field WHERE a.kinds IS DISTINCT FROM b.kinds),
r AS (SELECT file_id, max(CASE WHEN kinds IS NULL THEN field END) AS field, max(CASE WHEN old_kinds IS NULL THEN field END) AS new_field FROM e WHERE kinds IS NULL OR old_kinds IS NULL GROUP BY file_id, parent, coalesce(kinds, old_kinds)
  HAVING count(*) FILTER (kinds IS NULL) = 1 AND count(*) FILTER (old_kinds IS NULL) = 1),
x AS (SELECT e.file_id, e.field, CASE WHEN r.field IS NOT NULL THEN 'renamed' WHEN old_kinds IS NULL THEN 'added' WHEN kinds IS NULL THEN 'removed' ELSE 'retyped' END AS change, coalesce(r.new_field, '') AS new_field
  FROM e LEFT JOIN r ON r.file_id = e.file_id AND r.field = e.field WHERE NOT EXISTS (SELECT 1 FROM r r2 WHERE r2.file_id = e.file_id AND r2.new_field = e.field)),
found AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.file_id = x.file_id AND (starts_with(x.field, e.field || '.') OR starts_with(x.field, e.field || '[]'))))"""
SQL = {
    "p5_found": f"WITH {_CHANGES} SELECT * FROM found",
    "p5_lifespans": f"""WITH {_CHANGES}, s AS (SELECT agent_id AS producer, file_id, row_number() OVER (PARTITION BY agent_id ORDER BY written_at, file_id) AS seq, count(*) OVER (PARTITION BY agent_id) AS n_files FROM session_files),
        y AS (SELECT s.*, c.field, c.parent, c.kinds, seq - row_number() OVER (PARTITION BY producer, c.field, c.kinds ORDER BY seq) AS island FROM c JOIN s USING (file_id))
        SELECT producer, field, parent, kinds, min(seq) AS first_seq, max(seq) AS last_seq, arg_min(file_id, seq) AS first_file_id, arg_max(file_id, seq) AS last_file_id, max(n_files) AS n_files FROM y GROUP BY producer, field, parent, kinds, island""",
}
