"""p6: tool results that are copies of one another with small edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeweave.llm.near_dup import alike_groups, expand
from lakeweave.sources.tables import table


def found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = expand(table(spark, folder, "results").select("result_id", "text"))
    return pairs.withColumnsRenamed({"result_id_a": "result_a", "result_id_b": "result_b"})


def groups(spark: SparkSession, folder: str) -> DataFrame:
    return alike_groups(table(spark, folder, "results").select("result_id", "text"))


QUERIES = {"p6_found": found, "p6_groups": groups}

_PAIRS = """t AS (SELECT result_id, list_filter(string_split_regex(replace(max(text), chr(65279), ''), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM results WHERE result_id IS NOT NULL AND text IS NOT NULL GROUP BY result_id),
sh AS (SELECT result_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM t WHERE len(w) >= 20),
n AS (SELECT result_id, count(*) AS n FROM sh GROUP BY result_id),
both_hold AS (SELECT a.result_id AS result_a, b.result_id AS result_b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.result_id < b.result_id GROUP BY ALL),
pairs AS (SELECT result_a, result_b FROM both_hold JOIN n x ON x.result_id = result_a JOIN n y ON y.result_id = result_b WHERE c >= 0.7 * (x.n + y.n - c))"""
SQL = {
    "p6_found": f"WITH {_PAIRS} SELECT * FROM pairs",
    "p6_groups": f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT result_a AS x, result_b AS y FROM pairs UNION SELECT result_b, result_a FROM pairs),
        reach AS (SELECT x, y AS c FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.c = e.x), k AS (SELECT result_id, max(text) AS text FROM results WHERE result_id IS NOT NULL AND text IS NOT NULL GROUP BY result_id),
        nl AS (SELECT e.x, count(DISTINCT b.text) FILTER (a.text <> b.text) AS n_links, count(*) FILTER (a.text = b.text) + 1 AS n_copies FROM e JOIN k a ON a.result_id = e.x JOIN k b ON b.result_id = e.y GROUP BY e.x)
        SELECT reach.x AS result_id, least(reach.x, min(c)) AS class_id, n_copies, n_links FROM reach JOIN nl ON nl.x = reach.x GROUP BY reach.x, n_copies, n_links""",
}
