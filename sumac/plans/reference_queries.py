"""Queries and oracles of the reference-integrity problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sumac.operators.references import ForeignKey, orphan_references, orphan_report
from sumac.runtime import table

KEYS = [
    ForeignKey("answers", "parent_id", "questions"),
    ForeignKey("questions", "accepted_answer_id", "answers", time="accepted_at"),
    ForeignKey("judgements", "answer_id", "answers", record_id="judgement_id", time="judged_at", loaded="judged_at"),
]


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in ("answers", "questions", "judgements")}
    return orphan_references(tables, KEYS, table(spark, sf_dir, "removed_posts"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).filter("origin = 'direct'").select("table_name", "field_name", "record_key", "ref_state", "ref_month")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


_CLEAN = r"nullif(regexp_replace(regexp_replace(CAST({0} AS VARCHAR), '^[\s\x{{00a0}}\x{{200b}}\x{{feff}}]+|[\s\x{{00a0}}\x{{200b}}\x{{feff}}]+$', '', 'g'), '\.0$', ''), '')"
_REFS = rf"""
raw AS (
  SELECT 'answers' AS table_name, 'parent_id' AS field_name, id AS record_key, 'questions' AS target_table, parent_id AS k, loaded_at AS ref_time, loaded_at AS l FROM answers
  UNION ALL SELECT 'questions', 'accepted_answer_id', id, 'answers', accepted_answer_id, accepted_at, loaded_at FROM questions
  UNION ALL SELECT 'judgements', 'answer_id', CAST(judgement_id AS VARCHAR), 'answers', answer_id, judged_at, judged_at FROM judgements),
one AS (SELECT *, row_number() OVER (PARTITION BY table_name, record_key ORDER BY l NULLS LAST, k NULLS FIRST, ref_time NULLS FIRST) AS n FROM raw WHERE record_key IS NOT NULL),
refs AS (SELECT table_name, field_name, record_key, target_table, {_CLEAN.format('k')} AS ref_key, ref_time FROM one WHERE n = 1),
stored AS (
  SELECT 'questions' AS t, {_CLEAN.format('id')} AS k, min(loaded_at) AS f FROM questions GROUP BY ALL
  UNION ALL SELECT 'answers', {_CLEAN.format('id')}, min(loaded_at) FROM answers GROUP BY ALL),
gone AS (SELECT {_CLEAN.format('post_id')} AS k, min(removed_at) AS r FROM removed_posts GROUP BY ALL),
states AS (
  SELECT refs.*, CASE WHEN r <= ref_time THEN 'deleted' WHEN stored.k IS NULL THEN 'missing' WHEN f > ref_time THEN 'late' END AS ref_state
  FROM refs LEFT JOIN gone ON gone.k = ref_key LEFT JOIN stored ON stored.t = target_table AND stored.k = ref_key WHERE ref_key IS NOT NULL)
"""
SQL = {
    "p2_found": f"WITH {_REFS} SELECT table_name, field_name, record_key, ref_state, strftime(ref_time, '%Y-%m') AS ref_month FROM states WHERE ref_state IS NOT NULL",
    "p2_report": f"""WITH RECURSIVE {_REFS},
orphan AS (
  SELECT table_name AS t, record_key AS k FROM states WHERE ref_state IS NOT NULL
  UNION SELECT s.table_name, s.record_key FROM states s JOIN orphan o ON s.target_table = o.t AND s.ref_key = o.k WHERE s.ref_state IS NULL),
rows_ AS (
  SELECT table_name, field_name, ref_time, ref_key, 'direct' AS origin, ref_state FROM states WHERE ref_state IS NOT NULL
  UNION ALL SELECT s.table_name, s.field_name, s.ref_time, s.ref_key, 'inherited', 'inherited' FROM states s JOIN orphan o ON s.target_table = o.t AND s.ref_key = o.k WHERE s.ref_state IS NULL)
SELECT table_name, field_name, strftime(ref_time, '%Y-%m') AS ref_month, origin, ref_state, count(*) AS n_refs, count(DISTINCT ref_key) AS n_keys FROM rows_ GROUP BY ALL""",
}
QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
