"""Derived inputs shared by the queries, with the same inputs in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumac.functions.columns import query_text
from sumac.operators.references import normal_key
from sumac.operators.search import exact_search
from sumac.runtime import broadcast_if_small, table


def answers(spark: SparkSession, d: str, *only: str) -> DataFrame:
    """One row per answer id, the first loaded; only: the columns beside the id, where not all are asked for."""
    a = table(spark, d, "answers")
    return a.groupBy("id").agg(F.min_by(F.struct(*(only or ("parent_id", "score", "body_text", "formulas"))), "loaded_at").alias("r")).select("id", "r.*")


def topics(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "topics")
    return t.select(F.col("topic_id").alias("qid"), query_text(F.col("title"), F.col("question")).alias("text")).filter("text IS NOT NULL")


def labels(spark: SparkSession, d: str) -> DataFrame:
    """qid, doc_id, rel, source of every parsed judgement."""
    j = table(spark, d, "judgements").filter("parse_ok AND label IS NOT NULL")
    return j.select("judgement_id", F.col("topic_id").alias("qid"), normal_key(F.col("answer_id")).alias("doc_id"), F.col("label").alias("rel"), "source", "judge_model", "judged_at").distinct()


def qrels(spark: SparkSession, d: str) -> DataFrame:
    """The last label of each pair."""
    return labels(spark, d).groupBy("qid", "doc_id").agg(F.max_by("rel", F.struct("judged_at", "judgement_id")).alias("rel"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of vector searches: ids divisible by 20, met by all vectors."""
    return vectors(spark, d).filter("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.col("v").alias("q"), F.col("label").alias("q_label"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).crossJoin(broadcast_if_small(vector_queries(spark, d), 10_000))  # the query set against all rows


def runs(spark: SparkSession, d: str) -> DataFrame:
    """run, qid, doc_id, score: the first thousand by the first half, the second half and the whole of the vectors."""
    parts = {"a": (0, 32), "b": (32, 64), "c": (0, 64)}
    return exact_search(vectors(spark, d), vector_queries(spark, d), DEPTH, parts=parts).select("run", "qid", "doc_id", "score")


def vector_qrels(spark: SparkSession, d: str) -> DataFrame:
    """Same label: grade 3 or 2; other labels: 0 or 1 for a third of the pairs; the rest unjudged."""
    s = F.col("qid") + F.col("doc_id")
    rel = F.when(F.col("q_label") == F.col("label"), F.lit(3) - s % 2).when(s % 3 == 0, s % 2).cast("int")
    return _pairs(spark, d).select("qid", "doc_id", rel.alias("rel")).filter("rel IS NOT NULL")


#: Depth of every run.
DEPTH = 1000
KEY = r"nullif(regexp_replace(regexp_replace(CAST({0} AS VARCHAR), '^\s+|\s+$', '', 'g'), '\.0$', ''), '')"
ANS = "ans AS (SELECT id, unnest(min_by(struct_pack(parent_id := parent_id, score := score, body_text := body_text, formulas := formulas), loaded_at)) FROM answers GROUP BY id)"
TOP = "top AS (SELECT topic_id AS qid, trim(concat_ws(' ', title, question)) AS text FROM topics WHERE trim(concat_ws(' ', title, question)) <> '')"
LAB = f"lab AS (SELECT DISTINCT judgement_id, topic_id AS qid, {KEY.format('answer_id')} AS doc_id, label AS rel, source, judge_model, judged_at FROM judgements WHERE parse_ok AND label IS NOT NULL)"
QRELS = f"{LAB}, qrels AS (SELECT qid, doc_id, rel FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY judged_at DESC, judgement_id DESC) AS n FROM lab) WHERE n = 1)"
VEC = "vec AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label FROM embeddings), vq AS (SELECT doc_id AS qid, v AS q, label AS q_label FROM vec WHERE doc_id % 20 = 0)"
RUNS = f"""{VEC}, pairs AS (
SELECT 'a' AS run, qid, doc_id, round(list_inner_product(q[1:32], v[1:32]), 6) AS score FROM vec CROSS JOIN vq
UNION ALL SELECT 'b', qid, doc_id, round(list_inner_product(q[33:64], v[33:64]), 6) FROM vec CROSS JOIN vq
UNION ALL SELECT 'c', qid, doc_id, round(list_inner_product(q, v), 6) FROM vec CROSS JOIN vq),
runs AS (SELECT run, qid, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY run, qid ORDER BY score DESC, doc_id) AS n FROM pairs) WHERE n <= {DEPTH})"""
VQRELS = "vqrels AS (SELECT * FROM (SELECT qid, doc_id, CAST(CASE WHEN q_label = label THEN 3 - (qid + doc_id) % 2 WHEN (qid + doc_id) % 3 = 0 THEN (qid + doc_id) % 2 END AS INTEGER) AS rel FROM vec CROSS JOIN vq) WHERE rel IS NOT NULL)"
TREC = "trec AS (SELECT *, row_number() OVER (PARTITION BY run, qid ORDER BY score DESC, CAST(doc_id AS VARCHAR) DESC) AS rank FROM runs)"


def measures_sql(source: str, qrels: str, cutoffs: tuple[int, ...], prime: bool, keys: str = "run, qid") -> str:
    """CTE `m`: one row a query with all measures, from a relation with keys, doc_id, score."""
    k = cutoffs
    idcg = ", ".join(f"sum(CASE WHEN i <= {c} THEN rel / log2(i + 1.0) ELSE 0 END) AS idcg_{c}" for c in k)
    cols = ", ".join(
        f"round(CASE WHEN any_value(idcg_{c}) > 0 THEN sum(CASE WHEN rank <= {c} THEN coalesce(rel, 0) / log2(rank + 1.0) ELSE 0 END) / any_value(idcg_{c}) ELSE 0 END, 6) AS ndcg_{c}, "
        f"round(sum(CASE WHEN rank <= {c} THEN is_rel ELSE 0 END) / {c}.0, 6) AS p_{c}, "
        f"round(CASE WHEN any_value(n_rel) > 0 THEN sum(CASE WHEN rank <= {c} THEN is_rel ELSE 0 END) / any_value(n_rel)::DOUBLE ELSE 0 END, 6) AS recall_{c}, "
        f"round(CASE WHEN any_value(n_rel) > 0 THEN sum(CASE WHEN rank <= {c} AND is_rel = 1 THEN seen / rank::DOUBLE ELSE 0 END) / any_value(n_rel) ELSE 0 END, 6) AS map_{c}"
        for c in k
    )
    join = "JOIN" if prime else "LEFT JOIN"
    return f"""ideal AS (SELECT qid, count_if(rel >= 2) AS n_rel, count_if(rel < 2) AS n_non, {idcg} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS i FROM {qrels}) GROUP BY qid),
j0 AS (SELECT s.*, rel FROM {source} s {join} {qrels} USING (qid, doc_id)),
j1 AS (SELECT *, CASE WHEN rel >= 2 THEN 1 ELSE 0 END AS is_rel, CASE WHEN rel < 2 THEN 1 ELSE 0 END AS is_non, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, CAST(doc_id AS VARCHAR) DESC) AS rank FROM j0),
j2 AS (SELECT *, sum(is_rel) OVER w AS seen, sum(is_non) OVER w AS non_above FROM j1 WINDOW w AS (PARTITION BY {keys} ORDER BY rank ROWS UNBOUNDED PRECEDING)),
m AS (SELECT {keys}, {cols},
 round(CASE WHEN any_value(n_rel) > 0 THEN sum(CASE WHEN is_rel = 1 THEN seen / rank::DOUBLE ELSE 0 END) / any_value(n_rel) ELSE 0 END, 6) AS map,
 round(CASE WHEN any_value(n_rel) > 0 THEN sum(CASE WHEN is_rel = 1 AND least(n_rel, n_non) > 0 THEN 1.0 - least(non_above, n_rel) / least(n_rel, n_non)::DOUBLE WHEN is_rel = 1 THEN 1.0 ELSE 0 END) / any_value(n_rel) ELSE 0 END, 6) AS bpref
 FROM j2 JOIN ideal USING (qid) GROUP BY {keys})"""
