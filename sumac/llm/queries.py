"""Queries and oracles of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumac.llm import leaks, markup, mixing, neardup, pairs, sentences
from sumac.runtime import cut, table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"), run=12, errors=1)
    return found.filter("distance = 0").select("doc_id", "item_id")


def p5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 12 words with at most one word changed, added or left out, with where they are."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"), run=12, errors=1)


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items that share a passage of 12 words up to one edit, with the least number of edits."""
    return p5_near(spark, sf_dir).select("doc_id", "item_id", "distance")


def p5_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_report(p5_near(spark, sf_dir))


def _allotted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = cut(mixing.sized(table(spark, sf_dir, "documents")))  # narrow, read in every round
    return docs, mixing.allot(docs, mixing.capacity(docs, table(spark, sf_dir, "mix_targets")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that the allotment leaves short with all their documents at the cap."""
    return mixing.short_sources(_allotted(spark, sf_dir)[1])


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, allotted = _allotted(spark, sf_dir)
    return mixing.pareto_sample(mixing.expected_copies(docs, allotted)), allotted


def p6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times each document of a listed source is used."""
    return _mix(spark, sf_dir)[0].select("doc_id", "source", "n_tokens", "times")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mix(spark, sf_dir))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a fixed-size sample with whole copies, per source."""
    return mixing.sample_checks(*_mix(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf_dir, "documents"), units=False).select("doc_id", "start_char", "end_char")


def p7_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units per document and their mean length."""
    u = sentences.sentence_units(table(spark, sf_dir, "documents"), units=False)
    return u.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"), F.round(F.avg(F.col("end_char") - F.col("start_char")), 3).alias("mean_chars"), F.max("end_char").alias("last_char"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, sf_dir, "generations")).filter("precedence = 1").select("gen_id", "defect_type")


def p4_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every triggered defect type of each record."""
    return pairs.broken_pairs(table(spark, sf_dir, "generations"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "generations")
    return pairs.defect_report(pairs.broken_pairs(g), g)


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.fields_of(table(spark, sf_dir, "judge_pairs"), table(spark, sf_dir, "answers"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.kinds_of(_fields(spark, sf_dir)).distinct()


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text of every text field."""
    return markup.markup_of(_fields(spark, sf_dir)).select("table_name", "topic_id", "answer_id", "field_name", "clean_text").distinct()


def _near(spark: SparkSession, sf_dir: str, n: int, t: float, min_words: int) -> neardup.Join:
    return neardup.Join(neardup.bodies(table(spark, sf_dir, "questions"), table(spark, sf_dir, "answers")), n, t, min_words)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 3, 0.5, 12).pairs()


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose runs of five words agree to 0.8: class of equal texts, links to other classes, group."""
    return _near(spark, sf_dir, 5, 0.8, 5).groups()


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups, "p1_found": p1_found, "p1_clean": p1_clean, "p4_found": p4_found, "p4_types": p4_types, "p4_report": p4_report, "p7_found": p7_found, "p7_units": p7_units, "p5_found": p5_found, "p5_near": p5_near, "p5_pairs": p5_pairs, "p5_items": p5_items, "p6_found": p6_found, "p6_mix": p6_mix, "p6_shares": p6_shares, "p6_checks": p6_checks}

_RUNS = r"""w AS (SELECT t, id, list_filter(regexp_extract_all(lower(body_text), '[\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM (
  SELECT t, id, min_by(body_text, loaded_at) AS body_text FROM (SELECT 'questions' AS t, id, body_text, loaded_at FROM questions UNION ALL SELECT 'answers', id, body_text, loaded_at FROM answers) GROUP BY t, id)),
s AS (SELECT DISTINCT t, id, array_to_string(w[k:k + 2], ' ') AS r FROM w, unnest(range(1, len(w) - 1)) AS u(k) WHERE len(w) >= 12),
n AS (SELECT t, id, count(*) AS n FROM s GROUP BY ALL)"""

_LEAKS = r"""WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM heldout_items),
iw AS (SELECT DISTINCT item_id, w[k:k + 11] AS w FROM i, unnest(range(1, len(w) - 10)) AS t(k) WHERE len(w) >= 12),
iv AS (SELECT DISTINCT item_id, j, array_to_string(list_concat(w[1:j - 1], w[j + 1:12]), ' ') AS r FROM iw, unnest(range(1, 13)) AS t(j)),
d12 AS (SELECT DISTINCT doc_id, w[k:k + 11] AS w FROM d, unnest(range(1, len(w) - 10)) AS t(k) WHERE len(w) >= 12),
d13 AS (SELECT DISTINCT doc_id, w[k:k + 12] AS w FROM d, unnest(range(1, len(w) - 11)) AS t(k) WHERE len(w) >= 13),
d11 AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 10], ' ') AS r FROM d, unnest(range(1, len(w) - 9)) AS t(k) WHERE len(w) >= 11),
hits AS (SELECT doc_id, item_id, 0 AS distance FROM (SELECT doc_id, array_to_string(w, ' ') AS r FROM d12) JOIN (SELECT item_id, array_to_string(w, ' ') AS r FROM iw) USING (r)
UNION ALL SELECT doc_id, item_id, 1 FROM (SELECT doc_id, j, array_to_string(list_concat(w[1:j - 1], w[j + 1:12]), ' ') AS r FROM d12, unnest(range(1, 13)) AS t(j)) JOIN iv USING (j, r)
UNION ALL SELECT doc_id, item_id, 1 FROM (SELECT doc_id, array_to_string(list_concat(w[1:j - 1], w[j + 1:13]), ' ') AS r FROM d13, unnest(range(2, 13)) AS t(j)) JOIN (SELECT item_id, array_to_string(w, ' ') AS r FROM iw) USING (r)
UNION ALL SELECT doc_id, item_id, 1 FROM d11 JOIN iv USING (r))"""

SQL = {
    "p3_found": f"""WITH {_RUNS}, c AS (SELECT a.t, a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.r = b.r AND a.id < b.id GROUP BY ALL)
SELECT c.t AS table_name, id_a, id_b FROM c JOIN n x ON x.t = c.t AND x.id = id_a JOIN n y ON y.t = c.t AND y.id = id_b WHERE k >= 0.5 * (x.n + y.n - k)""",
    "p3_groups": r"""WITH RECURSIVE w AS (SELECT t, id, list_filter(regexp_extract_all(lower(body_text), '[\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM (
  SELECT t, id, min_by(body_text, loaded_at) AS body_text FROM (SELECT 'questions' AS t, id, body_text, loaded_at FROM questions UNION ALL SELECT 'answers', id, body_text, loaded_at FROM answers) GROUP BY t, id)),
r AS (SELECT t, id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')))) AS r FROM w WHERE len(w) >= 5),
m AS (SELECT t, id, r, min(id) OVER (PARTITION BY t, r) AS class_id FROM r),
c AS (SELECT t, id, r, len(r) AS n FROM m WHERE id = class_id), s AS (SELECT t, id, unnest(r) AS x FROM c),
k AS (SELECT a.t, a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.x = b.x AND a.id < b.id GROUP BY ALL),
e AS (SELECT k.t, a, b FROM k JOIN c x ON x.t = k.t AND x.id = a JOIN c y ON y.t = k.t AND y.id = b WHERE k >= 0.8 * (x.n + y.n - k)),
edges AS (SELECT t, a, b FROM e UNION ALL SELECT t, b, a FROM e), degree AS (SELECT t, a, count(*) AS n_links FROM edges GROUP BY ALL),
reach AS (SELECT t, a, b FROM edges UNION SELECT reach.t, reach.a, edges.b FROM reach JOIN edges ON edges.t = reach.t AND edges.a = reach.b),
g AS (SELECT t, a, least(a, min(b)) AS group_id FROM reach GROUP BY t, a)
SELECT m.t AS table_name, m.id, class_id, coalesce(n_links, 0) AS n_links, coalesce(group_id, class_id) AS group_id FROM m LEFT JOIN degree ON degree.t = m.t AND degree.a = class_id LEFT JOIN g ON g.t = m.t AND g.a = class_id""",
    "p5_found": r"""WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM heldout_items),
dr AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS r FROM d, unnest(range(1, len(w) - 10)) AS t(k) WHERE len(w) >= 12),
ir AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS r FROM i, unnest(range(1, len(w) - 10)) AS t(k) WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (r)""",
    # one word changed: windows of 12 without the j-th word; added: 13 words without an inner one; left out: 11 words
    "p5_pairs": f"{_LEAKS} SELECT doc_id, item_id, min(distance) AS distance FROM hits GROUP BY ALL",
    # runs of matching windows of 12 words, one after another in both texts, are one passage
    "p5_items": f"""{_LEAKS}, p AS (SELECT doc_id, item_id, min(distance) AS distance FROM hits GROUP BY ALL),
dp AS (SELECT doc_id, k AS dk, array_to_string(w[k:k + 11], ' ') AS r FROM d, unnest(range(1, len(w) - 10)) AS t(k) WHERE len(w) >= 12),
ip AS (SELECT item_id, k AS ik, array_to_string(w[k:k + 11], ' ') AS r FROM i, unnest(range(1, len(w) - 10)) AS t(k) WHERE len(w) >= 12),
x AS (SELECT doc_id, item_id, dk, ik, dk - row_number() OVER (PARTITION BY doc_id, item_id, dk - ik ORDER BY dk) AS island FROM dp JOIN ip USING (r)),
n AS (SELECT item_id, max(n) AS n FROM (SELECT item_id, count(*) + 11 AS n FROM x GROUP BY doc_id, item_id, dk - ik, island) GROUP BY item_id)
SELECT item_id, count_if(distance = 0) AS n_exact, count_if(distance > 0) AS n_near, coalesce(any_value(n), 12)::INTEGER AS longest_run FROM p LEFT JOIN n USING (item_id) GROUP BY item_id""",
    "p6_checks": "SELECT DISTINCT lower(trim(source)) AS source, true AS whole_copies_exact, true AS size_fixed, true AS cap_held, true AS share_met FROM mix_targets WHERE trim(source) <> ''",
    # any common tokenizer gives the same answer, so the SQL sizes texts by their UTF-8 bytes
    "p6_found": """WITH d AS (SELECT DISTINCT doc_id, lower(trim(source)) AS source, strlen(text) AS n FROM documents WHERE trim(source) <> ''),
s AS (SELECT source, sum(n) AS size FROM d GROUP BY ALL), t AS (SELECT sum(size) AS total FROM s)
SELECT lower(trim(m.source)) AS source FROM mix_targets m LEFT JOIN s ON s.source = lower(trim(m.source)) CROSS JOIN t WHERE coalesce(size, 0) * max_repeats < target_share * total""",
}
