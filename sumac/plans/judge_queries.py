"""Queries of label agreement, references, contexts, accounting, sources, sinks and ingest, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumac.operators import agreement as A
from sumac.operators import evaluation as E
from sumac.operators import rag as R
from sumac.operators import search as S
from sumac.plans.evaluation_queries import CUTS, _CH, _channels, _measured
from sumac.plans.tables import ANS, LAB, QRELS, RUNS, TREC, VEC, VQRELS, answers, measures_sql, qrels, runs, vector_qrels
from sumac.plans.text_queries import _GEN, gens, values
from sumac.runtime import shared_dir, table
from sumac.sources import readers, writers
from sumac.streaming import ingest

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/sumac-{name}-{uuid.uuid4().hex}"


# Labels of two judges: the model's batch and its other sources stand for a human and a judge

_PAIRED = f"{VEC}, {VQRELS}, {_CH}, prd AS (SELECT h.qid, h.doc_id, h.rel AS human, j.rel AS judge FROM human h JOIN judge j USING (qid, doc_id))"


def _paired(spark, d):
    return A.paired(*_channels(spark, d), lossless=True)


_KAPPA = """a AS (SELECT {by} count(*)::DOUBLE AS n, avg((human = judge)::INT) AS po, avg(abs(human - judge) / 3.0) AS off, avg(((human >= 2) = (judge >= 2))::INT) AS po2,
 list_transform([0, 1, 2, 3], lambda g: 0) AS z, count_if(human=0) h0, count_if(human=1) h1, count_if(human=2) h2, count_if(human=3) h3, count_if(judge=0) j0, count_if(judge=1) j1, count_if(judge=2) j2, count_if(judge=3) j3 FROM {src} WHERE human IS NOT NULL AND judge IS NOT NULL {group}),
k AS (SELECT *, (h0*j0 + h1*j1 + h2*j2 + h3*j3) / (n * n) AS pe, ((h0+h1)*(j0+j1) + (h2+h3)*(j2+j3)) / (n * n) AS pe2,
 (h0*(j1 + 2*j2 + 3*j3) + h1*(j0 + j2 + 2*j3) + h2*(2*j0 + j1 + j3) + h3*(3*j0 + 2*j1 + j2)) / 3.0 / (n * n) AS ex FROM a)
SELECT {by} n::BIGINT AS n, round(po, 6) AS agree, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1 END, 6) AS kappa, round(CASE WHEN ex > 0 THEN 1 - off / ex ELSE 1 END, 6) AS kappa_linear, round(po2, 6) AS agree_binary, round(CASE WHEN pe2 < 1 THEN (po2 - pe2) / (1 - pe2) ELSE 1 END, 6) AS kappa_binary FROM k"""


@query(f"WITH {_PAIRED} SELECT qid, doc_id, human, judge FROM prd")
def g9_lossless_pairs(spark, d):
    """Human and judge labels joined one to one; a miss or a repeat is an error."""
    return _paired(spark, d)


@query(f"WITH {_PAIRED}, g AS (SELECT a.x AS human, b.x AS judge FROM (VALUES (0), (1), (2), (3)) a(x) CROSS JOIN (VALUES (0), (1), (2), (3)) b(x)) SELECT g.human, g.judge, count(prd.qid) AS n FROM g LEFT JOIN prd USING (human, judge) GROUP BY ALL")
def h6_confusion(spark, d):
    return A.confusion(_paired(spark, d))


@query(f"WITH {_PAIRED}, {_KAPPA.format(by='', src='prd', group='')}")
def n1_kappa(spark, d):
    return A.kappa(_paired(spark, d))


_SEG = f"{_PAIRED}, sg AS (SELECT p.*, CASE WHEN label % 4 = 0 THEN 'unknown' ELSE 'l' || label END AS segment FROM prd p JOIN vec ON vec.doc_id = p.qid)"


@query(f"WITH {_SEG}, {_KAPPA.format(by='segment,', src='sg', group='GROUP BY segment')}")
def h7_segments(spark, d):
    """Agreement by the query's label; empty ones are unknown."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.when(F.col("label") % 4 != 0, F.concat(F.lit("l"), "label")).alias("kind"))
    return A.segments(_paired(spark, d).join(v, "qid"), "kind")


@query(f"WITH {LAB}, p AS (SELECT coalesce(CAST(year(judged_at) AS VARCHAR), '') AS year, rel FROM lab) SELECT coalesce(year, 'all') AS bucket, count(*) AS n, round(avg(rel), 6) AS mean FROM p GROUP BY ROLLUP (year)")
def h8_rollup(spark, d):
    """Labels overall and per year."""
    from sumac.plans.tables import labels

    y = labels(spark, d).select(F.coalesce(F.year("judged_at").cast("string"), F.lit("")).alias("year"), "rel")
    return y.rollup("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rel"), 6).alias("mean")).select(F.coalesce("year", F.lit("all")).alias("bucket"), "n", "mean")


# System rankings: every run of every query label is a system

_SYS = f"""{RUNS}, {VQRELS}, {_CH}, {measures_sql('runs', 'human', CUTS, True)}, mh AS (SELECT run || '-' || (qid // 100) AS system, round(avg(ndcg_10), 6) AS x FROM m GROUP BY ALL)"""
_SYSJ = measures_sql("runs", "judge", CUTS, True).replace("ideal AS", "idealj AS").replace("JOIN ideal", "JOIN idealj").replace("j0", "k0").replace("j1", "k1").replace("j2", "k2").replace("m AS (", "mjq AS (")
_SYS = f"{_SYS}, {_SYSJ}, mj AS (SELECT run || '-' || (qid // 100) AS system, round(avg(ndcg_10), 6) AS y FROM mjq GROUP BY ALL), sy AS (SELECT system, x, y FROM mh JOIN mj USING (system)), pr AS (SELECT a.x AS xs, b.x AS xt, a.y AS ys, b.y AS yt FROM sy a JOIN sy b ON a.system < b.system)"


def _systems(spark, d):
    human, judge = _channels(spark, d)
    r = runs(spark, d)

    def mean(q, name):
        m = E.measures(r, q, CUTS, True, by=("run",)).select(F.concat_ws("-", "run", F.floor(F.col("qid") / 100).cast("string")).alias("system"), "ndcg_10")
        return m.groupBy("system").agg(F.round(F.avg("ndcg_10"), 6).alias(name))

    return mean(human, "x").join(mean(judge, "y"), "system")


@query(f"WITH {_SYS} SELECT count(*) AS n_pairs, round(sum(sign(xs - xt) * sign(ys - yt)) / nullif(sqrt(count_if(xs <> xt)::DOUBLE * count_if(ys <> yt)), 0), 6) AS tau_b, round(sum(sign(xs - xt) * sign(ys - yt)) / nullif(count_if((xs - xt) * (ys - yt) <> 0), 0)::DOUBLE, 6) AS tau FROM pr")
def n2_kendall(spark, d):
    return A.kendall(_systems(spark, d))


@query(f"WITH {_SYS}, r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM sy) SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r")
def n3_spearman(spark, d):
    return A.spearman(_systems(spark, d))


_TAUS = [(0.9, "validated"), (0.7, "validated"), (0.5, "marginal"), (0.1, "rejected"), (None, "insufficient")]


@query(values(_TAUS, "tau, verdict"))
def n4_verdict(spark, d):
    return spark.createDataFrame([(t[0],) for t in _TAUS], "tau double").select("tau", A.verdict(F.col("tau")).alias("verdict"))


@query(f"WITH {_SYS} SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM sy")
def n5_fit(spark, d):
    return A.fit(_systems(spark, d))


@query(f"WITH {_SYS}, e AS (SELECT f / 100.0::DOUBLE AS f, count(*) AS n_pairs, count_if((xs - xt) * (ys - yt) < 0) AS n_wrong FROM pr CROSS JOIN range(11) t(f) WHERE abs(ys - yt) > f / 100.0::DOUBLE + 1e-9 GROUP BY t.f), g AS (SELECT *, round(n_wrong / n_pairs::DOUBLE, 6) AS error FROM e) SELECT f, n_pairs, n_wrong, error, coalesce(f = (SELECT min(f) FROM g WHERE error < 0.05), false) AS adopted FROM g")
def n6_fuzziness(spark, d):
    return A.fuzziness(_systems(spark, d))


@query(f"WITH {ANS}, {QRELS} SELECT q.qid AS topic_id, q.doc_id AS answer_id, trim(concat_ws(' ', t.title, t.question)) AS question, a.body_text AS answer_text, q.rel AS human_label, (q.rel >= 2)::INTEGER AS human_bin FROM qrels q JOIN topics t ON t.topic_id = q.qid JOIN ans a ON a.id = q.doc_id")
def n7_validation_set(spark, d):
    """Judged pairs with question and answer texts and a binary label."""
    from sumac.functions.columns import binary

    t = table(spark, d, "topics").select(F.col("topic_id").alias("qid"), F.trim(F.concat_ws(" ", "title", "question")).alias("question"))
    a = answers(spark, d).select(F.col("id").alias("doc_id"), F.col("body_text").alias("answer_text"))
    return qrels(spark, d).join(t, "qid").join(a, "doc_id").select(F.col("qid").alias("topic_id"), F.col("doc_id").alias("answer_id"), "question", "answer_text", F.col("rel").alias("human_label"), binary(F.col("rel")).alias("human_bin"))


_REF = f"{ANS}, {QRELS}, rf AS (SELECT qid, doc_id, rel, a.score, body_text, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, a.score DESC, TRY_CAST(doc_id AS BIGINT) DESC, doc_id DESC) AS r FROM qrels q JOIN ans a ON a.id = q.doc_id WHERE rel >= 2)"


@query(f"WITH {_REF} SELECT qid, md5(array_to_string(list(coalesce(body_text, '') ORDER BY r) FILTER (WHERE r <= 5), chr(10) || chr(10) || '---' || chr(10) || chr(10))) AS text_md5, list(doc_id ORDER BY r) FILTER (WHERE r <= 5) AS answer_ids_used, count_if(rel = 3) AS n_high_available, count_if(rel = 3 AND r <= 5) AS n_high_used, bool_or(rel = 2 AND r <= 5) AS fallback_used FROM rf GROUP BY qid")
def n8_references(spark, d):
    """Reference answers of each topic: grade 3 first, filled from grade 2."""
    return R.references(qrels(spark, d), answers(spark, d)).select("qid", F.md5("reference_text").alias("text_md5"), "answer_ids_used", "n_high_available", "n_high_used", "fallback_used")


@query(f"WITH {_REF}, h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r) AS h FROM rf WHERE rel = 3) SELECT qid, 'reference' AS source, r::INTEGER AS position, doc_id FROM rf WHERE r <= 5 UNION ALL SELECT qid, 'disjoint', (h - 5)::INTEGER, doc_id FROM h WHERE h BETWEEN 6 AND 10")
def n9_oracle_contexts(spark, d):
    q, a = qrels(spark, d), answers(spark, d)
    one = lambda disjoint: R.oracle_contexts(q, a, 5, disjoint).select("qid", F.lit("disjoint" if disjoint else "reference").alias("source"), "position", "doc_id")
    return one(False).unionByName(one(True))


@query(f"WITH {ANS}, {QRELS}, r AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS rank FROM qrels) SELECT qid, md5(array_to_string(list(body_text ORDER BY rank), '|')) AS contexts_md5, count(*) AS n FROM r JOIN ans ON id = doc_id WHERE rank <= 5 AND body_text IS NOT NULL GROUP BY qid")
def n10_run_contexts(spark, d):
    """Texts of a run's first five, in its order."""
    run = S.top(qrels(spark, d), ["qid"], [F.desc("rel"), F.asc("doc_id")], None)
    c = R.contexts("run", run.select("qid").distinct(), run=run, answers=answers(spark, d), k=5)
    return c.select("qid", F.md5(F.array_join("contexts", "|")).alias("contexts_md5"), F.size("contexts").cast("bigint").alias("n"))


@query(f"WITH {_GEN} SELECT gen_id, length(coalesce(prompt, '')) || ' characters' AS response FROM g")
def n11_generation_hook(spark, d):
    """A deterministic stand-in for the generator, called in batches on the executors."""
    g = R.generate(gens(spark, d).select("gen_id", "prompt"), lambda ps: [f"{len(p or '')} characters" for p in ps])
    return g.select("gen_id", "response")


@query(f"WITH {_GEN}, {_REF} SELECT gen_id, metric FROM g LEFT JOIN (SELECT DISTINCT qid FROM rf) r ON r.qid = g.topic_id CROSS JOIN (VALUES ('faithfulness', true, false), ('factual_correctness_precision', false, true), ('factual_correctness_recall', false, true)) m(metric, c, f) WHERE (NOT c OR len(contexts) > 0) AND (NOT f OR r.qid IS NOT NULL)")
def n12_metric_tasks(spark, d):
    return R.tasks(gens(spark, d), R.references(qrels(spark, d), answers(spark, d)), R.applicable(spark))


@query(f"WITH {_GEN} SELECT config_name, round(avg(CASE WHEN gen_id % 3 = 0 THEN (completion_tokens % 2) END), 6) AS precision, round(avg(CASE WHEN gen_id % 3 = 1 THEN (completion_tokens % 2) END), 6) AS recall, round(avg(CASE WHEN gen_id % 3 = 2 THEN (completion_tokens % 2) END), 6) AS faithfulness FROM g GROUP BY config_name")
def n13_claim_ratios(spark, d):
    """Supported claims over claims, by side."""
    side = F.element_at(F.array(F.lit("response"), F.lit("reference"), F.lit("context")), (F.col("gen_id") % 3 + 1).cast("int"))
    return R.claim_ratios(gens(spark, d).select("config_name", side.alias("side"), (F.col("completion_tokens") % 2).alias("supported")), ["config_name"])


_P = "the provided context does not contain"


@query(f"WITH {_GEN} SELECT config_name, count_if(coalesce(is_refusal, false) <> starts_with(lower(trim(coalesce(response, ''))), '{_P}')) AS n_flips, count_if(starts_with(lower(trim(coalesce(response, ''))), '{_P}')) AS n_refusals FROM g GROUP BY config_name")
def n14_refusal_correction(spark, d):
    """Stored flags against the corrected rule."""
    r = F.lower(F.trim(F.coalesce("response", F.lit("")))).startswith(_P)
    return gens(spark, d).groupBy("config_name").agg(F.count_if(F.coalesce("is_refusal", F.lit(False)) != r).alias("n_flips"), F.count_if(r).alias("n_refusals"))


_SC = f"{_GEN}, sc AS (SELECT gen_id, topic_id, config_name, is_refusal, CASE WHEN gen_id % 11 = 0 THEN NULL ELSE completion_tokens::DOUBLE / max_new_tokens END AS value FROM g)"


def _scores(spark, d):
    v = F.when(F.col("gen_id") % 11 != 0, F.col("completion_tokens").cast("double") / F.col("max_new_tokens"))
    return gens(spark, d).select("gen_id", "topic_id", "config_name", "is_refusal", v.alias("value"))


@query(f"WITH {_SC}, a AS (SELECT config_name, count(*) AS n, count_if(NOT coalesce(is_refusal, false)) AS n_answered, count(value) AS n_scored, avg(CASE WHEN NOT coalesce(is_refusal, false) THEN value END) AS s, avg(CASE WHEN coalesce(is_refusal, false) THEN 0 ELSE value END) AS c FROM sc GROUP BY ALL) SELECT config_name, n, n_answered, n_scored, round(n_answered / n::DOUBLE, 6) AS coverage, round(s, 6) AS selective, round(c, 6) AS composite, round(abs(s * (n_answered / n::DOUBLE) - c), 6) AS drift FROM a")
def h10_accounting(spark, d):
    """Coverage, selective and composite means, and their drift."""
    return R.accounting(_scores(spark, d), ["config_name"])


@query(f"WITH {_SC} SELECT config_name, round(avg(value), 6) AS mean_all, round(avg(CASE WHEN NOT coalesce(is_refusal, false) THEN value END), 6) AS mean_answering, count(value) AS n_scored, count_if(value IS NULL) AS n_failed FROM sc GROUP BY config_name")
def h9_generation_means(spark, d):
    v = F.col("value")
    return _scores(spark, d).groupBy("config_name").agg(F.round(F.avg(v), 6).alias("mean_all"), F.round(F.avg(F.when(~F.coalesce("is_refusal", F.lit(False)), v)), 6).alias("mean_answering"), F.count(v).alias("n_scored"), F.count_if(v.isNull()).alias("n_failed"))


@query(f"WITH {_SC}, sub AS (SELECT topic_id FROM sc GROUP BY topic_id HAVING count(DISTINCT config_name) >= 3) SELECT config_name, round(avg(value), 6) AS mean_all, round(avg(value) FILTER (WHERE sub.topic_id IS NOT NULL), 6) AS mean_matched, count_if(sub.topic_id IS NOT NULL) AS n_matched, round(avg(value) FILTER (WHERE sub.topic_id IS NOT NULL) - avg(value), 6) AS delta FROM sc LEFT JOIN sub USING (topic_id) GROUP BY config_name")
def h11_matched_subset(spark, d):
    """Means over topics that at least three configurations answer."""
    s = _scores(spark, d)
    sub = s.groupBy("topic_id").agg(F.countDistinct("config_name").alias("k")).filter("k >= 3").select("topic_id")
    return R.matched_subset(s, sub, ["topic_id"], ["config_name"], "value")


@query(f"WITH {_SC} SELECT config_name, round(avg(value), 6) AS mean, (row_number() OVER (ORDER BY round(avg(value), 6) DESC, config_name))::INTEGER AS place FROM sc GROUP BY config_name")
def n15_sweep_table(spark, d):
    """Configurations by their mean; configurations are few."""
    from pyspark.sql import Window

    m = _scores(spark, d).groupBy("config_name").agg(F.round(F.avg("value"), 6).alias("mean"))
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "config_name")))


@query("SELECT topic_id, answer_id, bool_and(NOT parse_ok) AS cacheable_failure FROM judgements GROUP BY ALL")
def n16_cacheable(spark, d):
    """A failure is cached only if every attempt failed to parse."""
    a = table(spark, d, "judgements").groupBy("topic_id", "answer_id").agg(F.collect_list(F.struct((~F.col("parse_ok")).alias("is_validation"))).alias("attempts"))  # attempts at one pair
    return a.select("topic_id", "answer_id", R.cacheable(F.col("attempts")).alias("cacheable_failure"))


# Sources and sinks: whole tables written in a format and read back

_POSTS = """<?xml version="1.0" encoding="utf-8"?>
<posts>
  <row Id="1" PostTypeId="1" Title="A title" Tags="&lt;algebra&gt;&lt;rings&gt;" Score="3" AcceptedAnswerId="2" Body="&lt;p&gt;Why is &lt;span class=&quot;math-container&quot; id=&quot;10&quot;&gt;$x^2$&lt;/span&gt; even?&lt;/p&gt;" />
  <row Id="2" PostTypeId="2" ParentId="1" Score="5" Body="&lt;p&gt;Because &lt;span class=&quot;math-container&quot; id=&quot;11&quot;&gt;$x$&lt;/span&gt; is.&lt;/p&gt;" />
  <row Id="3" PostTypeId="4" Score="0" Body="wiki" />
</posts>
"""


def _text_file(spark, name, text):
    path = scratch(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path, lineSep="\n")
    return path


@query(values([("answer", "2", "1", 5, "Because $x$ is.", "11"), ("question", "1", "2", 3, "Why is $x^2$ even?", "10")], "kind, id, other_id, score, body_text, formula_id"))
def a1_posts_xml(spark, d):
    """Posts split into answers and questions, bodies with their formulas."""
    a, q = readers.split_posts(readers.posts_xml(spark, _text_file(spark, "posts", _POSTS)))
    one = lambda df, kind, other: df.select(F.lit(kind).alias("kind"), "id", F.col(other).alias("other_id"), "score", "body_text", F.get("formulas.formula_id", F.lit(0)).alias("formula_id"))
    return one(a, "answer", "parent_id").unionByName(one(q, "question", "accepted_answer_id"))


_TOPICS = """<Topics><Topic number="A.301"><Title>T</Title><Question>Q</Question><Tags>a, b</Tags></Topic><Topic number="A.302"><Title>U</Title><Question>R</Question><Tags></Tags></Topic></Topics>"""


@query(values([("A.301", "T", "Q"), ("A.302", "U", "R")], "topic_id, title, question"))
def a3_topics_xml(spark, d):
    return readers.topics_xml(spark, _text_file(spark, "topics", _TOPICS)).select("topic_id", "title", "question")


_TOPICS2 = """<Topics><Topic number="B.1"><Latex>x^2</Latex><Formula_Id>q_1</Formula_Id></Topic><Topic number="B.2"><Latex></Latex><Formula_Id>q_2</Formula_Id></Topic></Topics>"""


@query(values([("B.1", "x^2", "q_1")], "topic_id, query_latex, source_formula_id"))
def a4_formula_topics(spark, d):
    return readers.formula_topics_xml(spark, _text_file(spark, "ftopics", _TOPICS2))


@query("SELECT id, max(score) AS score, count(*) AS n FROM questions GROUP BY id")
def a5_jsonl(spark, d):
    """Questions written as JSON lines and read back with a schema."""
    path = scratch(spark, "jsonl")
    writers.json_lines(table(spark, d, "questions"), path)
    return readers.jsonl(spark, path, "id string, score int").groupBy("id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(source, '') AS source, count(*) AS n, max(doc_id) AS last FROM documents GROUP BY ALL")
def a6_numbered_tsv(spark, d):
    """A table as TSV shards, two columns of it read."""
    path = scratch(spark, "tsv")
    table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_chars").write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    t = readers.numbered_tsv(spark, path, columns=["doc_id", "source"])
    return t.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id").cast("bigint")).alias("last"))


@query(f"WITH {QRELS} SELECT qid, doc_id, rel FROM qrels")
def a8_qrels_file(spark, d):
    """Judgements written in natural order and read back."""
    path = scratch(spark, "qrels")
    writers.write_qrels(qrels(spark, d), path)
    return readers.qrels(spark, path)


@query(f"WITH {RUNS} SELECT qid::VARCHAR AS qid, doc_id::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id))::INTEGER AS rank, score FROM runs WHERE run = 'c'")
def a9_run_file(spark, d):
    """A run written with six decimals and read back."""
    path = scratch(spark, "run")
    r = runs(spark, d).filter("run = 'c'")
    writers.write_run(S.top(r, ["qid"], [F.desc("score"), F.asc("doc_id")], None), path, "c")
    return readers.run(spark, path).select("qid", "doc_id", "rank", "score")


@query(values([("q1", "d1", 1, 0.5), ("q1", "d2", 2, 0.25), ("q2", "d3", 1, 0.125)], "qid, doc_id, rank, score"))
def a10_run_layouts(spark, d):
    """Lines with and without Q0 told apart; short lines skipped."""
    text = "q1 Q0 d1 1 0.5 r\nq1\td2\t2\t0.25\tr\nq2 q0 d3 1 0.125 r\nbroken line"
    return readers.run(spark, _text_file(spark, "layouts", text)).select("qid", "doc_id", "rank", "score")


@query(values([("B.1", "f1", "p1", 1, 0.5), ("B.1", "f2", "p2", 2, 0.25)], "topic, formula_id, post_id, rank, score"))
def a11_instance_run(spark, d):
    return readers.instance_run(spark, _text_file(spark, "inst", "B.1\tf1\tp1\t1\t0.5\tr\nB.1\tf2\tp2\t2\t0.25\tr"))


@query(values([("A.301", 0.5), ("A.302", None), ("A.303", None)], "topic_id, faithfulness"))
def a12_audit_csv(spark, d):
    """Every spelling of null is null."""
    t = readers.audit_csv(spark, _text_file(spark, "audit", "topic_id,faithfulness\nA.301,0.5\nA.302,null\nA.303,None"))
    return R.parsed_scores(t, ["faithfulness"])


@query(values([("x^2", "y^2", "3")], "query_equation, candidate_equation, relevance"))
def a13_golden_pairs(spark, d):
    return readers.golden_pairs(spark, _text_file(spark, "golden", "dataset\tquery_equation\tcandidate_id\tcandidate_equation\trelevance\ng\tx^2\tc\ty^2\t3")).select("query_equation", "candidate_equation", "relevance")


@query(f"WITH {RUNS} SELECT concat_ws(chr(9), qid, 'Q0', doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id), printf('%.6f', score), 'c') AS line FROM runs WHERE run = 'c'")
def b2_run_lines(spark, d):
    r = S.top(runs(spark, d).filter("run = 'c'"), ["qid"], [F.desc("score"), F.asc("doc_id")], None)
    return writers.run_lines(r, "c").select(F.col("value").alias("line"))


@query(f"WITH {QRELS} SELECT concat_ws(chr(9), qid, '0', doc_id, rel) AS line FROM qrels")
def b4_qrel_lines(spark, d):
    return writers.qrel_lines(qrels(spark, d)).select(F.col("value").alias("line"))


@query(f"WITH {RUNS}, {VQRELS}, {measures_sql('runs', 'vqrels', CUTS, False)}, x AS (SELECT run, avg(ndcg_10) AS n, avg(map) AS m FROM m GROUP BY run) SELECT run, printf('%.4f', round(n, 6)) AS ndcg_10, CASE WHEN run = 'b' THEN 'N/A' ELSE printf('%.4f', round(m, 6)) END AS map FROM x")
def b5_wide_metrics(spark, d):
    """Metrics of all runs in one table, N/A where a run has none."""
    m = E.long_form(E.macro(_measured(spark, d, False), ["ndcg_10", "map"], by=("run",)), ["run"], ["ndcg_10", "map"])
    return writers.wide_metrics(m.filter("NOT (run = 'b' AND metric = 'map')"), ["map", "ndcg_10"])


@query("SELECT DISTINCT id, coalesce(title, '') AS title, '' AS parent_id FROM questions UNION ALL SELECT DISTINCT id, '', coalesce(parent_id, '') FROM answers")
def b6_mixed_rows(spark, d):
    return writers.mixed_rows([table(spark, d, "questions").select("id", "title").distinct(), table(spark, d, "answers").select("id", "parent_id").distinct()])


@query("SELECT year(judged_at)::INTEGER AS year, count(*) AS n FROM judgements WHERE judged_at IS NOT NULL GROUP BY ALL")
def b7_by_year(spark, d):
    """Judgements in one folder a year."""
    path = scratch(spark, "years")
    writers.write_by_year(table(spark, d, "judgements").filter("judged_at IS NOT NULL").select("judgement_id", F.year("judged_at").alias("year")), path)
    return spark.read.schema("judgement_id bigint, year int").json(path).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT token, replace(replace(replace(token, '\\', '\\\\'), chr(10), '\\n'), chr(9), '\\t') AS escaped FROM (VALUES ('a' || chr(10) || 'b'), ('a' || chr(9) || 'b'), ('a\\nb')) AS t(token)")
def b8_escaped_tokens(spark, d):
    """Escapes that keep a token with a backslash apart from a line break."""
    df = spark.createDataFrame([("a\nb",), ("a\tb",), ("a\\nb",)], "token string")
    return df.select("token", writers.escaped(F.col("token")).alias("escaped"))


@query("SELECT count(*) AS n_files, sha256('one' || chr(10)) AS sha FROM range(1)")
def b9_checksums(spark, d):
    path = _text_file(spark, "sums", "one")
    return writers.checksums(spark, path).filter("file_name LIKE 'part-%'").agg(F.count(F.lit(1)).alias("n_files"), F.max("sha256").alias("sha"))


@query(values([("r1", "map", 0.5), ("r1", "ndcg", 0.25)], "run_id, metric, value"))
def b10_tracker(spark, d):
    """A resumed run is not doubled."""
    path = scratch(spark, "track")
    m = spark.createDataFrame([("map", 0.5), ("ndcg", 0.25)], "metric string, value double")
    writers.track(m.filter("metric = 'map'"), path, "r1")
    writers.track(m, path, "r1")
    return spark.read.parquet(path).select("run_id", "metric", "value")


@query("SELECT 'questions' AS name, count(*) AS n FROM (DESCRIBE questions) UNION ALL SELECT 'answers', count(*) FROM (DESCRIBE answers)")
def b13_schema_report(spark, d):
    rows = writers.schema_report({n: table(spark, d, n) for n in ("questions", "answers")})
    return spark.createDataFrame(rows, "name string, column string, type string").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def o1_resumable_ingest(spark, d):
    """Files ingested once each over two starts."""
    src, sink, mark = (scratch(spark, x) for x in ("src", "sink", "mark"))
    ev = table(spark, d, "events").select("event_id", "event_type")
    ev.filter("event_id % 2 = 0").write.mode("append").parquet(src)
    ingest.ingest_files(spark, src, "event_id bigint, event_type string", sink, mark, 2)
    ev.filter("event_id % 2 = 1").write.mode("append").parquet(src)
    ingest.ingest_files(spark, src, "event_id bigint, event_type string", sink, mark, 2)
    ingest.ingest_files(spark, src, "event_id bigint, event_type string", sink, mark, 2)
    return spark.read.parquet(sink).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT (topic_id, answer_id)) AS n_keys FROM (SELECT DISTINCT topic_id, answer_id FROM judgements)")
def o5_cache_through(spark, d):
    """A write-through cache keeps the first write of each key over several chunks."""
    src, cache, mark = (scratch(spark, x) for x in ("csrc", "cache", "cmark"))
    j = table(spark, d, "judgements").select("topic_id", "answer_id", "label")
    j.repartition(4).write.parquet(src)
    ingest.submit_chunks(spark, src, "topic_id string, answer_id string, label int", mark, ingest.cache_through(cache, ["topic_id", "answer_id"]), 2)
    return spark.read.parquet(cache).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("topic_id", "answer_id").alias("n_keys"))


def judged_runs(spark: SparkSession, d: str) -> DataFrame:
    return E.judged_only(runs(spark, d), vector_qrels(spark, d))


QUERIES = Q
_ = TREC
