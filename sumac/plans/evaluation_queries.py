"""Queries of search, joins, aggregates, ranking, sets, evaluation and fusion, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumac.functions import columns as C
from sumac.operators import embedding as V
from sumac.operators import evaluation as E
from sumac.operators import fusion as M
from sumac.operators import search as S
from sumac.plans.tables import ANS, LAB, QRELS, RUNS, TOP, TREC, VEC, VQRELS, answers, labels, measures_sql, qrels, runs, topics, vector_qrels, vector_queries, vectors
from sumac.runtime import broadcast_if_small, cut, shared_dir, table
from sumac.sources import readers, writers

#: Tokens of a formula in LaTeX.
LATEX_TOKEN = r"\\[A-Za-z]+|[A-Za-z]|[0-9]+|[^\sA-Za-z0-9\\$]"
CUTS = (5, 10, 20, 100, 1000)
NAMES = [f"{m}_{k}" for k in CUTS for m in ("ndcg", "p", "recall", "map")] + ["map", "bpref"]
Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Sparse search

_BM25 = r"""docs AS (SELECT id AS doc_id, list_filter(regexp_extract_all(lower(body_text), '[\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM ans WHERE body_text IS NOT NULL),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(w) AS term, len(w) AS dl FROM docs) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term), tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM docs WHERE len(w) > 0),
qt AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM top),
bm AS (SELECT qid, doc_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl)))), 6) AS score FROM post JOIN qt USING (term) JOIN freq USING (term) CROSS JOIN tot GROUP BY ALL),
bmr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 1000)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).filter("body_text IS NOT NULL").select(F.col("id").alias("doc_id"), F.col("body_text").alias("text"))


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return S.bm25(S.TextIndex(_docs(spark, d)), topics(spark, d), 1000)


@query(f"WITH {ANS}, {TOP}, {_BM25} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf)::INTEGER AS max_tf FROM post GROUP BY term")
def f1_sparse_index(spark, d):
    """Postings of all answers in a stored index, which a second build with other documents leaves as it is."""
    path = f"{shared_dir(spark)}/sumac-text-{uuid.uuid4().hex}"
    S.build_text_index(_docs(spark, d), path)
    index = S.build_text_index(_docs(spark, d).filter("false"), path)
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


@query(f"WITH {ANS}, {TOP}, {_BM25} SELECT qid, doc_id, rank::INTEGER AS rank, score FROM bmr")
def f2_bm25(spark, d):
    return _bm25(spark, d).select("qid", "doc_id", "rank", "score")


@query(f"WITH {ANS}, {TOP}, {QRELS}, {_BM25}, {measures_sql('bmr0', 'qrels', (5, 10, 20), False, 'qid')}".replace("ideal AS", "bmr0 AS (SELECT qid, doc_id, score FROM bmr), ideal AS", 1) + ", h AS (SELECT qid, round(avg(CASE WHEN q.doc_id IS NULL THEN 1.0 ELSE 0 END), 6) AS hole_rate FROM bmr LEFT JOIN qrels q USING (qid, doc_id) WHERE bmr.rank <= 10 GROUP BY qid) SELECT qid, ndcg_10, p_10, map, bpref, hole_rate FROM m JOIN h USING (qid)")
def f2_bm25_eval(spark, d):
    """BM25 of all topics over all answers, judged: nDCG, precision, MAP, bpref and holes at 10."""
    run, q = cut(_bm25(spark, d)), qrels(spark, d)
    m = E.measures(run.select("qid", "doc_id", "score"), q, (5, 10, 20))
    return m.select("qid", "ndcg_10", "p_10", "map", "bpref").join(E.hole_rate(run, q, 10, ["qid"]), "qid")


# Vector search


@query(f"WITH {VEC} SELECT qid, doc_id, rank::INTEGER AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT qid, doc_id, round(list_inner_product(q, v), 6) AS score FROM vec CROSS JOIN vq)) WHERE rank <= 10")
def f4_exact_search(spark, d):
    return S.exact_search(vectors(spark, d), vector_queries(spark, d), 10).select("qid", "doc_id", "rank", "score")


_L2 = f"WITH {VEC} SELECT qid, doc_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT qid, doc_id, round(-list_sum(list_transform(list_zip(q, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS score FROM vec CROSS JOIN vq)) WHERE rank <= 10"


@query(_L2)
def f5_cells_exact(spark, d):
    """Cells with every cell probed: the exact result."""
    return S.cell_search(vectors(spark, d), vector_queries(spark, d), 10, cells=16, probes=16).select("qid", "doc_id", "rank")


_BOUNDS = [("half", 12, 0.9), ("half", 16, 0.99), ("byte", 12, 0.85), ("byte", 16, 0.9)]


def recall(spark, vectors_, queries_, cells, bounds):
    """store, probes, reached: whether the recall at 10 against the exact search is at least its bound; each index is built once."""
    exact = cut(S.exact_search(vectors_, queries_, 10, "l2").select("qid", "doc_id"))
    n, out, built = exact.count(), None, {}
    for store, probes, least in bounds:
        if store not in built:
            built[store] = S.build_cell_index(vectors_, f"{shared_dir(spark)}/sumac-cells-{uuid.uuid4().hex}", cells, store)
        hit = built[store].search(queries_, 10, probes).select("qid", "doc_id").join(exact, ["qid", "doc_id"]).agg(F.count(F.lit(1)).alias("k"))
        one = hit.select(F.lit(store).alias("store"), F.lit(probes).alias("probes"), (F.col("k") >= least * n).alias("reached"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, true)" for a, b, _ in _BOUNDS) + ") AS t(store, probes, reached)")
def f6_cells_recall(spark, d):
    """Recall at 10 of cells in half precision and in bytes, against the exact search; the index holds every vector."""
    return recall(spark, vectors(spark, d), vector_queries(spark, d), 16, _BOUNDS)


_FORM = rf"""tf AS (SELECT topic_id AS qid, unnest(formulas) AS f FROM topics), tq AS (SELECT qid, f.formula_id AS fid, f.latex AS latex FROM tf),
af AS (SELECT id AS doc_id, unnest(formulas) AS f FROM ans), owner AS (SELECT DISTINCT f.formula_id AS formula_id, doc_id FROM af), cf AS (SELECT f.formula_id AS formula_id, min(f.latex) AS latex FROM af GROUP BY 1),
fm AS (SELECT DISTINCT latex FROM (SELECT latex FROM tq UNION ALL SELECT latex FROM cf)),
tk AS (SELECT latex, unnest(regexp_extract_all(latex, '{LATEX_TOKEN}')) AS token FROM fm),
hv AS (SELECT latex, ('0x' || substring(md5(token), 1, 4))::BIGINT % 64 AS i, sum(CASE WHEN ('0x' || substring(md5(token), 5, 1))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END) AS x FROM tk WHERE token <> '' GROUP BY ALL),
nv AS (SELECT latex, sqrt(sum(x * x)) AS n FROM hv GROUP BY latex HAVING sum(x * x) > 0),
dots AS (SELECT a.latex AS la, b.latex AS lb, sum(a.x * b.x) AS s FROM hv a JOIN hv b USING (i) WHERE a.latex IN (SELECT latex FROM tq) AND b.latex IN (SELECT latex FROM cf) GROUP BY ALL),
sims AS (SELECT qid, fid, formula_id, round(coalesce(s, 0) / (x.n * y.n), 6) AS score FROM tq JOIN nv x ON x.latex = tq.latex CROSS JOIN (SELECT cf.*, nv.n FROM cf JOIN nv USING (latex)) y LEFT JOIN dots ON la = tq.latex AND lb = y.latex),
hit AS (SELECT qid, fid, formula_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, fid ORDER BY score DESC, formula_id) AS rank FROM sims) JOIN owner USING (formula_id) WHERE rank <= 200)"""


def _formula_hits(spark, d):
    """Hits of all topic formulas among the formulas of all answers, by vectors of hashed tokens."""
    t = table(spark, d, "topics").select(F.col("topic_id").alias("qid"), F.explode("formulas").alias("f")).select("qid", F.col("f.formula_id").alias("fid"), F.col("f.latex").alias("latex"))
    a = answers(spark, d, "formulas").select(F.col("id").alias("doc_id"), F.explode("formulas").alias("f")).select("doc_id", F.col("f.formula_id").alias("formula_id"), F.col("f.latex").alias("latex"))
    c = a.groupBy("formula_id").agg(F.min("latex").alias("latex"))
    words = F.filter(F.regexp_extract_all("latex", F.lit(LATEX_TOKEN), F.lit(0)), lambda x: x != "")
    return S.formula_search(c, t, a, V.hashed_units(words, 64), 200)


@query(f"WITH {ANS}, {_FORM} SELECT qid, fid, formula_id, doc_id, rank::INTEGER AS rank FROM hit")
def f10_formula_search(spark, d):
    """All formulas of all topics in one batch, each with its list of formulas and answers."""
    return _formula_hits(spark, d).select("qid", "fid", "formula_id", "doc_id", "rank")


@query(f"WITH {ANS}, {_FORM}, s AS (SELECT qid, doc_id, round(sum(1.0 / (rank + 60)), 9) AS score FROM hit GROUP BY ALL) SELECT qid, doc_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 1000")
def f11_merge_hits(spark, d):
    """Every hit of every formula of a topic, merged by answer."""
    return S.merge_formula_hits(_formula_hits(spark, d)).select("qid", "doc_id", "rank")


_VIS = "inst AS (SELECT qid, CAST(doc_id AS VARCHAR) AS formula_id, score FROM runs WHERE run = 'c'), vis AS (SELECT CAST(doc_id AS VARCHAR) AS formula_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'v' || CAST(doc_id // 3 AS VARCHAR) END AS visual_id, CAST(doc_id // 10 AS VARCHAR) AS post_id FROM vec), own AS (SELECT qid, CAST(qid // 10 AS VARCHAR) AS own_post, 'v' || CAST(qid // 3 AS VARCHAR) AS own_visual FROM vq)"


def _visual(spark, d):
    i = F.col("doc_id")
    vis = vectors(spark, d).select(i.cast("string").alias("formula_id"), F.when(i % 7 != 0, F.concat(F.lit("v"), F.floor(i / 3).cast("string"))).alias("visual_id"), F.floor(i / 10).cast("string").alias("post_id"))
    own = vector_queries(spark, d).select("qid", F.floor(F.col("qid") / 10).cast("string").alias("post_id"), F.concat(F.lit("v"), F.floor(F.col("qid") / 3).cast("string")).alias("visual_id"))
    inst = runs(spark, d).filter("run = 'c'").select("qid", i.cast("string").alias("formula_id"), "score")
    return inst, vis, own


@query(f"WITH {RUNS}, {_VIS}, b AS (SELECT qid, visual_id, max(score) AS score FROM inst JOIN vis USING (formula_id) JOIN own USING (qid) WHERE visual_id IS NOT NULL AND post_id <> own_post AND visual_id <> own_visual GROUP BY ALL) SELECT qid, visual_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, visual_id) AS rank FROM b) WHERE rank <= 1000")
def f13_exclude_collapse(spark, d):
    return S.exclude_and_collapse(*_visual(spark, d)).select("qid", "visual_id", "score", "rank")


@query(f"WITH {RUNS}, {_VIS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, formula_id) AS rank FROM inst), b AS (SELECT qid, visual_id, min(rank) AS f FROM r JOIN vis USING (formula_id) WHERE visual_id IS NOT NULL GROUP BY ALL) SELECT qid, visual_id, (row_number() OVER (PARTITION BY qid ORDER BY f, visual_id))::INTEGER AS rank FROM b")
def f14_collapse_run(spark, d):
    inst, vis, _ = _visual(spark, d)
    return S.collapse_run(S.top(inst, ["qid"], [F.desc("score"), F.asc("formula_id")], None), vis)


@query(f"WITH {VEC}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT qid, doc_id, label, q_label, round(list_inner_product(q, v), 6) AS score FROM vec CROSS JOIN vq)) SELECT q_label AS label, count_if(label = q_label) AS n_same, count(*) AS n FROM r WHERE rank <= 10 GROUP BY q_label")
def f15_domain_hits(spark, d):
    """Neighbours of the query's own label among the first ten."""
    hits = S.exact_search(vectors(spark, d), vector_queries(spark, d), 10).join(vectors(spark, d).select("doc_id", "label"), "doc_id").join(vector_queries(spark, d).select("qid", "q_label"), "qid")
    return hits.groupBy(F.col("q_label").alias("label")).agg(F.count_if(F.col("label") == F.col("q_label")).alias("n_same"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {ANS}, {QRELS} SELECT qid, doc_id, rel, body_text FROM (SELECT q.*, body_text, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS r FROM qrels q JOIN ans ON id = doc_id) WHERE r <= 5")
def f16_top_judged(spark, d):
    a = answers(spark, d).select(F.col("id").alias("doc_id"), "body_text")
    return S.top(qrels(spark, d).join(a, "doc_id"), ["qid"], [F.desc("rel"), F.asc("doc_id")], 5).select("qid", "doc_id", "rel", "body_text")


# Joins


@query(f"WITH {RUNS}, {VQRELS} SELECT run, qid, doc_id, score FROM runs SEMI JOIN vqrels USING (qid, doc_id)")
def g1_judged_only(spark, d):
    return E.judged_only(runs(spark, d), vector_qrels(spark, d)).select("run", "qid", "doc_id", "score")


@query(f"WITH {RUNS}, {VQRELS}, {TREC} SELECT run, qid, doc_id, rank::INTEGER AS rank FROM trec ANTI JOIN vqrels USING (qid, doc_id) WHERE rank <= 20")
def g2_holes(spark, d):
    return E.holes(E.trec_order(runs(spark, d), ["run", "qid"]), vector_qrels(spark, d), 20).select("run", "qid", "doc_id", "rank")


@query(f"WITH {RUNS}, {VQRELS} SELECT run, qid, count(*) AS n, sum(coalesce(rel, 0))::BIGINT AS gain FROM runs LEFT JOIN vqrels USING (qid, doc_id) GROUP BY ALL")
def g3_unjudged_as_zero(spark, d):
    return runs(spark, d).join(vector_qrels(spark, d), ["qid", "doc_id"], "left").groupBy("run", "qid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("rel", F.lit(0))).alias("gain"))


@query(f"WITH {ANS} SELECT q.id AS question_id, f.fid AS formula_id, f.latex, count(DISTINCT a.id) AS n_answers FROM (SELECT DISTINCT id, unnest(formulas).formula_id AS fid, unnest(formulas).latex AS latex FROM questions) f JOIN (SELECT DISTINCT id FROM questions) q USING (id) JOIN ans a ON a.parent_id = q.id GROUP BY ALL")
def g4_three_way(spark, d):
    """Formulas of questions, their questions and the questions' answers."""
    q = table(spark, d, "questions")
    f = q.select("id", F.explode("formulas").alias("f")).select("id", F.col("f.formula_id").alias("formula_id"), F.col("f.latex").alias("latex")).distinct()
    a = answers(spark, d).select(F.col("id").alias("answer_id"), F.col("parent_id").alias("id"))
    return f.join(q.select("id").distinct(), "id").join(a, "id").groupBy(F.col("id").alias("question_id"), "formula_id", "latex").agg(F.countDistinct("answer_id").alias("n_answers"))


@query("SELECT formula_id, max(id) AS answer_id, count(DISTINCT id) AS n_answers FROM (SELECT id, unnest(formulas).formula_id AS formula_id FROM answers) GROUP BY formula_id")
def g5_formula_owner(spark, d):
    """The answer of each formula id; of several the last by id."""
    f = table(spark, d, "answers").select("id", F.explode("formulas").alias("f")).select("id", F.col("f.formula_id").alias("formula_id"))
    return f.groupBy("formula_id").agg(F.max("id").alias("answer_id"), F.countDistinct("id").alias("n_answers"))


@query(f"WITH {ANS}, {QRELS} SELECT id, length(body_text)::INTEGER AS n_chars FROM ans SEMI JOIN (SELECT DISTINCT doc_id AS id FROM qrels) USING (id)")
def g7_needed_texts(spark, d):
    return answers(spark, d).join(qrels(spark, d).select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").select("id", F.length("body_text").alias("n_chars"))


@query(f"WITH {ANS}, {QRELS}, r AS (SELECT qid, doc_id, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS rank FROM qrels) SELECT qid, list(doc_id ORDER BY rank) AS ids FROM (SELECT r.* FROM r JOIN ans ON id = doc_id WHERE rank <= 10) GROUP BY qid")
def g10_ranked_lookup(spark, d):
    """Answers looked up in rank order, missing ones skipped."""
    r = S.top(qrels(spark, d), ["qid"], [F.desc("rel"), F.asc("doc_id")], 10)
    j = r.join(answers(spark, d).select(F.col("id").alias("doc_id")), "doc_id")
    return j.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x.doc_id).alias("ids"))


@query(f"WITH {RUNS}, n AS (SELECT run, avg(score) AS s FROM runs GROUP BY run) SELECT x.run AS a, y.run AS b, x.s > y.s AS a_wins FROM n x JOIN n y ON x.run < y.run")
def g12_system_pairs(spark, d):
    n = runs(spark, d).groupBy("run").agg(F.avg("score").alias("s"))
    a, b = n.select(F.col("run").alias("a"), F.col("s").alias("x")), n.select(F.col("run").alias("b"), F.col("s").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.col("x") > F.col("y")).alias("a_wins"))


@query("WITH g AS (SELECT DISTINCT gen_id, topic_id, config_name FROM generations), floor AS (SELECT topic_id, min(gen_id) AS floor_id FROM g WHERE config_name LIKE 'c0%' GROUP BY ALL) SELECT config_name, count(*) AS n, count(DISTINCT g.topic_id) AS n_topics FROM g JOIN floor USING (topic_id) GROUP BY config_name")
def g11_floor_join(spark, d):
    """Answers of topics that the configuration without contexts answers too."""
    g = table(spark, d, "generations").select("gen_id", "topic_id", "config_name").distinct()
    floor = g.filter("config_name LIKE 'c0%'").groupBy("topic_id").agg(F.min("gen_id").alias("floor_id"))
    return g.join(floor, "topic_id").groupBy("config_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("topic_id").alias("n_topics"))


@query("WITH p AS (SELECT DISTINCT topic_id, answer_id FROM judge_pairs), c AS (SELECT DISTINCT topic_id, answer_id FROM judgements WHERE source = 'cache') SELECT (c.topic_id IS NOT NULL) AS cached, count(*) AS n FROM p LEFT JOIN c USING (topic_id, answer_id) GROUP BY ALL")
def g15_cache_split(spark, d):
    from sumac.streaming.ingest import split_cached

    keys = ["topic_id", "answer_id"]
    hit, rest = split_cached(table(spark, d, "judge_pairs").select(*keys).distinct(), table(spark, d, "judgements").filter("source = 'cache'").select(*keys).distinct(), keys)
    both = hit.select(F.lit(True).alias("cached")).unionByName(rest.select(F.lit(False).alias("cached")))
    return both.groupBy("cached").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT topic_id, answer_id FROM judge_pairs ANTI JOIN (SELECT DISTINCT topic_id, answer_id FROM judgements) j USING (topic_id, answer_id)")
def g16_subset_guard(spark, d):
    """Pairs never judged: must be empty for a lossless subset."""
    from sumac.operators.rag import inside

    keys = ["topic_id", "answer_id"]
    return inside(table(spark, d, "judge_pairs").select(*keys).distinct(), table(spark, d, "judgements").select(*keys).distinct(), keys)


# Evaluation

_M = f"WITH {RUNS}, {VQRELS}, {measures_sql('runs', 'vqrels', CUTS, False)}"
_MP = f"WITH {RUNS}, {VQRELS}, {measures_sql('runs', 'vqrels', CUTS, True)}"


def _measured(spark, d, prime):
    return E.measures(runs(spark, d), vector_qrels(spark, d), CUTS, prime, by=("run",))


@query(f"{_M} SELECT run, qid, {', '.join(NAMES)} FROM m")
def l1_measures(spark, d):
    """nDCG, precision, recall, MAP at all cutoffs, MAP and bpref of each query and run."""
    return _measured(spark, d, False).select("run", "qid", *NAMES)


@query(f"{_MP} SELECT run, qid, {', '.join(NAMES)} FROM m")
def l5_prime_measures(spark, d):
    return _measured(spark, d, True).select("run", "qid", *NAMES)


_D20 = f"WITH {RUNS}, {VQRELS}, {TREC}, r20 AS (SELECT run, qid, doc_id, score FROM trec WHERE rank <= 20), {measures_sql('r20', 'vqrels', (5, 10, 20), True)}"


@query(f"{_D20} SELECT run, qid, ndcg_10, p_10, ndcg_20, p_20 FROM m")
def l6_pooled_protocol(spark, d):
    """The top 20 first, then judged documents only."""
    return E.measures(runs(spark, d), vector_qrels(spark, d), (5, 10, 20), True, 20, ("run",)).select("run", "qid", "ndcg_10", "p_10", "ndcg_20", "p_20")


@query(f"WITH {VEC}, {VQRELS} SELECT qid, round(sum(CASE WHEN i <= 10 THEN rel / log2(i + 1.0) ELSE 0 END), 6) AS idcg_10, count_if(rel >= 2) AS n_rel FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS i FROM vqrels) GROUP BY qid")
def l7_ideal(spark, d):
    return E.ideal(vector_qrels(spark, d), (10,)).select("qid", F.round("idcg_10", 6).alias("idcg_10"), "n_rel")


@query(f"WITH {RUNS}, {VQRELS}, {TREC} SELECT run, qid, round(avg(CASE WHEN rel IS NULL THEN 1.0 ELSE 0 END), 6) AS hole_rate FROM trec LEFT JOIN vqrels USING (qid, doc_id) WHERE rank <= 10 GROUP BY ALL")
def l8_hole_rate(spark, d):
    return E.hole_rate(E.trec_order(runs(spark, d), ["run", "qid"]), vector_qrels(spark, d), 10, ["run", "qid"])


_CH = "human AS (SELECT * FROM vqrels WHERE (qid + doc_id) % 4 <> 1), judge AS (SELECT qid, doc_id, CAST(greatest(rel - (doc_id % 3 = 0)::INTEGER, 0) AS INTEGER) AS rel FROM vqrels)"


def _channels(spark, d):
    """Human labels for three quarters of the pairs, and a judge's for all."""
    v = vector_qrels(spark, d)
    return v.filter("(qid + doc_id) % 4 <> 1"), v.select("qid", "doc_id", F.greatest(F.col("rel") - (F.col("doc_id") % 3 == 0).cast("int"), F.lit(0)).alias("rel"))


@query(f"WITH {RUNS}, {VQRELS}, {_CH}, filled AS (SELECT * FROM human UNION ALL SELECT * FROM judge ANTI JOIN human USING (qid, doc_id)), {measures_sql('runs', 'filled', (5, 10, 20), True)} SELECT run, qid, ndcg_10, p_10, map FROM m")
def l9_filled_channel(spark, d):
    """Human labels, holes filled by the judge."""
    human, judge = _channels(spark, d)
    return E.measures(runs(spark, d), E.overlay(human, judge), (5, 10, 20), True, by=("run",)).select("run", "qid", "ndcg_10", "p_10", "map")


@query(f"WITH {RUNS}, {VQRELS}, {TREC}, {_CH} SELECT run, t.qid, t.doc_id, rank::INTEGER AS rank, h.rel AS human_label, j.rel AS llm_label, h.rel IS NULL AS is_hole FROM trec t LEFT JOIN human h USING (qid, doc_id) LEFT JOIN judge j USING (qid, doc_id) WHERE rank <= 20")
def l10_audit(spark, d):
    return E.audit(E.trec_order(runs(spark, d), ["run", "qid"]), *_channels(spark, d)).select("run", "qid", "doc_id", "rank", "human_label", "llm_label", "is_hole")


@query(f"WITH {RUNS}, {TREC} SELECT qid, doc_id, count(DISTINCT run) AS n_runs FROM trec WHERE rank <= 20 GROUP BY ALL")
def l11_pool(spark, d):
    return E.pool(runs(spark, d), 20)


@query(f"{_M}, mean AS (SELECT round(avg(ndcg_10), 6) AS ndcg_10, round(avg(map), 6) AS map, round(avg(p_10), 6) AS p_10 FROM m WHERE run = 'c'), v AS (UNPIVOT mean ON ndcg_10, map, p_10 INTO NAME metric VALUE value) SELECT metric, value, CASE WHEN metric = 'map' THEN round(value, 3) + 0.002 ELSE round(value, 3) END AS published, metric <> 'map' AS ok FROM v")
def l12_calibration(spark, d):
    """Means against numbers published with three decimals: those of the run as a file gives it, one of them misprinted."""
    names = ["ndcg_10", "map", "p_10"]
    ours = E.long_form(E.macro(_measured(spark, d, False).filter("run = 'c'"), names), [], names)
    run_path, judged_path = (f"{shared_dir(spark)}/sumac-{x}-{uuid.uuid4().hex}" for x in ("calrun", "calqrels"))
    writers.write_run(M.ranked(runs(spark, d).filter("run = 'c'")), run_path, "c", rounded=False)
    writers.write_qrels(vector_qrels(spark, d), judged_path)
    again = E.measures(readers.run(spark, run_path).select("qid", "doc_id", "score"), readers.qrels(spark, judged_path), CUTS)
    published = E.long_form(E.macro(again, names), [], names).select("metric", (F.round("value", 3) + F.when(F.col("metric") == "map", 0.002).otherwise(0.0)).alias("published"))
    return E.calibrate(ours, published)


@query(f"{_M} SELECT run, count(*) AS n_queries, {', '.join(f'round(avg({n}), 6) AS {n}' for n in NAMES)} FROM m GROUP BY run")
def h1_macro_mean(spark, d):
    return E.macro(_measured(spark, d, False), NAMES, by=("run",))


@query(f"{_M}, part AS (SELECT * FROM m WHERE NOT (run = 'b' AND qid % 40 = 0)), t AS (SELECT * FROM (SELECT DISTINCT qid FROM vqrels) CROSS JOIN (SELECT DISTINCT run FROM part)) SELECT run, count(*) AS n_queries, round(avg(coalesce(ndcg_10, 0)), 6) AS ndcg_10, round(avg(coalesce(p_10, 0)), 6) AS p_10 FROM t LEFT JOIN part USING (run, qid) GROUP BY run")
def h2_all_topics_mean(spark, d):
    """A run that misses topics counts 0 there."""
    m = _measured(spark, d, False).filter("NOT (run = 'b' AND qid % 40 = 0)")
    return E.macro(m, ["ndcg_10", "p_10"], vector_qrels(spark, d), ("run",))


@query(f"WITH {LAB} SELECT qid, count_if(rel = 0) AS n0, count_if(rel = 1) AS n1, count_if(rel = 2) AS n2, count_if(rel = 3) AS n3, count(DISTINCT doc_id) AS n_docs, count(DISTINCT judge_model) AS n_models FROM lab GROUP BY qid")
def h5_grade_histogram(spark, d):
    return labels(spark, d).groupBy("qid").agg(*[F.count_if(F.col("rel") == g).alias(f"n{g}") for g in range(4)], F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("judge_model").alias("n_models"))


@query(f"{_M}, w AS (SELECT qid, max(CASE WHEN run = 'a' THEN ndcg_10 END) AS a, max(CASE WHEN run = 'b' THEN ndcg_10 END) AS b, max(CASE WHEN run = 'c' THEN ndcg_10 END) AS c FROM m GROUP BY qid) SELECT count_if(c > a) AS c_over_a, count_if(c > b) AS c_over_b, count_if(a > b) AS a_over_b, count(*) AS n FROM w")
def h12_wins(spark, d):
    w = _measured(spark, d, False).groupBy("qid").pivot("run", ["a", "b", "c"]).agg(F.max("ndcg_10"))
    win = lambda x, y: F.count_if(F.col(x) > F.col(y)).alias(f"{x}_over_{y}")
    return w.agg(win("c", "a"), win("c", "b"), win("a", "b"), F.count(F.lit(1)).alias("n"))


@query(f"{_M} SELECT run, round(avg(ndcg_10), 6) AS mean, round(median(ndcg_10), 6) AS median, min(ndcg_10) AS least, max(ndcg_10) AS most, round(stddev_samp(ndcg_10), 6) AS std FROM m GROUP BY run")
def h13_spread(spark, d):
    return _measured(spark, d, False).groupBy("run").agg(F.round(F.avg("ndcg_10"), 6).alias("mean"), F.round(F.median("ndcg_10"), 6).alias("median"), F.min("ndcg_10").alias("least"), F.max("ndcg_10").alias("most"), F.round(F.stddev_samp("ndcg_10"), 6).alias("std"))


@query("SELECT count(DISTINCT topic_id) AS n_topics, count(DISTINCT f.formula_id) AS n_formulas, count(DISTINCT f.latex) AS n_latex FROM (SELECT topic_id, unnest(formulas) AS f FROM topics)")
def h15_distinct(spark, d):
    return table(spark, d, "topics").select("topic_id", F.explode("formulas").alias("f")).agg(F.countDistinct("topic_id").alias("n_topics"), F.countDistinct("f.formula_id").alias("n_formulas"), F.countDistinct("f.latex").alias("n_latex"))


@query(f"WITH {RUNS} SELECT run, qid, min(score) AS least, max(score) AS most FROM runs GROUP BY ALL")
def h16_score_range(spark, d):
    return runs(spark, d).groupBy("run", "qid").agg(F.min("score").alias("least"), F.max("score").alias("most"))


# Ranking, sorting, sets


@query(f"WITH {RUNS} SELECT run, qid, doc_id, (row_number() OVER (PARTITION BY run, qid ORDER BY score DESC, doc_id))::INTEGER AS rank FROM runs")
def i1_stable_rank(spark, d):
    return M.ranked(runs(spark, d)).select("run", "qid", "doc_id", "rank")


@query(f"WITH {RUNS}, {TREC} SELECT run, qid, doc_id, rank::INTEGER AS rank FROM trec")
def i2_trec_rank(spark, d):
    return E.trec_order(runs(spark, d), ["run", "qid"]).select("run", "qid", "doc_id", "rank")


@query("SELECT parent_id, id, score FROM (SELECT parent_id, id, score, row_number() OVER (PARTITION BY parent_id ORDER BY loaded_at, id, score) AS n FROM answers WHERE parent_id IS NOT NULL) WHERE n = 1")
def i3_first_per_key(spark, d):
    a = table(spark, d, "answers").filter("parent_id IS NOT NULL")
    return a.groupBy("parent_id").agg(F.min(F.struct("loaded_at", "id", "score")).alias("r")).select("parent_id", "r.id", "r.score")


@query(f"WITH {RUNS}, {TREC}, p AS (SELECT x.qid, x.doc_id, x.rank AS r, y.rank AS s FROM trec x JOIN trec y USING (qid, doc_id) WHERE x.run = 'a' AND y.run = 'c') SELECT qid, count_if(r <> s) AS n_changed, round(avg(abs(r - s)), 6) AS mean_shift, round(1.0 - 6.0 * sum((r - s) * (r - s)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)), 6) AS rho FROM p GROUP BY qid")
def i6_two_rankings(spark, d):
    """Changes, shift and rank correlation of two rankings of one pool."""
    t = E.trec_order(runs(spark, d), ["run", "qid"])
    p = t.filter("run = 'a'").select("qid", "doc_id", "rank").join(t.filter("run = 'c'").select("qid", "doc_id", F.col("rank").alias("new_rank")), ["qid", "doc_id"])
    return M.churn(p, 2**31 - 1)


@query(f"WITH {QRELS} SELECT qid, doc_id, rel, (row_number() OVER (ORDER BY split_part(qid, '.', 1), TRY_CAST(split_part(qid, '.', 2) AS INTEGER), TRY_CAST(doc_id AS BIGINT) IS NULL, TRY_CAST(doc_id AS BIGINT), doc_id))::BIGINT AS line FROM qrels")
def j2_natural_order(spark, d):
    """Lines of a judgement file in natural order, numbered without bringing them to one task."""
    q = qrels(spark, d).orderBy(C.topic_key(F.col("qid")), C.doc_key(F.col("doc_id")))
    q = cut(q.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")))
    n = q.groupBy("p").agg(F.count(F.lit(1)).alias("k"), F.min("m").alias("first"))  # one row a partition
    before = F.aggregate(F.filter("all", lambda x: x.p < F.col("p")), F.lit(0).cast("bigint"), lambda s, x: s + x.k)
    n = n.crossJoin(n.agg(F.collect_list(F.struct("p", "k")).alias("all"))).select("p", "first", before.alias("before"))
    return q.join(broadcast_if_small(n, 100_000), "p").select("qid", "doc_id", "rel", (F.col("m") - F.col("first") + F.col("before") + 1).alias("line"))


@query(f"WITH {QRELS} SELECT qid, doc_id, rel FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY md5('7|' || doc_id), doc_id) AS n, count_if(rel >= 2) OVER (PARTITION BY qid) AS k FROM qrels) WHERE n <= k")
def j6_seeded_controls(spark, d):
    """Random controls of each topic, as many as it has relevant documents, by a seeded hash."""
    from pyspark.sql import Window

    q = qrels(spark, d).withColumn("k", F.count_if(F.col("rel") >= 2).over(Window.partitionBy("qid")))
    return S.top(q, ["qid"], [F.md5(F.concat(F.lit("7|"), "doc_id")), F.asc("doc_id")], None, "n").filter("n <= k").select("qid", "doc_id", "rel")


@query(f"{_M} SELECT run, qid, ndcg_10 FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ndcg_10, qid) AS n FROM m) WHERE n <= 3")
def j8_worst_examples(spark, d):
    return S.top(_measured(spark, d, False), ["run"], [F.asc("ndcg_10"), F.asc("qid")], 3, "n").select("run", "qid", "ndcg_10")


@query(f"WITH {LAB} SELECT qid, doc_id, least, most, n FROM (SELECT qid, doc_id, min(rel) AS least, max(rel) AS most, count(*) AS n FROM lab GROUP BY ALL) WHERE least <> most")
def k2_label_conflicts(spark, d):
    return E.conflicts(labels(spark, d))


@query("SELECT topic_id, answer_id FROM (SELECT topic_id, answer_id FROM judgements WHERE NOT parse_ok EXCEPT SELECT topic_id, answer_id FROM judgements WHERE parse_ok)")
def k3_never_parsed(spark, d):
    j = table(spark, d, "judgements")
    return j.filter("NOT parse_ok").select("topic_id", "answer_id").subtract(j.filter("parse_ok").select("topic_id", "answer_id"))


@query("SELECT topic_id FROM judge_pairs INTERSECT SELECT topic_id FROM generations")
def k4_shared(spark, d):
    return table(spark, d, "judge_pairs").select("topic_id").intersect(table(spark, d, "generations").select("topic_id"))


@query("SELECT DISTINCT id FROM answers WHERE id NOT IN (SELECT answer_id FROM judgements)")
def k5_remaining(spark, d):
    return table(spark, d, "answers").select("id").distinct().join(table(spark, d, "judgements").select(F.col("answer_id").alias("id")), "id", "left_anti")


@query(f"WITH {RUNS}, {VQRELS}, {_CH} SELECT qid, doc_id, rel FROM (SELECT * FROM human UNION ALL SELECT * FROM judge ANTI JOIN human USING (qid, doc_id))")
def k6_overlay(spark, d):
    return E.overlay(*_channels(spark, d))


# Fusion

_RANK = "rr AS (SELECT *, row_number() OVER (PARTITION BY run, qid ORDER BY score DESC, doc_id) AS rank FROM runs)"
_MM = "mm AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM runs WINDOW w AS (PARTITION BY run, qid))"
_OUT = "SELECT qid, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 100"


def _fused(df):
    return df.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {RUNS}, {_RANK}, f AS (SELECT qid, doc_id, round(sum(1.0 / (rank + 60)), 9) AS score FROM rr GROUP BY ALL) {_OUT}")
def m1_rrf(spark, d):
    return _fused(M.rrf(runs(spark, d), 60, 100))


@query(f"WITH {RUNS}, {_MM}, f AS (SELECT qid, doc_id, round(sum(s), 9) AS score FROM mm GROUP BY ALL) {_OUT}")
def m2_combsum(spark, d):
    return _fused(M.combsum(runs(spark, d), 100))


@query(f"WITH {RUNS}, {_MM}, f AS (SELECT qid, doc_id, round(sum(s) * count(*), 9) AS score FROM mm GROUP BY ALL) {_OUT}")
def m3_combmnz(spark, d):
    return _fused(M.combsum(runs(spark, d), 100, mnz=True))


@query(f"WITH {RUNS}, {_RANK}, w(run, weight) AS (VALUES ('a', 0.5), ('b', 0.2), ('c', 0.3)), f AS (SELECT qid, doc_id, round(sum(1.0 / (rank + 60) * weight), 9) AS score FROM rr JOIN w USING (run) GROUP BY ALL) {_OUT}")
def m4_weighted_rrf(spark, d):
    w = spark.createDataFrame([("a", 0.5), ("b", 0.2), ("c", 0.3)], "run string, weight double")
    return _fused(M.rrf(runs(spark, d), 60, 100, w))


@query(f"WITH {RUNS}, {TREC}, p AS (SELECT qid, doc_id, count(DISTINCT run) AS k FROM trec WHERE rank <= 100 GROUP BY ALL) SELECT qid, count(*) AS n_any, count_if(k = 3) AS n_all, round(count_if(k = 3) / count(*)::DOUBLE, 6) AS share FROM p GROUP BY qid")
def h14_channel_overlap(spark, d):
    return M.overlap(E.trec_order(runs(spark, d), ["run", "qid"], 100))


@query(f"WITH {RUNS}, {_RANK}, b AS (SELECT qid, doc_id, round(sum(1.0 / (rank + 60)), 9) AS score FROM rr WHERE run <> 'c' GROUP BY ALL), two AS (SELECT 'block' AS run, * FROM b UNION ALL SELECT * FROM runs WHERE run = 'c'), r2 AS (SELECT *, row_number() OVER (PARTITION BY run, qid ORDER BY score DESC, doc_id) AS rank FROM two), f AS (SELECT qid, doc_id, round(sum(1.0 / (rank + 60)), 9) AS score FROM r2 GROUP BY ALL) {_OUT}")
def m5_blocked(spark, d):
    r = runs(spark, d)
    return _fused(M.blocked(r.filter("run <> 'c'"), r.filter("run = 'c'"), 60, 100))


_RER = f"""WITH {RUNS}, cand AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM runs WHERE run = 'a'),
sim AS (SELECT qid, doc_id, score AS sim, run FROM runs WHERE run <> 'a' AND qid % 60 <> 0), nf AS (SELECT qid, count(DISTINCT run) AS n FROM sim GROUP BY qid),
fs AS (SELECT qid, doc_id, sum(sim) / n AS fs FROM (SELECT qid, doc_id, run, max(sim) AS sim FROM sim GROUP BY ALL) JOIN nf USING (qid) GROUP BY qid, doc_id, n),
c AS (SELECT cand.*, rank <= 100 AS in_pool, coalesce(fs, 0.0) AS fs, nf.qid IS NOT NULL AS has FROM cand LEFT JOIN fs USING (qid, doc_id) LEFT JOIN nf USING (qid)),
b AS (SELECT *, CASE WHEN in_pool AND has THEN round(0.5 * (CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END) + 0.5 * (CASE WHEN max(fs) OVER w = min(fs) OVER w THEN 0.5 ELSE (fs - min(fs) OVER w) / (max(fs) OVER w - min(fs) OVER w) END), 9) END AS blend FROM c WINDOW w AS (PARTITION BY qid, in_pool)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY in_pool DESC, blend DESC NULLS LAST, rank) AS new_rank FROM b)"""


def _reranked(spark, d):
    r = runs(spark, d)
    cand = M.ranked(r.filter("run = 'a'")).drop("run")
    sim = r.filter("run <> 'a' AND qid % 60 <> 0").select("qid", F.col("run").alias("formula"), "doc_id", F.col("score").alias("sim"))
    return M.rerank(cand, sim)


@query(f"{_RER} SELECT qid, doc_id, rank::INTEGER AS rank, new_rank::INTEGER AS new_rank, round(blend, 6) AS blend FROM r")
def m6_rerank(spark, d):
    """Best similarity per topic formula blended with text scores over the pool; topics without formulas unchanged."""
    return _reranked(spark, d).select("qid", "doc_id", "rank", "new_rank", F.round("blend", 6).alias("blend"))


@query(f"{_RER} SELECT qid, count_if(rank <> new_rank) AS n_changed, round(avg(abs(rank - new_rank)), 6) AS mean_shift, round(1.0 - 6.0 * sum((rank - new_rank) * (rank - new_rank)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)), 6) AS rho FROM r WHERE rank <= 100 GROUP BY qid")
def m7_rerank_churn(spark, d):
    return M.churn(_reranked(spark, d), 100)


@query(f"{_RER}, bs AS (SELECT qid, doc_id, max(sim) AS sim FROM sim GROUP BY ALL), per AS (SELECT qid, avg((sim IS NOT NULL)::INT) AS c, max(sim) - min(sim) AS s FROM r LEFT JOIN bs USING (qid, doc_id) WHERE rank <= 100 GROUP BY qid), ch AS (SELECT qid, round(1.0 - 6.0 * sum((rank - new_rank) * (rank - new_rank)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)), 6) AS rho FROM r WHERE rank <= 100 AND has GROUP BY qid), v AS (SELECT round(avg(c) * 100, 6) AS coverage, round(avg((s IS NOT NULL)::INT) * 100, 6) AS topic_coverage, round(coalesce(avg(s), 0), 6) AS mean_spread FROM per), w AS (SELECT round(coalesce(avg(rho), 1), 6) AS mean_rho FROM ch) SELECT *, coverage < 40 OR topic_coverage < 50 OR mean_rho > 0.98 OR mean_spread < 0.01 AS no_op FROM v CROSS JOIN w")
def m7_verdict(spark, d):
    """Whether reranking by formulas can change anything."""
    r = cut(runs(spark, d))
    cand = M.ranked(r.filter("run = 'a'")).drop("run")
    sim = r.filter("run <> 'a' AND qid % 60 <> 0").select("qid", F.col("run").alias("formula"), "doc_id", F.col("score").alias("sim"))
    done = M.rerank(cand, sim).join(sim.select("qid").distinct(), "qid", "left_semi")
    return M.no_op(cand.filter("rank <= 100").select("qid", "doc_id"), sim, M.churn(done, 100))


QUERIES = Q
