"""The remaining operators of the survey, each a query of its own, with SQL or values computed by hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sumac.functions import columns as C
from sumac.functions import formula as X
from sumac.functions import latex as L
from sumac.operators import embedding as V
from sumac.operators import evaluation as E
from sumac.operators import fusion as M
from sumac.operators import rag as G
from sumac.operators import search as S
from sumac.plans.evaluation_queries import CUTS, _measured, _visual, _VIS, recall
from sumac.plans.judge_queries import _text_file, scratch
from sumac.plans.tables import ANS, KEY, QRELS, RUNS, TREC, VEC, VQRELS, answers, measures_sql, qrels, runs, vector_qrels, vector_queries, vectors
from sumac.plans.text_queries import _formulas, _LATEX_TUPLES, latex_tuples, values
from sumac.runtime import cut, table
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


# Sources and sinks


@query("SELECT 'answer' AS kind, id, coalesce(score, 0) AS score, trim(parent_id) AS other_id, count(*) AS n FROM answers GROUP BY ALL UNION ALL SELECT 'question', id, coalesce(score, 0), trim(accepted_answer_id), count(*) FROM questions GROUP BY ALL")
def a2_post_split(spark, d):
    """All posts in one file of rows, other types among them, split by type in one pass each."""
    path = scratch(spark, "posts")
    kind = lambda df, t, **more: df.select(F.lit(t).alias("_PostTypeId"), *[c.alias(f"_{n}") for n, c in more.items()])
    body = F.lit("<p>b</p>")
    a = kind(table(spark, d, "answers"), 2, Id=F.col("id"), ParentId=F.trim("parent_id"), Score=F.col("score"), Body=body)
    q = kind(table(spark, d, "questions"), 1, Id=F.col("id"), Title=F.col("title"), AcceptedAnswerId=F.trim("accepted_answer_id"), Score=F.col("score"), Body=body)
    other = kind(table(spark, d, "removed_posts"), 5, Id=F.col("post_id"))
    a.unionByName(q, True).unionByName(other, True).write.format("xml").option("rootTag", "posts").option("rowTag", "row").save(path)
    answers_, questions = readers.split_posts(readers.posts_xml(spark, path))
    one = lambda df, kind, other: df.select(F.lit(kind).alias("kind"), "id", "score", F.col(other).alias("other_id"))
    return one(answers_, "answer", "parent_id").unionByName(one(questions, "question", "accepted_answer_id")).groupBy("kind", "id", "score", "other_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM topics")
def a7_projected_tsv(spark, d):
    """One column of a TSV, the others never parsed into rows."""
    path = scratch(spark, "proj")
    table(spark, d, "topics").select("topic_id", F.size("tags").alias("n_tags")).write.option("sep", "\t").option("header", True).csv(path)
    return readers.numbered_tsv(spark, path, columns=["topic_id"]).agg(F.count("topic_id").alias("n"))


@query("SELECT id, count(*) AS n, 1::BIGINT AS n_skipped FROM questions GROUP BY id")
def a19_many_shards(spark, d):
    """Shards of a table with an unreadable one among them, which is left out and named."""
    path, bad = scratch(spark, "shards"), scratch(spark, "bad")
    table(spark, d, "questions").select("id", "score").write.option("sep", "\t").option("header", True).csv(path)
    spark.createDataFrame([("no zipped file",)], "value string").coalesce(1).write.text(bad)
    fs = spark._jvm.org.apache.hadoop.fs
    home = fs.Path(bad).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in home.listStatus(fs.Path(bad)) if f.getPath().getName().startswith("part-"))
    home.rename(part, fs.Path(f"{path}/part-99999.csv.gz"))
    n = readers.skipped_files(spark, path).agg(F.count_if(F.col("file_name") == "part-99999.csv.gz").alias("n_skipped"))
    t = readers.numbered_tsv(spark, path, schema="id string, score int", skip_unreadable=True)
    return t.groupBy("id").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n))  # one row


@query("SELECT DISTINCT gen_id, topic_id, k FROM generations")
def b1_json_lines(spark, d):
    path = scratch(spark, "gens")
    writers.json_lines(table(spark, d, "generations").select("gen_id", "topic_id", "k"), path)
    return readers.jsonl(spark, path, "gen_id bigint, topic_id string, k int").distinct()


@query(f"WITH {RUNS} SELECT qid::VARCHAR AS qid, doc_id::VARCHAR AS doc_id, score FROM runs WHERE run = 'a'")
def b3_unrounded_run(spark, d):
    """A run whose scores come back as they were."""
    path = scratch(spark, "raw")
    writers.write_run(M.ranked(runs(spark, d).filter("run = 'a'")), path, "a", rounded=False)
    return readers.run(spark, path).select("qid", "doc_id", "score")


@query(f"WITH {_LATEX_TUPLES} SELECT array_to_string(tuples, ' ') AS line, count(*) AS n FROM tu GROUP BY ALL")
def b12_corpus_lines(spark, d):
    """The training corpus: one line a formula."""
    path = scratch(spark, "corpus")
    writers.corpus_lines(latex_tuples(spark, d).select(F.col("tuples").alias("words"))).write.text(path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


# Scalars

_HTML = [
    ("<p>Let <span class='math-container' id='7'>$x$</span> be <b>odd</b>.</p>", "Let $x$ be odd .", 1),
    ("<p>A &lt; B</p><span class='other'>kept</span>", "A < B kept", 0),
    ("", "", 0),
]


@query(values(_HTML, "html, text, n_formulas"))
def c1_html_text(spark, d):
    df = spark.createDataFrame([(h[0],) for h in _HTML], "html string")
    return df.select("html", readers.html_text_udf()("html").alias("t")).select("html", "t.text", F.size("t.formulas").alias("n_formulas"))


@query()
def c1_html_bodies(spark, d):
    """The same over the bodies of all answers and questions."""
    one = lambda t: table(spark, d, t).select(F.lit(t).alias("table_name"), "id", "body_text").distinct()
    df = one("answers").unionByName(one("questions")).filter("body_text IS NOT NULL")
    return df.select("table_name", "id", readers.html_text_udf()("body_text").alias("t")).select("table_name", "id", "t.text", F.size("t.formulas").alias("n_formulas"))


@query(f"WITH {QRELS} SELECT qid, sum((rel >= 2)::INT)::BIGINT AS n_relevant, count(*) AS n FROM qrels GROUP BY qid")
def c15_binary(spark, d):
    return qrels(spark, d).groupBy("qid").agg(F.sum(C.binary(F.col("rel"))).alias("n_relevant"), F.count(F.lit(1)).alias("n"))


_FILES = [("qrel_task1_2020.tsv", "2020"), ("judge/2022/qrels", "2022"), ("qrels_2019", None)]


@query(values(_FILES, "name, year"))
def c17_year(spark, d):
    return spark.createDataFrame([(f[0],) for f in _FILES], "name string").select("name", C.year_of(F.col("name")).alias("year"))


@query(f"WITH {RUNS} SELECT run, qid, doc_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS scaled FROM runs WINDOW w AS (PARTITION BY run, qid)")
def c25_minmax(spark, d):
    return runs(spark, d).select("run", "qid", "doc_id", F.round(M.minmax(F.col("score"), ["run", "qid"]), 6).alias("scaled"))


_SHOTS = [{"question": "Is 7 prime?", "answer": "Yes, {7} has no divisor.", "reasoning": "It answers.", "label": 3}, {"question": "Is 9 prime?", "answer": "It is odd.", "reasoning": "It does not answer.", "label": 0}]
_TURNS = "system: Grade from 0 to 3." + "".join(f"\n\nuser: Q: {x['question']}\nA: {x['answer']}\nGrade?\n\nassistant: {x['reasoning']}\nLABEL: {x['label']}" for x in _SHOTS)


@query(f"SELECT DISTINCT topic_id, answer_id, 6 AS n_messages, md5('{_TURNS}' || chr(10) || chr(10) || 'user: Q: ' || coalesce(question, '') || chr(10) || 'A: ' || coalesce(answer_text, '') || chr(10) || 'Grade?') AS prompt_md5 FROM judge_pairs")
def c31_judge_prompt(spark, d):
    """The judge's turns: the system's, two worked examples, then the pair."""
    m = G.judge_messages(table(spark, d, "judge_pairs"), "Q: {question}\nA: {answer_text}\nGrade?", "Grade from 0 to 3.", _SHOTS)
    return m.select("topic_id", "answer_id", F.size("messages").alias("n_messages"), F.md5(G.prompt_of(F.col("messages"))).alias("prompt_md5")).distinct()


# Formula structure

_MATRICES = [
    ("<math><mrow><mo>(</mo><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr></mtable><mo>)</mo></mrow></math>", "[M!()1x2,w[N!1,e[N!2]]]"),
    ("<math><mrow><mo>{</mo><mi>a</mi><mo>,</mo><mi>b</mi><mo>}</mo></mrow></math>", "[M!{}1x2,w[V!a,n[&comma;],e[V!b]]]"),
    ("<math><mmultiscripts><mi>T</mi><mi>i</mi><mi>j</mi><mprescripts/><mi>k</mi><none/></mmultiscripts></math>", "[V!T,a[V!j],b[V!i],d[V!k]]"),
    ("<math><mroot><mi>x</mi><mn>3</mn></mroot></math>", "[O!root,c[N!3],w[V!x]]"),
]


@query(values(_MATRICES, "markup, tree"))
def d5_matrices(spark, d):
    """Fenced lists, tables, prescripts and roots as layout trees."""
    df = spark.createDataFrame([(m[0],) for m in _MATRICES], "markup string")
    return df.select("markup", X.tree_facts_udf("slt")("markup").tree.alias("tree"))


_OPS = [
    ("<math><apply><csymbol>for-all</csymbol><ci>x</ci><ci>p</ci></apply></math>", "[O!forall,0[V!x],1[V!p]]"),
    ("<math><apply><apply><csymbol>superscript</csymbol><sin/><cn>2</cn></apply><ci>x</ci></apply></math>", "[+!F!sin,0[O!SUP,0[F!sin],1[N!2]],1[V!x]]"),
    ("<math><apply><root/><degree><cn>3</cn></degree><ci>x</ci></apply></math>", "[O!root,0[V!x],1[N!3]]"),
    ("<math><set><cn>1</cn><cn>2</cn></set></math>", "[M!S-2,0[N!1],1[N!2]]"),
    ("<math><apply><times/><infinity/><apply><determinant/><ci>A</ci></apply></apply></math>", "[U!times,0[C!infinity],0[F!det,0[V!A]]]"),
    ("<math><cerror><ci>x</ci></cerror></math>", "[E!,0[V!x]]"),
]


@query(values(_OPS, "markup, tree"))
def d6_operators(spark, d):
    """Operators, compound operators, constants, sets and errors as operator trees."""
    df = spark.createDataFrame([(m[0],) for m in _OPS], "markup string")
    return df.select("markup", X.tree_facts_udf("opt")("markup").tree.alias("tree"))


@query(values([(62, 63, 2, 62), (63, 66, 3, 63)], "n_kids, size, depth, leaves"))
def d7_wide_operators(spark, d):
    """A commutative operator with more operands than labels gets groups of them."""
    rows = [(k, f"<math><apply><plus/>{''.join(f'<ci>x{i}</ci>' for i in range(k))}</apply></math>") for k in (62, 63)]
    df = spark.createDataFrame(rows, "n_kids int, markup string").select("n_kids", X.tree_facts_udf("opt")("markup").alias("t"))
    return df.select("n_kids", "t.size", "t.depth", "t.leaves")


@query(f"WITH {_LATEX_TUPLES}, q AS (SELECT formula_id, list_distinct(tuples) AS t FROM tu) SELECT formula_id, CASE WHEN len(t) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(t, t[1:2])) / len(t)::DOUBLE, 6) END AS share FROM q")
def d18_containment(spark, d):
    """Containment of each formula's tuples in its own first two."""
    t = latex_tuples(spark, d).select("formula_id", F.array_distinct("tuples").alias("t"))
    return t.select("formula_id", F.round(X.containment(F.col("t"), F.slice("t", 1, 2)), 6).alias("share"))


@query(f"WITH {VEC} SELECT doc_id, round(v[1] * 3 / sqrt(list_sum(list_transform(v, lambda x: 9 * x * x))), 6) AS first FROM vec")
def e4_unit(spark, d):
    return vectors(spark, d).select("doc_id", F.round(F.get(C.unit(C.scaled(F.col("v"), 3)), F.lit(0)), 6).alias("first"))


@query("SELECT vec_id, label, len(embedding)::INTEGER AS dim FROM embeddings")
def e7_given_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").alias("dim"))


_LATEX = [
    ("$x - y^2 = 0$", 11, 14, "[V!x,n[-,n[V!y,n[=,n[N!0]],a[N!2]]]]"),
    ("\\frac{a}{b}", 5, 4, "[O!divide,o[V!a],u[V!b]]"),
    ("\\sqrt[3]{\\alpha}", 5, 4, "[O!root,c[N!3],w[V!α]]"),
    ("x_i", 3, 4, "[V!x,b[V!i]]"),
    ("\\unknown{", 1, 0, "[V!unknown]"),
    ("$$ $$", 0, 0, ""),
]


@query(values(_LATEX, "latex, n_layout, n_operator, tree"))
def d1_latex_cases(spark, d):
    """Formulas in LaTeX by way of MathML: numbers of tuples in either tree, and the layout tree."""
    m = L.converted(spark.createDataFrame([(x[0],) for x in _LATEX], "latex string"))
    return m.select("latex", F.size(X.tuples_udf("slt")("pmml")).alias("n_layout"), F.size(X.tuples_udf("opt")("cmml")).alias("n_operator"), X.tree_facts_udf("slt")("pmml").tree.alias("tree"))


@query()
def d1_collection_trees(spark, d):
    """Tuples of the layout and operator trees of all formulas of the collection, from their LaTeX."""
    m = L.converted(_formulas(spark, d))
    return m.select("formula_id", X.tuples_udf("slt")("pmml").alias("layout"), X.tuples_udf("opt")("cmml").alias("operator"), F.col("cmml").isNotNull().alias("certain"))


# Search


@query(r"WITH q AS (SELECT item_id AS qid, text FROM heldout_items), docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(w) AS term, len(w) AS dl FROM docs) GROUP BY ALL), freq AS (SELECT term, count(*) AS df FROM post GROUP BY term), tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM docs WHERE len(w) > 0), qt AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM q), bm AS (SELECT qid, doc_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl)))), 6) AS score FROM post JOIN qt USING (term) JOIN freq USING (term) CROSS JOIN tot GROUP BY ALL) SELECT qid, doc_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 10")
def f3_batch_search(spark, d):
    """All held-out items as queries against a stored index of all documents, of which the folders of their terms are read."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    q = table(spark, d, "heldout_items").select(F.col("item_id").alias("qid"), "text")
    return S.bm25(S.build_text_index(docs, scratch(spark, "text")), q, 10).select("qid", "doc_id", "rank")


def _fused_sets(spark, d):
    f = lambda c: C.fused(F.col(c), F.reverse(c))
    return vectors(spark, d).select("doc_id", f("v").alias("v")), vector_queries(spark, d).select("qid", f("q").alias("q"))


_FU = "u AS (SELECT doc_id, list_transform(list_zip(v, list_reverse(v)), lambda p: p[1] + p[2]) AS t FROM vec), un AS (SELECT doc_id, list_transform(t, lambda x: x / sqrt(list_sum(list_transform(t, lambda y: y * y)))) AS v FROM u)"


@query(f"WITH {VEC}, {_FU} SELECT qid, doc_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT a.doc_id AS qid, b.doc_id, round(list_inner_product(a.v, b.v), 6) AS score FROM un a CROSS JOIN un b WHERE a.doc_id % 20 = 0)) WHERE rank <= 10")
def f7_fused_search(spark, d):
    """One index of fused vectors."""
    return S.exact_search(*_fused_sets(spark, d), 10).select("qid", "doc_id", "rank")


@query("SELECT * FROM (VALUES ('half', 12, true), ('byte', 16, true)) AS t(store, probes, reached)")
def f8_shifted_index(spark, d):
    """A stored index of every mean-shifted unit vector: recall at 10 of at least .9."""
    v = cut(V.mean_shift(vectors(spark, d), "doc_id"))
    q = v.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.col("v").alias("q"))
    return recall(spark, v, q, 16, [("half", 12, 0.9), ("byte", 16, 0.9)])


@query(f"WITH {RUNS}, {_VIS} SELECT qid, formula_id, post_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, formula_id) AS rank FROM inst JOIN vis USING (formula_id)) WHERE rank <= 100")
def f12_instances(spark, d):
    """The first hundred instances of each topic with their posts."""
    inst, vis, _ = _visual(spark, d)
    return S.top(inst.join(vis, "formula_id"), ["qid"], [F.desc("score"), F.asc("formula_id")], 100).select("qid", "formula_id", "post_id", "rank")


@query(f"WITH {RUNS} SELECT run AS representation, qid, doc_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run, qid ORDER BY score DESC, doc_id) AS rank FROM runs) WHERE rank <= 5")
def f9_by_representation(spark, d):
    """One table for all representations, ranked within each."""
    return M.ranked(runs(spark, d), 5).select(F.col("run").alias("representation"), "qid", "doc_id", "rank")


# Joins, aggregates, ranks, sets


@query(f"WITH {RUNS}, {_VIS} SELECT qid, count(*) AS n_hits, count(DISTINCT visual_id) AS n_visual FROM inst JOIN vis USING (formula_id) WHERE visual_id IS NOT NULL AND visual_id <> '' GROUP BY qid")
def g6_visual_join(spark, d):
    inst, vis, _ = _visual(spark, d)
    return inst.join(vis, "formula_id").filter("visual_id <> ''").groupBy("qid").agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("visual_id").alias("n_visual"))


@query(f"WITH {QRELS}, {ANS} SELECT DISTINCT f.formula_id, f.latex FROM (SELECT unnest(formulas) AS f FROM ans SEMI JOIN (SELECT doc_id AS id FROM qrels WHERE rel >= 2) USING (id))")
def g8_candidate_formulas(spark, d):
    """Formulas of answers judged relevant."""
    good = qrels(spark, d).filter("rel >= 2").select(F.col("doc_id").alias("id")).distinct()
    return answers(spark, d).join(good, "id", "left_semi").select(F.explode("formulas").alias("f")).select("f.formula_id", "f.latex").distinct()


@query(f"WITH {QRELS}, {ANS}, t AS (SELECT topic_id AS qid, unnest(formulas).formula_id AS tf FROM topics), a AS (SELECT qid, doc_id, unnest(formulas).formula_id AS af FROM qrels JOIN ans ON id = doc_id) SELECT qid, doc_id, count(*) AS n_pairs FROM t JOIN a USING (qid) GROUP BY ALL")
def g13_formula_pairs(spark, d):
    """Topic formulas met with the formulas of judged answers, within the topic."""
    t = table(spark, d, "topics").select(F.col("topic_id").alias("qid"), F.explode("formulas.formula_id").alias("tf"))
    a = qrels(spark, d).join(answers(spark, d).withColumnRenamed("id", "doc_id"), "doc_id").select("qid", "doc_id", F.explode("formulas.formula_id").alias("af"))
    return t.join(a, "qid").groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("n_pairs"))


@query(f"WITH {VEC} SELECT qid, doc_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT qid, doc_id, round(list_inner_product(q, v), 6) AS score FROM vec CROSS JOIN vq)) WHERE rank <= 3")
def g14_query_vectors(spark, d):
    """The stated query set met by all vectors in expressions only."""
    return S.pair_search(vectors(spark, d), vector_queries(spark, d).select("qid", "q"), 3).select("qid", "doc_id", "rank")


@query(f"WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY run, qid ORDER BY score DESC, doc_id) AS rank FROM runs) SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 6) AS reciprocal, count(*) AS n_runs FROM r WHERE rank <= 50 GROUP BY ALL")
def h3_reciprocal_sums(spark, d):
    r = M.ranked(runs(spark, d), 50)
    return r.groupBy("qid", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(60) + F.col("rank"))), 6).alias("reciprocal"), F.count(F.lit(1)).alias("n_runs"))


@query(f"WITH {RUNS} SELECT qid, round(avg(b), 6) AS mean, round(max(b), 6) AS most, round(sum(b), 6) AS total FROM (SELECT run, qid, max(score) AS b FROM runs WHERE doc_id <> qid GROUP BY ALL) GROUP BY qid")
def h4_best_similarity(spark, d):
    """Best similarity per representation, then mean, maximum and sum."""
    b = runs(spark, d).filter("doc_id <> qid").groupBy("run", "qid").agg(F.max("score").alias("b"))
    return b.groupBy("qid").agg(F.round(F.avg("b"), 6).alias("mean"), F.round(F.max("b"), 6).alias("most"), F.round(F.sum("b"), 6).alias("total"))


@query(f"WITH {RUNS}, {VQRELS}, {TREC} SELECT run, qid, doc_id, (sum(CASE WHEN rel >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY run, qid ORDER BY rank ROWS UNBOUNDED PRECEDING))::BIGINT AS seen FROM trec LEFT JOIN vqrels USING (qid, doc_id)")
def i4_running_relevant(spark, d):
    r = E.trec_order(runs(spark, d), ["run", "qid"]).join(vector_qrels(spark, d), ["qid", "doc_id"], "left")
    w = Window.partitionBy("run", "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return r.select("run", "qid", "doc_id", F.sum(F.when(F.col("rel") >= 2, 1).otherwise(0)).over(w).alias("seen"))


@query(f"WITH {VEC}, {VQRELS} SELECT qid, doc_id, (row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id))::INTEGER AS ideal_rank FROM vqrels")
def i5_ideal_rank(spark, d):
    return S.top(vector_qrels(spark, d), ["qid"], [F.desc("rel"), F.asc("doc_id")], None, "ideal_rank").select("qid", "doc_id", "ideal_rank")


@query(f"WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY run, qid ORDER BY score DESC, doc_id) AS rank FROM runs WHERE run = 'a') SELECT qid, rank <= 100 AS in_pool, count(*) AS n, min(rank)::INTEGER AS first FROM r GROUP BY ALL")
def i7_pool_and_tail(spark, d):
    r = M.ranked(runs(spark, d).filter("run = 'a'"))
    return r.groupBy("qid", (F.col("rank") <= 100).alias("in_pool")).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))


@query(f"WITH {RUNS} SELECT run, qid, doc_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run, qid ORDER BY score DESC, doc_id) AS rank FROM runs) WHERE rank <= 20")
def j1_top_k(spark, d):
    return M.ranked(runs(spark, d), 20).select("run", "qid", "doc_id", "rank")


@query("SELECT 1000 AS n")
def j3_row_limit(spark, d):
    """The feature itself: a scan that stops after a number of rows."""
    return table(spark, d, "events").limit(1000).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(f"WITH {QRELS}, t AS (SELECT DISTINCT qid FROM qrels ORDER BY split_part(qid, '.', 1), TRY_CAST(split_part(qid, '.', 2) AS INTEGER) LIMIT 10) SELECT qid, doc_id, rel FROM (SELECT q.*, row_number() OVER (PARTITION BY qid ORDER BY TRY_CAST(doc_id AS BIGINT), doc_id) AS n FROM qrels q SEMI JOIN t USING (qid)) WHERE n <= 5")
def j4_first_topics(spark, d):
    """The feature itself: the first topics in natural order and the first pairs of each."""
    q = qrels(spark, d)
    t = q.select("qid").distinct().orderBy(C.topic_key(F.col("qid"))).limit(10)
    return S.top(q.join(t, "qid", "left_semi"), ["qid"], [F.col("doc_id").try_cast("bigint").asc(), F.asc("doc_id")], 5, "n").select("qid", "doc_id", "rel")


@query(f"WITH {RUNS}, {TREC} SELECT run, qid, doc_id, score FROM trec WHERE rank <= 20")
def j5_depth_cut(spark, d):
    return E.trec_order(runs(spark, d), ["run", "qid"], 20).select("run", "qid", "doc_id", "score")


@query("SELECT vec_id AS doc_id FROM (SELECT vec_id, row_number() OVER (ORDER BY md5('7|' || vec_id), vec_id) AS k, count(*) OVER () AS n FROM embeddings) WHERE k <= least(greatest(n // 10, 40 * 16), n)")
def j7_training_sample(spark, d):
    """The index's training sample: a tenth of the vectors, at least forty a cell, at most all, without replacement."""
    return S.training_sample(vectors(spark, d), 16).select("doc_id")


@query(f"WITH {RUNS}, {TREC} SELECT qid, count(*) AS n_docs FROM (SELECT DISTINCT qid, doc_id FROM trec WHERE rank <= 50) GROUP BY qid")
def k1_union_of_runs(spark, d):
    t = E.trec_order(runs(spark, d), ["run", "qid"], 50)
    a, b, c = (t.filter(F.col("run") == x).select("qid", "doc_id") for x in "abc")
    return a.union(b).union(c).distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("n_docs"))


@query("SELECT a.topic_id, len(list_intersect(a.tags, b.tags)) AS n_both, len(list_distinct(list_concat(a.tags, b.tags))) AS n_any FROM topics a JOIN topics b ON TRY_CAST(split_part(b.topic_id, '.', 2) AS INTEGER) = TRY_CAST(split_part(a.topic_id, '.', 2) AS INTEGER) + 1")
def k7_tag_sets(spark, d):
    """Tags shared by neighbouring topics, and all of theirs."""
    t = table(spark, d, "topics").select("topic_id", "tags", F.split_part("topic_id", F.lit("."), F.lit(2)).try_cast("int").alias("n"))
    b = t.select(F.col("tags").alias("other"), (F.col("n") - 1).alias("n"))
    return t.join(b, "n").select("topic_id", F.size(F.array_intersect("tags", "other")).cast("bigint").alias("n_both"), F.size(F.array_union("tags", "other")).cast("bigint").alias("n_any"))


_M = f"WITH {RUNS}, {VQRELS}, {measures_sql('runs', 'vqrels', CUTS, False)}"


@query(f"{_M} SELECT run, qid, p_5, p_10, p_20 FROM m")
def l2_precision(spark, d):
    return _measured(spark, d, False).select("run", "qid", "p_5", "p_10", "p_20")


@query(f"{_M} SELECT run, qid, recall_100, map_100, map FROM m")
def l3_recall_map(spark, d):
    return _measured(spark, d, False).select("run", "qid", "recall_100", "map_100", "map")


@query(f"{_M} SELECT run, qid, bpref FROM m")
def l4_bpref(spark, d):
    return _measured(spark, d, False).select("run", "qid", "bpref")


@query(f"{_M} SELECT run, metric, round(avg(value), 6) AS value FROM (UNPIVOT (SELECT run, qid, ndcg_10, p_10, map, bpref FROM m) ON ndcg_10, p_10, map, bpref INTO NAME metric VALUE value) GROUP BY ALL")
def l13_report(spark, d):
    """Means of all measures in long form, from frames alone."""
    names = ["ndcg_10", "p_10", "map", "bpref"]
    return E.long_form(_measured(spark, d, False), ["run", "qid"], names).groupBy("run", "metric").agg(F.round(F.avg("value"), 6).alias("value"))


# Ingest


@query("SELECT count(*) AS n, 3 AS n_chunks FROM events")
def o3_chunked_submission(spark, d):
    """Three chunks submitted one after another, each marked when done."""
    src, mark, done = (scratch(spark, x) for x in ("chunks", "chunkmark", "done"))
    e = table(spark, d, "events").select("event_id")
    for k in range(3):
        e.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(src)
    ingest.submit_chunks(spark, src, "event_id bigint", mark, lambda df, k: df.withColumn("chunk", F.lit(k)).write.mode("append").parquet(done), 1)
    return spark.read.parquet(done).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk").cast("int").alias("n_chunks"))


@query(
    f"""WITH {_LATEX_TUPLES}, w AS (SELECT formula_id, list_transform(tuples, lambda t: string_split(t, chr(9))[1]) AS w FROM tu),
p AS (SELECT formula_id, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 1),
c AS (SELECT w[i] AS token, w[k] AS context, count(*) AS n FROM (SELECT w, i, unnest(range(greatest(i - 2, 1), least(i + 2, len(w)) + 1)) AS k FROM p) WHERE i <> k GROUP BY ALL),
o AS (SELECT token, sum(n) AS total FROM c GROUP BY token),
x AS (SELECT c.token, c.n, ('0x' || substring(md5(context), 1, 4))::BIGINT % 32 AS i, greatest(0.0, ln(c.n::DOUBLE * (SELECT sum(total) FROM o)::DOUBLE / (o.total::DOUBLE * q.total::DOUBLE))) * CASE WHEN ('0x' || substring(md5(context), 5, 1))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END AS x FROM c JOIN o USING (token) JOIN o q ON q.token = c.context)
SELECT token, sum(n)::BIGINT AS n, round(sqrt(sum(s * s)), 4) AS norm FROM (SELECT token, i, sum(n) AS n, sum(x) AS s FROM x GROUP BY ALL) GROUP BY token"""
)
def e2_resumed_training(spark, d):
    """Token vectors counted from files over three starts, each going on where the last one stopped."""
    src, state, mark = (scratch(spark, x) for x in ("lines", "counts", "countmark"))
    first = F.transform("tuples", lambda t: F.split(t, "\t")[0]).alias("words")
    lines = latex_tuples(spark, d).select(first, (F.crc32("formula_id") % 3).alias("k"))
    for k in range(3):
        lines.filter(F.col("k") == k).select("words").coalesce(1).write.mode("append").parquet(src)
        V.train_files(spark, src, "words array<string>", state, mark, lambda df: df, 2)
    return V.counted_vectors(spark.read.parquet(state), 32).select("token", "n", F.round(C.norm(F.col("v")), 4).alias("norm"))


@query("SELECT vec_id AS doc_id, 1::BIGINT AS n, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm, 3 AS n_batches FROM embeddings")
def o2_index_resume(spark, d):
    """An index built from files over three starts, each going on where the last one stopped; every vector is in it once."""
    src, index, mark = (scratch(spark, x) for x in ("vsrc", "vindex", "vmark"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    for k in range(3):
        v.filter(F.col("doc_id") % 3 == k).coalesce(1).write.mode("append").parquet(src)
        ingest.build_index(spark, src, "doc_id bigint, v array<float>", index, mark, lambda df: df.withColumn("norm", F.round(C.norm(F.col("v")), 5)))
    built = spark.read.parquet(index)
    n = built.agg(F.countDistinct("batch").cast("int").alias("n_batches"))
    return built.groupBy("doc_id", "norm").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n))  # one row


QUERIES = Q
_ = KEY
