"""Queries of scalar functions, formula structure and embeddings, with their SQL or values computed by hand."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumac.functions import columns as C
from sumac.functions import formula as X
from sumac.operators import embedding as V
from sumac.operators import search as S
from sumac.plans.tables import ANS, KEY, TOP, VEC, answers, topics, vectors
from sumac.runtime import table

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """SQL of rows known by hand."""
    cell = lambda x: "NULL" if x is None else lit(x) if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(cell(x) for x in r) + ')' for r in rows)}) AS t({names})"


# Scalars


@query("SELECT topic_id, list_filter(string_split_regex(replace(replace(t, '<', ''), '>', ' '), '\\s+'), lambda x: x <> '') AS tags FROM (SELECT topic_id, list_aggregate(list_transform(tags, lambda x: '<' || x || '>'), 'string_agg', '') AS t FROM topics)")
def c2_post_tags(spark, d):
    """Tags of all topics written as <a><b> and read back."""
    t = table(spark, d, "topics").select("topic_id", F.array_join(F.transform("tags", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("t"))
    return t.select("topic_id", C.post_tags(F.col("t")).alias("tags"))


@query("SELECT topic_id, list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> '') AS tags FROM (SELECT topic_id, array_to_string(tags, ' , ') || ', ' AS t FROM topics)")
def c3_topic_tags(spark, d):
    return table(spark, d, "topics").select("topic_id", C.topic_tags(F.concat(F.array_join("tags", " , "), F.lit(", "))).alias("tags"))


@query(f"WITH {TOP} SELECT qid, text FROM top")
def c4_query_text(spark, d):
    return topics(spark, d)


@query("SELECT topic_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS judge_text, t AS generation_text FROM (SELECT topic_id, coalesce(title, '') || chr(10) || chr(10) || coalesce(question, '') AS t FROM topics)")
def c5_question_text(spark, d):
    return table(spark, d, "topics").select("topic_id", C.question_text(F.col("title"), F.col("question"), True).alias("judge_text"), C.question_text(F.col("title"), F.col("question"), False).alias("generation_text"))


@query("SELECT DISTINCT topic_id, split_part(topic_id, '.', 1) AS series, TRY_CAST(split_part(topic_id, '.', 2) AS INTEGER) AS number FROM judgements")
def c6_topic_key(spark, d):
    return table(spark, d, "judgements").select("topic_id").distinct().select("topic_id", C.topic_key(F.col("topic_id")).alias("k")).select("topic_id", "k.*")


@query("SELECT DISTINCT answer_id, TRY_CAST(answer_id AS BIGINT) IS NULL AS is_text FROM (SELECT CASE WHEN regexp_matches(answer_id, '^[0-9]+$') THEN answer_id ELSE 'x' || answer_id END AS answer_id FROM judgements)")
def c7_doc_key(spark, d):
    j = table(spark, d, "judgements").select(F.when(F.col("answer_id").rlike("^[0-9]+$"), F.col("answer_id")).otherwise(F.concat(F.lit("x"), "answer_id")).alias("answer_id")).distinct()
    return j.select("answer_id", C.doc_key(F.col("answer_id")).text.alias("is_text"))


_FORMULAS = "f AS (SELECT DISTINCT unnest(formulas).formula_id AS formula_id, unnest(formulas).latex AS latex FROM (SELECT formulas FROM answers UNION ALL SELECT formulas FROM questions))"


def _formulas(spark, d):
    a = table(spark, d, "answers").select(F.explode("formulas").alias("f")).unionByName(table(spark, d, "questions").select(F.explode("formulas").alias("f")))
    return a.select("f.formula_id", "f.latex").distinct()


@query(rf"WITH {_FORMULAS}, s AS (SELECT *, regexp_replace(trim(latex), '(?s)\\begin\{{[^}}]*\}}(.*?)\\end\{{[^}}]*\}}', '\1', 'g') AS s FROM f) SELECT formula_id, latex, trim(CASE WHEN s LIKE '$$%$$' AND length(s) >= 4 THEN s[3:-3] WHEN starts_with(s, '\[') AND ends_with(s, '\]') THEN s[3:-3] WHEN s LIKE '$%$' AND length(s) >= 2 THEN s[2:-2] ELSE s END) AS bare FROM s")
def c8_strip_math(spark, d):
    """All formulas of the collection without delimiters and environments."""
    return _formulas(spark, d).select("formula_id", "latex", C.strip_math(F.col("latex")).alias("bare"))


@query(rf"WITH {_FORMULAS} SELECT formula_id, regexp_replace(latex || ' 50% \% x', '([^\\])%', '\1', 'g') AS clean FROM f")
def c9_drop_percent(spark, d):
    return _formulas(spark, d).select("formula_id", C.drop_percent(F.concat("latex", F.lit(r" 50% \% x"))).alias("clean"))


@query("SELECT doc_id, regexp_replace('<mi>qvar_' || source || '</mi>', '<mi.*?>qvar_(.*)</mi>', '<mws:qvar xmlns:mws=\"http://search.mathweb.org/ns\" name=\"\\1\"/>') AS markup FROM documents WHERE source IS NOT NULL")
def c10_query_variables(spark, d):
    return table(spark, d, "documents").filter("source IS NOT NULL").select("doc_id", C.query_variables(F.concat(F.lit("<mi>qvar_"), "source", F.lit("</mi>"))).alias("markup"))


@query("SELECT topic_id, replace(replace(replace(replace(replace(s, chr(10), '\\n'), '?', '&quest;'), ',', '&comma;'), '[', '&lsqb;'), ']', '&rsqb;') AS clean FROM (SELECT topic_id, regexp_replace(question, '^\\s+|\\s+$', '', 'g') AS s FROM topics)")
def c11_clean_symbol(spark, d):
    return table(spark, d, "topics").select("topic_id", C.clean_symbol(F.col("question")).alias("clean"))


_PATHS = [("nnnnnn", "6n"), ("nnnnn", "nnnnn"), ("nnnaaann", "3n3a2n"), ("-", "-"), ("WWWWWWWWWWWWBWWWWWWWWWWWW", "12W1B12W")]


@query(values([(p, c, p) for p, c in _PATHS], "path, code, back"))
def c12_run_length(spark, d):
    df = spark.createDataFrame([(p,) for p, _ in _PATHS], "path string")
    df = df.select("path", X.run_length_udf()("path").alias("code"))
    return df.select("path", "code", X.run_length_udf(True)("code").alias("back"))


_TAGS = [("V!x", True, False, False, False, True), ("?w", True, True, False, False, False), ("N!2", False, False, True, False, True), ("M!()1x2", False, False, False, True, True), ("=", False, False, False, False, False)]


@query(values(_TAGS, "tag, is_variable, is_wildcard, is_number, is_matrix, has_type"))
def c13_tag_facts(spark, d):
    df = spark.createDataFrame([(t[0],) for t in _TAGS], "tag string")
    return df.select("tag", C.tag_facts(F.col("tag")).alias("t")).select("tag", "t.*")


@query("SELECT tag || chr(9) || '-' AS tuple, erased || chr(9) || '-' AS erased FROM (VALUES ('V!x', 'V!'), ('N!2', 'N!'), ('=', '='), ('U!eq', 'U!')) AS t(tag, erased)")
def c14_erase_types(spark, d):
    df = spark.createDataFrame([(f"{t}\t-",) for t in ("V!x", "N!2", "=", "U!eq")], "tuple string")
    return df.select("tuple", X.erase_types(F.col("tuple")).alias("erased"))


@query(f"SELECT judgement_id, CASE WHEN source = 'batch' THEN NULL ELSE label END - 1 AS delta, label >= 2 AS relevant, {KEY.format('answer_id')} AS key FROM (SELECT DISTINCT judgement_id, source, label, answer_id FROM judgements)")
def c16_label_arithmetic(spark, d):
    """Signed differences and binary relevance with nulls passed on."""
    from sumac.operators.references import normal_key

    j = table(spark, d, "judgements").select("judgement_id", "source", "label", "answer_id").distinct()
    a = C.agreement(F.lit(1), F.when(F.col("source") != "batch", F.col("label")))
    return j.select("judgement_id", a.delta.alias("delta"), (C.binary(F.col("label")) == 1).alias("relevant"), normal_key(F.col("answer_id")).alias("key"))


@query("SELECT judgement_id, sha256(concat_ws('|', topic_id, coalesce(answer_id, ''), coalesce(prompt_sha256, ''), coalesce(judge_model, ''))) AS cache_key, nullif(regexp_extract('qrels_' || CAST(year(judged_at) AS VARCHAR) || '.txt', '(2020|2021|2022)', 1), '') AS year FROM (SELECT DISTINCT judgement_id, topic_id, answer_id, prompt_sha256, judge_model, judged_at FROM judgements)")
def c18_cache_key(spark, d):
    """Label cache keys, and the year told by a file name."""
    j = table(spark, d, "judgements").select("judgement_id", "topic_id", "answer_id", "prompt_sha256", "judge_model", "judged_at").distinct()
    return j.select("judgement_id", C.cache_key(F.col("topic_id"), F.col("answer_id"), F.col("prompt_sha256"), F.col("judge_model")).alias("cache_key"), C.year_of(F.concat(F.lit("qrels_"), F.year("judged_at").cast("string"), F.lit(".txt"))).alias("year"))


_GEN = "g AS (SELECT DISTINCT ON (gen_id) * FROM generations)"


def gens(spark, d):
    """One row per generation; repeats are exact."""
    return table(spark, d, "generations").dropDuplicates(["gen_id"])


@query(f"WITH {_GEN} SELECT gen_id, sha256(concat_ws('|', topic_id, 'faithfulness', coalesce(question, ''), coalesce(response, ''), array_to_string(contexts, chr(10)), '', generator_model)) AS cache_key FROM g")
def c19_metric_key(spark, d):
    """The metric's key folds in contexts, which faithfulness needs, but no reference."""
    k = C.metric_cache_key(F.col("topic_id"), F.lit("faithfulness"), F.col("question"), F.col("response"), F.col("contexts"), F.lit("unused"), F.col("generator_model"), F.lit(True), F.lit(False))
    return gens(spark, d).select("gen_id", k.alias("cache_key"))


_PHRASE = "does not contain enough information"
_PREFIX = "the provided context does not contain"


@query(f"WITH {_GEN} SELECT gen_id, contains(lower(response), '{_PHRASE}') AS anywhere, starts_with(lower(regexp_replace(response, '^\\s+|\\s+$', '', 'g')), '{_PREFIX}') AS first, completion_tokens >= max_new_tokens AS at_ceiling, (completion_tokens >= max_new_tokens) <> coalesce(finish_reason = 'length', false) AS disagrees FROM g")
def c20_refusal_flags(spark, d):
    """Refusal phrase anywhere or first, token ceiling, and its disagreement with the finish reason."""
    r = F.col("response")
    ceiling = C.at_ceiling(F.col("completion_tokens"), F.col("max_new_tokens"))
    return gens(spark, d).select("gen_id", C.refuses_anywhere(r, _PHRASE).alias("anywhere"), C.refuses_first(r, _PREFIX).alias("first"), ceiling.alias("at_ceiling"), (ceiling != F.coalesce(F.col("finish_reason") == "length", F.lit(False))).alias("disagrees"))


@query(f"WITH {VEC} SELECT qid, doc_id, round(1.0 / (1.0 + dist), 6) AS score, round(1.0 - dist / 2.0, 6) AS cosine FROM (SELECT qid, doc_id, list_sum(list_transform(list_zip(q, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM vec CROSS JOIN vq)")
def c23_distance_scores(spark, d):
    from sumac.plans.tables import vector_queries
    from sumac.runtime import broadcast_if_small

    p = vectors(spark, d).crossJoin(broadcast_if_small(vector_queries(spark, d), 10_000)).select("qid", "doc_id", C.distance(F.col("q"), F.col("v")).alias("dist"))
    return p.select("qid", "doc_id", F.round(C.score_of_distance(F.col("dist")), 6).alias("score"), F.round(C.cosine_of_distance(F.col("dist")), 6).alias("cosine"))


_METRICS = [("ndcg_cut_10", "ndcg@10", "ndcg'@10", True), ("P_100", "precision@100", "precision'@100", False), ("recall_5", "recall@5", "recall'@5", True), ("map_cut_1000", "map@1000", "map'@1000", False), ("map", "map", "map'", True), ("bpref", "bpref", "bpref'", True)]


@query(values(_METRICS, "metric, plain, prime, shallow"))
def c26_metric_names(spark, d):
    df = spark.createDataFrame([(m[0],) for m in _METRICS], "metric string")
    return df.select("metric", C.metric_name(F.col("metric")).alias("plain"), C.metric_name(F.col("metric"), True).alias("prime"), C.is_shallow(C.metric_name(F.col("metric"))).alias("shallow"))


@query("SELECT judge_model, count(*) AS n, round(count(*) * 1000 / 1e6 * CASE judge_model WHEN 'judge-large' THEN 2.5e0 WHEN 'judge-small' THEN 0.15e0 WHEN 'judge-mini' THEN 0.1e0 ELSE 0.15e0 END, 6) AS cost FROM judgements GROUP BY judge_model")
def c28_cost(spark, d):
    """Cost of a thousand tokens a judgement."""
    return table(spark, d, "judgements").groupBy("judge_model").agg(F.count(F.lit(1)).alias("n")).select("judge_model", "n", C.cost(F.col("n") * 1000, F.col("judge_model")).alias("cost"))


_USER = "{context}Question:\n{question}\n\nAnswer:"


@query(f"WITH {_GEN} SELECT gen_id, md5(replace(replace('{{context}}Question:' || chr(10) || '{{question}}' || chr(10) || chr(10) || 'Answer:', '{{context}}', CASE WHEN len(contexts) > 0 THEN 'Context:' || chr(10) || array_to_string(contexts, chr(10) || chr(10)) || chr(10) || chr(10) ELSE '' END), '{{question}}', question)) AS user_md5, sha256('Answer from the context.' || chr(10) || '---' || chr(10) || '{{context}}Question:' || chr(10) || '{{question}}' || chr(10) || chr(10) || 'Answer:') AS template FROM g")
def c30_prompt(spark, d):
    """Prompts of all generations from a frozen template, with the template's hash."""
    system = "Answer from the context."
    p = C.prompt(system, _USER, F.col("question"), F.col("contexts"))
    return gens(spark, d).select("gen_id", F.md5(p.user).alias("user_md5"), F.sha2(F.lit(f"{system}\n---\n{_USER}"), 256).alias("template"))


_CELLS = [("1.5", 1.5), ("", None), ("null", None), ("NaN", None), ("None", None), ("abc", None), ("-2", -2.0)]


@query(values(_CELLS, "cell, number"))
def c32_number_or_null(spark, d):
    return spark.createDataFrame([(c[0],) for c in _CELLS], "cell string").select("cell", C.number_or_null(F.col("cell")).alias("number"))


@query("SELECT judgement_id, CASE WHEN parse_ok THEN label END AS label, parse_ok FROM (SELECT DISTINCT judgement_id, label, parse_ok FROM judgements)")
def c33_judge_parse(spark, d):
    """Labels parsed from the raw responses; the stored ones are the truth."""
    j = table(spark, d, "judgements").select("judgement_id", "raw_response").distinct()
    return j.select("judgement_id", C.judge_label(F.col("raw_response")).alias("l")).select("judgement_id", "l.label", "l.parse_ok")


@query(f"WITH {VEC} SELECT doc_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(list_sum(v), 6) AS total, round(list_sum(list_transform(v, lambda x: 2 * x * 2 * x)), 6) AS doubled FROM vec")
def c34_vector_math(spark, d):
    v = F.col("v")
    two = C.plus(v, v)
    return vectors(spark, d).select("doc_id", F.round(C.norm(v), 6).alias("norm"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"), F.round(C.dot(two, C.scaled(v, 2)), 6).alias("doubled"))


# Formula structure

_PMML = "<math><mrow><mi>x</mi><mo>-</mo><msup><mi>y</mi><mn>2</mn></msup><mo>=</mo><mn>0</mn></mrow></math>"
_CMML = "<math><apply><eq/><apply><minus/><ci>x</ci><apply><csymbol>superscript</csymbol><ci>y</ci><cn>2</cn></apply></apply><cn>0</cn></apply></math>"
_SLT = ["V!x - n -", "V!x V!y nn -", "- V!y n n", "- N!2 na n", "- = nn n", "V!y N!2 a nn", "N!2 0! n nna", "V!y = n nn", "V!y N!0 nn nn", "= N!0 n nnn", "N!0 0! n nnnn"]
_OPT = ["U!eq O!minus 0 -", "U!eq O!SUP 01 -", "U!eq V!x 00 -", "O!minus V!x 0 0", "V!x 0! 0 00", "O!minus O!SUP 1 0", "O!minus N!2 11 0", "O!minus V!y 10 0", "O!SUP V!y 0 01", "V!y 0! 0 010", "O!SUP N!2 1 01", "N!2 0! 0 011", "U!eq N!0 0 -", "N!0 0! 0 0"]


@query(values([("slt", t) for t in _SLT] + [("opt", t) for t in _OPT], "kind, tuple"))
def d8_path_tuples(spark, d):
    """All tuples of x - y^2 = 0 with a window of two."""
    df = spark.createDataFrame([(_PMML, _CMML)], "p string, c string")
    both = df.select(F.explode(X.tuples_udf("slt")("p")).alias("t"), F.lit("slt").alias("kind")).unionByName(df.select(F.explode(X.tuples_udf("opt")("c")).alias("t"), F.lit("opt").alias("kind")))
    return both.select("kind", F.replace("t", F.lit("\t"), F.lit(" ")).alias("tuple"))


_TREES = [
    ("slt", _PMML, "[V!x,n[-,n[V!y,n[=,n[N!0]],a[N!2]]]]", 6, 5, 2),
    ("slt", "<math><mfrac><mn>1</mn><msqrt><mi>x</mi></msqrt></mfrac></math>", "[O!divide,o[N!1],u[O!root,w[V!x]]]", 4, 3, 2),
    ("slt", "<math><mfenced><mi>a</mi><mi>b</mi></mfenced></math>", "[M!()1x2,w[V!a,e[V!b]]]", 3, 3, 1),
    ("slt", "<math><munderover><mo>∑</mo><mi>i</mi><mi>n</mi></munderover></math>", "[∑,o[V!n],u[V!i]]", 3, 2, 2),
    ("slt", "<math><msubsup><mo>∫</mo><mn>0</mn><mn>1</mn></msubsup></math>", "[∫,o[N!1],u[N!0]]", 3, 2, 2),
    ("opt", "<math><apply><plus/><ci>a</ci><cn>1</cn></apply></math>", "[U!plus,0[V!a],0[N!1]]", 3, 2, 2),
    ("opt", "<math><apply><ci>f</ci><ci>x</ci></apply></math>", "[F!f,0[V!x]]", 2, 2, 1),
    ("opt", "<math><interval closure='open'><cn>0</cn><cn>1</cn></interval></math>", "[O!interval(O-O),0[N!0],1[N!1]]", 3, 2, 2),
    ("opt", "<math><matrix><matrixrow><cn>1</cn><cn>2</cn></matrixrow></matrix></math>", "[M!M-1x2,0[M!R!,0[N!1],1[N!2]]]", 4, 3, 2),
    ("opt", "<math><apply><and/><apply><lt/><ci>a</ci><ci id='m'>b</ci></apply><apply><lt/><share href='#m'/><ci>c</ci></apply></apply></math>", "[U!and,0[O!lt,0[V!a],1[V!b]],0[O!lt,0[V!b],1[V!c]]]", 7, 3, 4),
]


@query(values([(k, t, s, dep, lv) for k, _, t, s, dep, lv in _TREES], "kind, tree, size, depth, leaves"))
def d11_tree_strings(spark, d):
    """Layout and operator trees as bracket strings, with size, depth and leaves."""
    df = spark.createDataFrame([(k, m) for k, m, *_ in _TREES], "kind string, markup string")
    one = lambda k: df.filter(F.col("kind") == k).select("kind", X.tree_facts_udf(k)("markup").alias("t")).select("kind", "t.*")
    return one("slt").unionByName(one("opt"))


@query(values([("opt", "<math><semantics><mi>x</mi></semantics></math>", 0), ("slt", "<math><semantics><mi>x</mi></semantics></math>", 1), ("slt", "not xml", 0)], "kind, markup, n_tuples"))
def d2_isolate(spark, d):
    """Presentation or content part of combined markup; what cannot be read has no tuples."""
    df = spark.createDataFrame([("opt", "<math><semantics><mi>x</mi></semantics></math>"), ("slt", "<math><semantics><mi>x</mi></semantics></math>"), ("slt", "not xml")], "kind string, markup string")
    one = lambda k: df.filter(F.col("kind") == k).select("kind", "markup", F.size(X.tuples_udf(k)("markup")).alias("n_tuples"))
    return one("slt").unionByName(one("opt"))


@query(values([("value", "n:x n:- e:n e:-"), ("type", "n:V! n:- e:n e:-"), ("separated", "n:V! n:x n:- e:n e:-"), ("whole", "n:V!x n:- e:n e:-")], "mode, tokens"))
def d13_tokens(spark, d):
    df = spark.createDataFrame([("V!x\t-\tn\t-",)], "t string")
    out = None
    for mode in ("value", "type", "separated", "whole"):
        one = df.select(F.lit(mode).alias("mode"), F.array_join(X.tuple_tokens(F.col("t"), mode), " ").alias("tokens"))
        out = one if out is None else out.unionByName(one)
    return out


# Tuples of the collection: LaTeX tokens stand for tree nodes where no MathML is at hand

_LATEX_TUPLES = rf"""{_FORMULAS}, lt AS (SELECT formula_id, list_filter(regexp_extract_all(latex, '\\[A-Za-z]+|[A-Za-z]|[0-9]+|[^\sA-Za-z0-9\\$]'), lambda x: x <> '') AS w FROM f),
tu AS (SELECT formula_id, list_transform(range(1, len(w)), lambda k: w[k] || chr(9) || w[k + 1] || chr(9) || 'n' || chr(9) || '-') AS tuples FROM lt)"""


def latex_tuples(spark, d):
    """formula_id, tuples of neighbouring LaTeX tokens of all formulas."""
    w = _formulas(spark, d).select("formula_id", F.regexp_extract_all("latex", F.lit(r"\\[A-Za-z]+|[A-Za-z]|[0-9]+|[^\sA-Za-z0-9\\$]"), F.lit(0)).alias("w"))
    pair = lambda k: F.concat_ws("\t", F.get("w", k), F.get("w", k + 1), F.lit("n"), F.lit("-"))
    return w.select("formula_id", F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), pair)).otherwise(F.array().cast("array<string>")).alias("tuples"))


@query(f"WITH {_LATEX_TUPLES}, tok AS (SELECT DISTINCT 'N' AS kind, unnest(list_concat(list_transform(tuples, lambda t: string_split(t, chr(9))[1]), list_transform(tuples, lambda t: string_split(t, chr(9))[2]))) AS token FROM tu UNION SELECT 'E', unnest(['n', '-'])) SELECT kind, token, (CASE WHEN kind = 'N' THEN 60000 ELSE 500 END + row_number() OVER (PARTITION BY kind ORDER BY token) - 1)::BIGINT AS id FROM tok")
def d14_token_ids(spark, d):
    """Injective ids of all node and edge tokens of the collection, by sorted token."""
    from sumac.sources.writers import token_map

    t = latex_tuples(spark, d).select(F.explode("tuples").alias("t"))
    p = F.split("t", "\t")
    n = t.select(F.lit("N").alias("kind"), F.explode(F.slice(p, 1, 2)).alias("token"))
    e = t.select(F.lit("E").alias("kind"), F.explode(F.slice(p, 3, 2)).alias("token"))
    return token_map(n.unionByName(e))


@query(f"WITH {_LATEX_TUPLES}, g AS (SELECT formula_id, len(tuples) AS n, list_distinct(list_filter(flatten(list_transform(tuples, lambda t: string_split(t, chr(9))[1:2])), lambda x: x <> '0!')) AS tags FROM tu) SELECT formula_id, n = 0 OR len(tags) <= 1 AS trivial FROM g")
def d15_triviality(spark, d):
    return latex_tuples(spark, d).select("formula_id", X.is_trivial(F.col("tuples"), False).alias("trivial"))


_SEL = r"""tf AS (SELECT topic_id, unnest(formulas) AS f, generate_subscripts(formulas, 1) AS pos FROM topics),
s AS (SELECT topic_id, pos, f.formula_id AS fid, f.in_title AS in_title, trim(regexp_replace(f.latex, '^\$|\$$', '', 'g')) AS bare, len(list_filter(regexp_extract_all(f.latex, '\\[A-Za-z]+|[A-Za-z]|[0-9]+'), lambda x: x <> '')) AS n FROM tf)"""


def _topic_formulas(spark, d):
    t = table(spark, d, "topics").select("topic_id", F.posexplode("formulas").alias("pos", "f"))
    n = F.size(F.regexp_extract_all("f.latex", F.lit(r"\\[A-Za-z]+|[A-Za-z]|[0-9]+"), F.lit(0)))
    return t.select("topic_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("f.formula_id").alias("fid"), F.col("f.in_title").alias("in_title"), F.trim(F.regexp_replace("f.latex", r"^\$|\$$", "")).alias("bare"), n.alias("n"))


@query(f"WITH {_SEL}, u AS (SELECT *, row_number() OVER (PARTITION BY topic_id, bare ORDER BY pos) AS k FROM s), v AS (SELECT *, count_if(n > 1) OVER (PARTITION BY topic_id) AS good, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, pos) AS best FROM u WHERE k = 1) SELECT topic_id, fid FROM v WHERE n > 1 OR (good = 0 AND best = 1)")
def d16_select_fanout(spark, d):
    """Distinct non-trivial formulas of each topic, else the one with most tokens."""
    from pyspark.sql import Window

    u = S.top(_topic_formulas(spark, d), ["topic_id", "bare"], [F.asc("pos")], 1, "k")
    w = Window.partitionBy("topic_id")
    v = u.withColumn("good", F.count_if(F.col("n") > 1).over(w)).withColumn("best", F.row_number().over(w.orderBy(F.desc("n"), "pos")))
    return v.filter("n > 1 OR (good = 0 AND best = 1)").select("topic_id", "fid")


@query(f"WITH {_SEL} SELECT topic_id, fid FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY n <= 1, NOT in_title, n DESC, pos) AS k FROM s) WHERE k = 1")
def d17_select_one(spark, d):
    return S.top(_topic_formulas(spark, d), ["topic_id"], [F.col("n") <= 1, ~F.col("in_title"), F.desc("n"), F.asc("pos")], 1, "k").select("topic_id", "fid")


_CONT = rf"""{ANS}, {_LATEX_TUPLES.replace("f AS (SELECT DISTINCT", "f0 AS (SELECT 1), f AS (SELECT DISTINCT")},
qf AS (SELECT DISTINCT q.id AS qid, unnest(q.formulas).formula_id AS formula_id FROM questions q), af AS (SELECT id AS aid, parent_id AS qid, unnest(formulas).formula_id AS formula_id FROM ans),
qt AS (SELECT qid, formula_id, list_distinct(tuples) AS qt FROM qf JOIN tu USING (formula_id)), ta AS (SELECT aid, qid, list_distinct(tuples) AS at_ FROM af JOIN tu USING (formula_id)),
c AS (SELECT qid, aid, max(CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, at_)) / len(qt)::DOUBLE END) AS best FROM qt JOIN ta USING (qid) GROUP BY ALL)"""


@query(f"WITH {_CONT} SELECT qid, count(*) AS n_answers, round(avg(best), 6) AS mean, round(max(best), 6) AS most, round(list_avg(list_reverse_sort(list(best))[1:5]), 6) AS top_5 FROM c GROUP BY qid")
def d19_containment(spark, d):
    """Best containment of a question's formula in an answer's: mean, maximum and mean of the best five over the question's answers."""
    tu = latex_tuples(spark, d)
    q = table(spark, d, "questions").select(F.col("id").alias("qid"), F.explode("formulas.formula_id").alias("formula_id")).distinct().join(tu, "formula_id").select("qid", F.array_distinct("tuples").alias("qt"))
    a = answers(spark, d).select(F.col("id").alias("aid"), F.col("parent_id").alias("qid"), F.explode("formulas.formula_id").alias("formula_id")).join(tu, "formula_id").select("aid", "qid", F.array_distinct("tuples").alias("at"))
    c = q.join(a, "qid").groupBy("qid", "aid").agg(F.max(X.containment(F.col("qt"), F.col("at"))).alias("best"))
    c = S.top(c, ["qid"], [F.desc("best"), F.asc("aid")], None, "r")
    return c.groupBy("qid").agg(F.count(F.lit(1)).alias("n_answers"), F.round(F.avg("best"), 6).alias("mean"), F.round(F.max("best"), 6).alias("most"), F.round(F.avg(F.when(F.col("r") <= 5, F.col("best"))), 6).alias("top_5"))


@query(f"WITH {_LATEX_TUPLES}, e AS (SELECT formula_id, unnest(tuples) AS t FROM tu), voc AS (SELECT t FROM e GROUP BY t HAVING count(*) >= 5) SELECT formula_id, count(*) AS n, count(voc.t) AS known, round(count(voc.t) / count(*)::DOUBLE, 6) AS share FROM e LEFT JOIN voc USING (t) GROUP BY formula_id")
def d20_coverage(spark, d):
    """Share of a formula's tuples that occur at least five times in the collection."""
    e = latex_tuples(spark, d).select("formula_id", F.explode("tuples").alias("t"))
    voc = e.groupBy("t").agg(F.count(F.lit(1)).alias("k")).filter("k >= 5").select("t", F.lit(1).alias("in_voc"))
    return e.join(voc, "t", "left").groupBy("formula_id").agg(F.count(F.lit(1)).alias("n"), F.count("in_voc").alias("known"), F.round(F.count("in_voc") / F.count(F.lit(1)), 6).alias("share"))


# Embeddings


@query(f"WITH {_LATEX_TUPLES} SELECT count(DISTINCT t) AS n, 150 AS dim, 0::BIGINT AS n_bad FROM (SELECT unnest(tuples) AS t FROM tu)")
def e1_train_tokens(spark, d):
    """Token vectors of all the collection's tuples with the operator's own settings: tokens, dimension, vectors without a direction."""
    lines = latex_tuples(spark, d).filter("size(tuples) > 0").select(F.col("tuples").alias("words"))
    v = V.train(lines)
    n = C.norm(F.col("v"))
    return v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.count_if(F.isnan(n) | (n <= 0)).alias("n_bad"))


@query(f"WITH {VEC}, tok AS (SELECT 'k' || label AS token, v FROM (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS n FROM vec) WHERE n = 1), s AS (SELECT doc_id, unnest(['k' || label, 'k' || (label + 1) % 12, 'unknown']) AS token FROM vec), j AS (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s JOIN tok USING (token)) SELECT doc_id, round(sum(m * m), 6) AS sq, round(sum(m), 6) AS total FROM (SELECT doc_id, i, avg(x) AS m FROM j GROUP BY ALL) GROUP BY doc_id")
def e3_sentence_vectors(spark, d):
    """Means over in-vocabulary tokens only."""
    v = vectors(spark, d)
    tok = S.top(v, ["label"], [F.asc("doc_id")], 1, "n").select(F.concat(F.lit("k"), "label").alias("token"), "v")
    s = v.select("doc_id", F.explode(F.array(F.concat(F.lit("k"), "label"), F.concat(F.lit("k"), (F.col("label") + 1) % 12), F.lit("unknown"))).alias("token"))
    m = V.sentence_vectors(s, tok, "doc_id", 64)
    return m.select("doc_id", F.round(C.dot(F.col("v"), F.col("v")), 6).alias("sq"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"WITH {VEC}, p AS (SELECT doc_id, label, v, list_reverse(v) AS r FROM vec), s AS (SELECT doc_id, list_transform(list_zip(v, r), lambda p: p[1] + p[2]) AS t FROM p) SELECT doc_id, round(t[1] / sqrt(list_sum(list_transform(t, lambda x: x * x))), 6) AS first, round(t[20] / sqrt(list_sum(list_transform(t, lambda x: x * x))), 6) AS twentieth FROM s")
def e5_fused_vector(spark, d):
    """Unit sum of unit parts: a vector and its reversal."""
    f = C.fused(F.col("v"), F.reverse("v"))
    return vectors(spark, d).select("doc_id", f.alias("f")).select("doc_id", F.round(F.get("f", F.lit(0)), 6).alias("first"), F.round(F.get("f", F.lit(19)), 6).alias("twentieth"))


@query(f"WITH {VEC}, mean AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec) GROUP BY i)), s AS (SELECT doc_id, list_transform(list_zip(v, m), lambda p: p[1] - p[2]) AS t FROM vec CROSS JOIN mean) SELECT doc_id, round(t[1] / sqrt(list_sum(list_transform(t, lambda x: x * x))), 5) AS first FROM s")
def e6_mean_shift(spark, d):
    return V.mean_shift(vectors(spark, d), "doc_id").select("doc_id", F.round(F.get("v", F.lit(0)), 5).alias("first"))


@query(f"WITH {VEC}, n AS (SELECT sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM vec) SELECT count(*) AS n, 64::BIGINT AS dim, round(avg(n), 6) AS norm_mean, round(stddev_pop(n), 6) AS norm_std, round(min(n), 6) AS norm_min, round(max(n), 6) AS norm_max FROM n")
def e8_vector_statistics(spark, d):
    return V.statistics(vectors(spark, d))


@query(f"WITH {VEC}, u AS (SELECT doc_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM vec) SELECT count(*) AS n_pairs, round(avg(list_inner_product(a.u, b.u)), 6) AS mean_cosine FROM u a JOIN u b ON a.doc_id < b.doc_id")
def e9_cone(spark, d):
    """Mean cosine of all pairs, from the sum of the unit vectors."""
    return V.cone(vectors(spark, d))


@query(f"WITH {VEC} SELECT a.label AS grade, count(*) AS n, round(avg(greatest(0, least(1, list_inner_product(a.v, b.v)))), 5) AS mean_cosine FROM vec a JOIN vec b ON b.doc_id = a.doc_id + 1 GROUP BY a.label")
def e10_golden_pairs(spark, d):
    """Clamped cosine of neighbouring vectors, by grade."""
    v = vectors(spark, d)
    p = v.select((F.col("doc_id") + 1).alias("doc_id"), F.col("label").alias("grade"), F.col("v").alias("a")).join(v.select("doc_id", F.col("v").alias("b")), "doc_id")
    return V.golden_cosine(p).groupBy("grade").agg(F.count("cosine").alias("n"), F.round(F.avg("cosine"), 5).alias("mean_cosine"))


QUERIES = Q
_ = T
