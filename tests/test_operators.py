"""Cases computed by hand, and brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sumac.config import GenerationConfig, JudgeConfig, RunConfig
from sumac.functions import formula as X
from sumac.operators import evaluation as E
from sumac.operators import fusion as M
from sumac.operators import rag as R
from sumac.operators import search as S
from sumac.sources import readers, writers


def run(spark, rows):
    return spark.createDataFrame(rows, "run string, qid string, doc_id string, score double")


def test_hole_rate(spark):
    rows = [("r", "Q1", f"d{k}", 10.0 - k) for k in range(1, 5)] + [("r", "Q2", f"d{k}", 10.0 - k) for k in range(5, 8)]
    q = spark.createDataFrame([("Q1", "d1", 2), ("Q1", "d3", 0), ("Q2", "d5", 1), ("Q2", "d6", 0), ("Q2", "d7", 3)], "qid string, doc_id string, rel int")
    r = E.trec_order(run(spark, rows), ["run", "qid"])
    for k, want in ((2, 0.25), (4, 0.25)):
        per = E.hole_rate(r, q, k, ["run", "qid"]).collect()
        assert sum(x.hole_rate for x in per) / 2 == want
    assert E.hole_rate(r.filter("qid = 'Q9'"), q, 2, ["run", "qid"]).count() == 0
    with pytest.raises(ValueError):
        E.hole_rate(r, q, 0, ["qid"])


def test_ndcg_by_hand(spark):
    q = spark.createDataFrame([("q", "a", 3), ("q", "b", 0), ("q", "c", 2), ("q", "d", 1)], "qid string, doc_id string, rel int")
    r = run(spark, [("r", "q", "a", 3.0), ("r", "q", "b", 2.0), ("r", "q", "c", 1.0)])
    got = E.measures(r, q, (3,), by=("run",)).first()
    assert got.ndcg_3 == pytest.approx(4 / (3 + 2 / math.log2(3) + 0.5), abs=1e-6)
    assert got.p_3 == pytest.approx(2 / 3, abs=1e-6)


def brute_bpref(ranked, rel):
    R_, N = sum(v >= 2 for v in rel.values()), sum(v < 2 for v in rel.values())
    non, total = 0, 0.0
    for d in ranked:
        if d in rel:
            if rel[d] >= 2:
                total += 1 - min(non, R_) / min(R_, N) if min(R_, N) else 1.0
            else:
                non += 1
    return total / R_ if R_ else 0.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-1, 3), min_size=3, max_size=12))
def test_measures_brute_force(spark, grades):
    docs = [f"d{k:02}" for k in range(len(grades))]
    rel = {d: g for d, g in zip(docs, grades, strict=True) if g >= 0}
    if not rel:
        return
    r = run(spark, [("r", "q", d, float(len(docs) - k)) for k, d in enumerate(docs)])
    q = spark.createDataFrame([("q", d, g) for d, g in rel.items()], "qid string, doc_id string, rel int")
    got = E.measures(r, q, (5,), by=("run",)).first()
    n_rel, seen, ap = sum(v >= 2 for v in rel.values()), 0, 0.0
    for k, d in enumerate(docs, 1):
        if rel.get(d, 0) >= 2:
            seen += 1
            ap += seen / k
    assert got.map == pytest.approx(ap / n_rel if n_rel else 0, abs=2e-6)
    assert got.bpref == pytest.approx(brute_bpref(docs, rel), abs=2e-6)


def test_fusion_by_hand(spark):
    r = run(spark, [("a", "q", "d", 1.0), ("b", "q", "d", 1.0)])
    assert M.rrf(r).first().score == pytest.approx(2 / 61, abs=1e-9)
    assert M.combsum(r).first().score == 1.0
    assert M.combsum(r, mnz=True).first().score == 2.0
    assert M.combsum(run(spark, [])).count() == 0


def test_collapse_before_truncate(spark):
    hits = spark.createDataFrame([("t", f"f{k}", 4.0 - k) for k in range(4)], "qid string, formula_id string, score double")
    vis = spark.createDataFrame([("f0", "a", "p"), ("f1", "a", "p"), ("f2", "b", "p"), ("f3", "c", "p")], "formula_id string, visual_id string, post_id string")
    top = spark.createDataFrame([("t", "own", "z")], "qid string, post_id string, visual_id string")
    assert [x.visual_id for x in S.exclude_and_collapse(hits, vis, top, 2).orderBy("rank").collect()] == ["a", "b"]


def test_references(spark):
    q = spark.createDataFrame([("t", str(k), 3 if k < 3 else 2) for k in range(7)], "qid string, doc_id string, rel int")
    a = spark.createDataFrame([(str(k), k % 3, f"text {k}") for k in range(7)], "id string, score int, body_text string")
    got = R.references(q, a).first()
    assert got.answer_ids_used == ["2", "1", "0", "5", "4"] and got.n_high_used == 3 and got.fallback_used
    with pytest.raises(ValueError):
        R.contexts("run", q)


def test_composite_identity(spark):
    s = spark.createDataFrame([("c", 0.5, False), ("c", 0.9, True), ("c", 0.7, False)], "config string, value double, is_refusal boolean")
    got = R.accounting(s, ["config"]).first()
    assert got.drift == pytest.approx(0, abs=1e-6) and got.composite == pytest.approx(0.4, abs=1e-6)


def test_exact_search_with_ties(spark):
    v = spark.createDataFrame([(k, [1.0, 0.0] if k < 5 else [0.0, 1.0]) for k in range(8)] + [(9, None)], "doc_id bigint, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid bigint, q array<double>")
    assert [x.doc_id for x in S.exact_search(v, q, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert S.exact_search(v, q.filter("qid = 7"), 3).count() == 0
    assert S.exact_search(v.filter("doc_id > 50"), q, 3).count() == 0


def test_cells_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    v = spark.createDataFrame([(k, [float(y) for y in r]) for k, r in enumerate(x)], "doc_id bigint, v array<double>")
    q = v.filter("doc_id % 20 = 0").selectExpr("doc_id AS qid", "v AS q")
    exact = {(r.qid, r.doc_id) for r in S.exact_search(v, q, 10, "l2").collect()}
    assert {(r.qid, r.doc_id) for r in S.cell_search(v, q, 10, 8, 8).collect()} == exact
    near = {(r.qid, r.doc_id) for r in S.cell_search(v, q, 10, 8, 6).collect()}
    assert len(near & exact) >= 0.9 * len(exact)


def test_trivial_and_containment(spark):
    df = spark.createDataFrame([(["V!x\t0!\tn\t-"], ["V!x\t0!\tn\t-"]), ([], ["a"]), (["U!eq\tV!x\t0\t-"], [])], "a array<string>, b array<string>")
    got = df.select(X.is_trivial(df.a, True).alias("t"), X.containment(df.a, df.b).alias("c")).collect()
    assert [(r.t, r.c) for r in got] == [(True, 1.0), (True, 0.0), (False, 0.0)]


@given(st.text("nabou", min_size=0, max_size=30))
def test_run_length_round_trip(path):
    assert X.run_length_back(X.run_length(path)) == path


def test_tree_round_trip_and_split():
    kids = "".join(f"<ci>x{k}</ci>" for k in range(100))
    t = X.operator_tree(X.parse_xml(f"<math><apply><plus/>{kids}</apply></math>"))
    assert max(len(n.edges) for n in [t, *[k for _, k in t.edges]]) <= X.MAX_KIDS and t.leaves() == 100
    assert X.written(X.read_tree(X.written(t))) == X.written(t)
    assert X.tuples_of("", "slt") == [] and X.tuples_of(None, "opt") == [] and X.tuples_of("<math/>", "slt") == []
    assert "digraph" in X.graph(t)


def test_configs(tmp_path):
    p = tmp_path / "run.yaml"
    p.write_text("name: x\ntop_k: 10  # depth\nb: 0.5\n")
    c = RunConfig.load(str(p))
    assert (c.name, c.top_k, c.b) == ("x", 10, 0.5)
    for bad in (lambda: RunConfig("x", fusion="no"), lambda: RunConfig("x", b=2), lambda: JudgeConfig("m", chunk=8000), lambda: GenerationConfig("m", k=3), lambda: RunConfig.read({"name": "x", "other": 1})):
        with pytest.raises(ValueError):
            bad()


def test_run_files(spark, tmp_path):
    good, empty = tmp_path / "a", tmp_path / "b"
    good.write_text("q\td\t1\t0.5\tr\n")
    empty.write_text("")
    assert readers.checked_runs(spark, [str(good), str(good)])
    for bad in ([str(good)], [str(good), str(empty)]):
        with pytest.raises(ValueError):
            readers.checked_runs(spark, bad)
    with pytest.raises(FileNotFoundError):
        readers.checked_runs(spark, [str(good), str(tmp_path / "none")])
    q = spark.createDataFrame([("A.1", "2", 3)], "qid string, doc_id string, rel int")
    writers.write_qrels(q, str(tmp_path / "q"))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        writers.write_qrels(q, str(tmp_path / "q"))
    assert "| a |" in writers.markdown([{"a": 1}], ["a"], "t")


def test_search_in_blocks_and_without_broadcast(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(k, [float(y) for y in r]) for k, r in enumerate(rng.normal(size=(60, 4)))], "doc_id bigint, v array<double>")
    q = v.filter("doc_id % 20 = 0").selectExpr("doc_id AS qid", "v AS q")
    rows = lambda df: sorted(map(tuple, df.select("qid", "doc_id", "rank").collect()))
    assert rows(S.exact_search(v, q, 5, max_queries=1)) == rows(S.exact_search(v, q, 5))
    docs = spark.createDataFrame([(k, f"ring {'field ' * (k % 4)} x{k}") for k in range(20)] + [(90, None), (91, "")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "ring field"), (2, "x3 nothing"), (3, None)], "qid bigint, text string")
    index = S.TextIndex(docs)
    assert rows(S.bm25(index, asked, 5, max_query_terms=0)) == rows(S.bm25(index, asked, 5))
    assert {r.qid for r in S.bm25(index, asked).collect()} == {1, 2}


def test_union_guard(spark):
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"


def test_lossless_join_fails_loudly(spark):
    from sumac.operators import agreement as A

    h = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "qid string, doc_id string, rel int")
    with pytest.raises(Exception, match="missing or repeated"):
        A.paired(h, h.filter("doc_id = 'a'"), lossless=True).collect()
    assert A.paired(h, h, lossless=True).count() == 2


def test_kappa_by_hand(spark):
    from sumac.operators import agreement as A

    p = spark.createDataFrame([(3, 3), (3, 0), (0, 0), (0, 0), (None, 1)], "human int, judge int")
    got = A.kappa(p).first()
    # observed 3/4; chance (2*1 + 2*3)/16 = 1/2
    assert got.n == 4 and got.kappa == 0.5 and got.kappa_binary == 0.5 and got.agree == 0.75
    assert A.kappa(p.limit(0)).first().n == 0
    s = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 3.0, 2.0)], "system string, x double, y double")
    t = A.kendall(s).first()
    assert t.tau == 1.0 and t.tau_b == pytest.approx(2 / math.sqrt(6), abs=1e-6)
    assert A.spearman(s).first().rho == pytest.approx(math.sqrt(3) / 2, abs=1e-6)


def test_stored_text_index_is_kept_or_forced(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"ring {'field ' * (k % 4)} x{k}") for k in range(20)] + [(90, None)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "ring field"), (2, "x3 nothing"), (3, None)], "qid bigint, text string")
    rows = lambda df: sorted(map(tuple, df.select("qid", "doc_id", "rank", "score").collect()))
    want, path = rows(S.bm25(S.TextIndex(docs), asked, 5)), str(tmp_path / "text")
    index = S.build_text_index(docs, path)
    assert rows(S.bm25(index, asked, 5)) == want == rows(S.bm25(index, asked, 5, max_query_terms=0))
    assert rows(S.bm25(S.build_text_index(docs.limit(0), path), asked, 5)) == want
    assert S.build_text_index(docs, path, force=True, limit=3).totals.first().n == 3


def test_stored_cells(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(k, [float(y) for y in r]) for k, r in enumerate(rng.normal(size=(300, 8)))] + [(900, None)], "doc_id bigint, v array<double>")
    q = v.filter("doc_id % 20 = 0 AND v IS NOT NULL").selectExpr("doc_id AS qid", "v AS q")
    exact = {(r.qid, r.doc_id) for r in S.exact_search(v, q, 10, "l2").collect()}
    for store, least in (("whole", 1.0), ("half", 0.98), ("byte", 0.9)):
        index = S.build_cell_index(v, str(tmp_path / store), 8, store)
        found = {(r.qid, r.doc_id) for r in index.search(q, 10, 8).collect()}
        assert len(found & exact) >= least * len(exact) and index.cells.count() == 300
        assert S.build_cell_index(v.limit(0), str(tmp_path / store), 8, store).cells.count() == 300
    assert S.build_cell_index(v, str(tmp_path / "half"), 8, "half", force=True).search(q.limit(0), 10, 2).count() == 0
    files = S.build_cell_index(v, str(tmp_path / "whole")).search(q.limit(1), 10, 1)
    assert 0 < files.count() <= 10


def test_hash_sample_has_its_size(spark):
    v = spark.range(3000).selectExpr("id AS doc_id", "array(1.0D) AS v")
    assert S.training_sample(v, 16).distinct().count() == 640 and S.training_sample(v.limit(50), 16).count() == 50
    assert S.hash_sample(v, "doc_id", 0).count() == 0 and S.hash_sample(v, "doc_id", 1234).count() == 1234


def test_the_last_line_wins_across_files_and_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("q 0 d 0\n")
    (tmp_path / "b.txt").write_text("".join(f"q 0 e{k} 1\n" for k in range(3000)) + "q 0 d 2\nq 0 d 3\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.doc_id: r.rel for r in readers.qrels(spark, str(tmp_path)).collect()}
        assert got["d"] == 3 and len(got) == 3001
        (tmp_path / "r.run").write_text("".join(f"q Q0 d{k} {k} 0.5 n\n" for k in range(2000)))
        order = [r.doc_id for r in readers.run(spark, str(tmp_path / "r.run")).orderBy("pos").collect()]
        assert order == [f"d{k}" for k in range(2000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_unreadable_shards_are_errors_or_named(spark, tmp_path):
    (tmp_path / "1.tsv").write_text("id\tformula\n1\tx\n")
    (tmp_path / "2.tsv.gz").write_bytes(b"no gzip")
    schema = "id string, formula string"
    with pytest.raises(Exception):
        readers.numbered_tsv(spark, str(tmp_path), schema).collect()
    assert readers.numbered_tsv(spark, str(tmp_path), schema, skip_unreadable=True).count() == 1
    assert [r.file_name for r in readers.skipped_files(spark, str(tmp_path)).collect()] == ["2.tsv.gz"]


def test_judge_messages(spark):
    p = spark.createDataFrame([("Why?", None)], "question string, answer_text string")
    m = R.judge_messages(p, "Q {question} A {answer_text}", "S", [{"question": "q", "answer": "a", "reasoning": "r", "label": 2}], "model").first().messages
    assert [(x.role, x.content) for x in m] == [("system", "S"), ("user", "Q q A a"), ("model", "r\nLABEL: 2"), ("user", "Q Why? A ")]


def test_latex_markup(spark):
    from sumac.functions import latex as L

    assert L.presentation("\\frac{a}{b}") == "<math><mrow><mfrac><mi>a</mi><mi>b</mi></mfrac></mrow></math>"
    assert L.content("1<x<2").count("<lt/>") == 2 and L.content("\\sin(x) + |y|") == "<math><apply><plus/><apply><sin/><ci>x</ci></apply><apply><abs/><ci>y</ci></apply></apply></math>"
    for unsure in ("3 \\pmod{4}", "\\int f", "6!", "a +", "", None, " $$ $$ "):
        assert L.content(unsure) is None
    assert "<mtr>" in L.presentation("\\begin{pmatrix} 1 & v \\\\ z & 69 \\end{pmatrix}") and L.presentation("{" * 5000) is None and L.presentation("}}^") is not None
    df = spark.createDataFrame([(1, "x^2"), (2, None)], "id int, latex string")
    got = {r.id: (r.pmml, r.cmml) for r in L.converted(df, converter=lambda: lambda t: (t, None)).collect()}
    assert got == {1: ("x^2", None), 2: (None, None)} and L.converted(df.limit(0)).count() == 0


def test_encoder_and_poll(spark):
    from sumac.operators import embedding as V
    from sumac.streaming import ingest

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.v for r in V.encoded(df, lambda: lambda ts: np.array([[len(t), 1.0] for t in ts]), batch=1).collect()}
    assert got == {1: [3.0, 1.0], 2: None, 3: [0.0, 1.0]}
    states = iter(["queued", "RUNNING", "Succeeded"])
    assert ingest.poll(lambda: next(states), pause=0.01) == "succeeded"
    with pytest.raises(TimeoutError):
        ingest.poll(lambda: "running", pause=0.01, most=0.02)


def test_unknown_content_elements_have_no_tuples():
    assert X.tuples_of("<math><apply><frobnicate/><ci>x</ci></apply></math>", "opt") == [] and X.tree_of("<math><apply><frobnicate/><ci>x</ci></apply></math>", "opt") is None


def test_ties_do_not_swell_a_batch():
    s = np.array([[0.5] * 50, [*range(50)], [0.1] * 40 + [0.9] * 10])
    want = [sorted(range(50), key=lambda i: (-row[i], i))[:12] for row in s]
    assert [sorted(np.flatnonzero(r)) for r in S.first_k(s, 12)] == [sorted(w) for w in want]
    asked, v = np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([[1.0, 0.0]] * 500)
    found = list(S.best_of(asked, v, 3, "ip"))
    assert [(q.tolist(), d.tolist()) for q, d, _ in found] == [([0, 0, 0, 1, 1, 1], [0, 1, 2, 0, 1, 2])]


def test_formulas_written_alike_are_searched_once(spark):
    from sumac.operators import embedding as V

    latex = ["$a$", "$a$", "$b$", "$a b$", "$ b a $", "$$", None]
    formulas = spark.createDataFrame([(f"f{k:03}", latex[k % len(latex)]) for k in range(140)], "formula_id string, latex string")
    queries = spark.createDataFrame([("q1", "x", "$a$"), ("q1", "y", "$a b$"), ("q2", "x", "$a$"), ("q2", "x", "$b$"), ("q2", "z", "$$")], "qid string, fid string, latex string")
    owners = formulas.select("formula_id", F.concat(F.lit("d"), "formula_id").alias("doc_id"))
    vector = V.hashed_units(F.regexp_extract_all("latex", F.lit("[a-z]"), F.lit(0)))
    got = S.formula_search(formulas, queries, owners.union(owners), vector, 30)
    v = {r.latex: r.v for r in formulas.union(queries.select("fid", "latex")).select("latex").distinct().select("latex", vector.alias("v")).collect()}
    assert v[None] is None and v["$$"] is None and v["$a b$"] == v["$ b a $"]
    want = []
    for qid, fid in {(q.qid, q.fid) for q in queries.collect()}:
        of = [v[q.latex] for q in queries.collect() if (q.qid, q.fid) == (qid, fid) and v[q.latex]]
        near = sorted((-round(float(np.dot(q, v[f.latex])), 6) + 0.0, f.formula_id) for f in formulas.collect() if v[f.latex] for q in of)
        want += [(qid, fid, f, f"d{f}", n + 1) for n, (_, f) in enumerate(near[:30])]
    assert sorted(map(tuple, got.select("qid", "fid", "formula_id", "doc_id", "rank").collect())) == sorted(want)


def test_tied_hits_of_a_batch_are_cut_before_they_are_merged(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(S, "top", lambda df, by, order, k, name="rank", top=S.top: sent.append(df) or top(df, by, order, k, name))
    v = spark.createDataFrame([(f"f{k:03}", [1.0, 0.0]) for k in range(200)], "doc_id string, v array<double>").coalesce(1)
    q = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "qid string, q array<double>")
    hits = S.exact_search(v, q, 5)
    assert sent[0].count() == 10
    merged = S.merge_formula_hits(hits.select(F.lit("t").alias("qid"), "doc_id", "rank"))
    assert [(r.doc_id, r.score) for r in merged.orderBy("rank").collect()] == [(f"f{k:03}", round(2 / (k + 61), 9)) for k in range(5)]


def test_blocks_of_a_stored_index_send_their_best_only(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{n}" for n in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 12))) + (" the" if n % 2 else "") for n in range(90)]
    docs = spark.createDataFrame([(n % 80, texts[n % 45]) for n in range(90)] + [(900, None)], "doc_id bigint, text string").coalesce(2)  # ids given twice, ties
    asked = spark.createDataFrame([(n, " ".join(rng.choice(words, 3)) + (" the" if n % 3 else "")) for n in range(40)] + [(41, None)], "qid bigint, text string")
    rows = lambda df: sorted(map(tuple, df.select("qid", "doc_id", "rank", "score").collect()))
    monkeypatch.setattr(S, "BLOCK_WORDS", 100)
    index = S.build_text_index(docs, str(tmp_path / "i"))
    of = {n: [w for m in range(90) if m % 80 == n for w in texts[m % 45].split()] for n in range(80)}
    first = {n: len(texts[n % 45].split()) for n in range(80)}
    each = [len(t.split()) for t in (texts[n % 45] for n in range(90)) if t.split()]
    assert index.totals.first()[:2] == (len(each), pytest.approx(np.mean(each)))
    want = {(n, w, of[n].count(w)) for n in of for w in of[n]}
    got = index.postings.collect()
    assert {(r.doc_id, r.term, r.tf) for r in got} == want and len(got) == len(want)
    assert all(r.dl == first[r.doc_id] for r in got if r.doc_id > 9)
    assert {tuple(r) for r in index.dfs.collect()} == {(w, sum(w in x for x in of.values())) for _, w, _ in want}
    full = rows(S.bm25(index, asked, 5, max_query_terms=0))
    assert rows(S.bm25(index, asked, 5, max_query_terms=50)) == full  # some passes
    sent = []
    monkeypatch.setattr(S, "top", lambda df, by, order, k, name="rank", top=S.top: sent.append(df) or top(df, by, order, k, name))
    assert rows(S.bm25(index, asked, 5)) == full
    per, n = sent[0].groupBy("qid").count().agg(F.max("count")).first()[0], index.blocks.select("block").distinct().count()
    assert 2 < n and per <= 5 * n and sent[0].count() < S.bm25(index, asked, None).count()
