"""The metric-space join against brute force."""

import random
import tracemalloc
from datetime import datetime as dt

import numpy as np
import pandas as pd

from sumac.llm import neardup
from sumac.llm.words import words

SCHEMA = "table_name string, id string, loaded_at timestamp, text string, n int"


def runs_of(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def brute(rows, n, t, least):
    first = {}
    for tab, key, loaded, text, _ in rows:
        if key and text and ((tab, key) not in first or loaded < first[tab, key][0]):
            first[tab, key] = (loaded, text)
    s = {k: runs_of(v[1], n) for k, v in first.items() if len(words(v[1])) >= least}
    return {(a[0], *sorted((a[1], b[1]))) for a in s for b in s if a < b and a[0] == b[0] and s[a] and s[b] and len(s[a] & s[b]) >= t * len(s[a] | s[b])}


def collection(seed, size=120):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(size):
        if rows and r.random() < 0.6:
            w = r.choice(rows)[3].split()
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 1)] = [r.choice(vocab)] * r.randint(0, 2)
        else:
            w = [r.choice(vocab) for _ in range(r.randint(8, 60))]
        rows.append((r.choice(["x", "y"]), f"{k:03}", dt(2020, 1, 1), " ".join(w), k))
    return [*rows, ("x", "000", dt(2021, 1, 1), "later row of the same id " * 4, 0), ("x", None, dt(2020, 1, 1), "a", 0), ("y", "900", None, None, 1), ("y", "901", None, "", 1)]


def test_pairs_brute_force(spark):
    for seed, n, t, cap in ((1, 3, 0.5, 4096), (2, 3, 0.5, 5), (3, 5, 0.8, 4096), (4, 1, 0.7, 3)):
        rows = collection(seed)
        got = neardup.Join(spark.createDataFrame(rows, SCHEMA), n, t, 6, max_bits=10, cap=cap, per_bucket=300).pairs()
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(set(found))
        assert set(found) == brute(rows, n, t, 6)


def test_without_broadcasts(spark):
    rows = collection(6, 80)
    got = neardup.Join(spark.createDataFrame(rows, SCHEMA), 3, 0.5, 6, max_bits=10, cap=7, per_bucket=200, few=0)
    assert {tuple(r) for r in got.pairs().collect()} == brute(rows, 3, 0.5, 6)


def test_hot_copies_and_groups(spark):
    text = " ".join(f"v{k}" for k in range(40))
    rows = [("x", f"{k:03}", dt(2020, 1, 1), text, k) for k in range(30)] + [("x", f"e{k:02}", dt(2020, 1, 1), text + f" more{k}", k) for k in range(20)] + [("x", "z", dt(2020, 1, 1), " ".join(f"u{k}" for k in range(40)), 0)]
    got = {r.id: r for r in neardup.Join(spark.createDataFrame(rows, SCHEMA), 5, 0.8, cap=4).groups().collect()}
    assert len(got) == 51 and {got[k].group_id for k in got if k != "z"} == {"000"}
    assert got["005"].class_id == "000" and got["005"].n_links == 20 and got["e03"].n_links == 20 and got["z"].n_links == 0


def test_empty_and_long(spark):
    assert neardup.Join(spark.createDataFrame([], SCHEMA)).pairs().count() == 0
    long = " ".join(f"t{k}" for k in range(60_000))
    rows = [("x", "a", dt(2020, 1, 1), long, 0), ("x", "b", dt(2020, 1, 1), long + " end", 0)]
    assert neardup.Join(spark.createDataFrame(rows, SCHEMA)).pairs().count() == 1


def test_components(spark):
    e = [("t", f"{k:03}", f"{k + 1:03}") for k in range(60)] + [("t", "a", "b"), ("u", "000", "001")]
    got = {(r.table_name, r.node): r.group_id for r in neardup.components(spark.createDataFrame(e, "table_name string, a string, b string")).collect()}
    assert got["t", "060"] == "000" and got["t", "b"] == "a" and got["u", "001"] == "000"


def test_long_chains_are_one_component(spark):
    ids = [f"{k:04}" for k in range(1500)]
    random.Random(5).shuffle(ids)
    e = [("t", a, b) for a, b in zip(ids, ids[1:])] + [("u", a, b) for a, b in zip(ids[:400], ids[1:400])] + [("u", "z", "z")]
    got = [tuple(r) for r in neardup.components(spark.createDataFrame(e, "table_name string, a string, b string")).collect()]
    assert sorted(got) == sorted([("t", k, "0000") for k in ids] + [("u", k, min(ids[:400])) for k in ids[:400]] + [("u", "z", "z")])


def test_divided_regions_lose_no_link(spark):
    rows = [("x", f"{k:03}", dt(2020, 1, 1), " ".join(f"c{j}" for j in range(30)) + f" own{k} tail{k} last{k}", k) for k in range(60)]
    j = neardup.Join(spark.createDataFrame(rows, SCHEMA), 3, 0.5, 6, cap=5, per_bucket=300)
    assert j.plan["hot"] > 0 and j.plan["copies"] > j.plan["placed"] and {tuple(r) for r in j.pairs().collect()} == brute(rows, 3, 0.5, 6)


def test_squeezed_counts_keep_their_order():
    c = np.concatenate([np.arange(5000), 2 ** np.arange(13, 32)])
    s = neardup.squeezed(c).astype(int)
    assert (np.diff(s) >= 0).all() and (s[:129] == np.arange(129)).all() and s[-1] == 255


def test_windows_of_document_pivots_are_the_whole_space(spark):
    sets = neardup.shingle_sets(spark.createDataFrame(collection(7), SCHEMA), 3, 6)
    got = neardup.window_copies(sets, 16, 0.5).first()
    assert got.mean_copies == 16 and got.n_docs > 100


def test_buckets_are_even():
    r = np.random.default_rng(1)
    kinds = (r.pareto(1.0, 500) * 100).astype(np.int64)
    kinds[7] = kinds.sum()  # one word has half of all
    parts, first, to = neardup.spread(kinds, 40)
    load = np.bincount(to, np.repeat(kinds / parts, parts.astype(int)), 40)
    assert load.max() < 1.5 * load.mean() and len(to) == parts.sum() and parts[7] >= 20 and first[8] - first[7] == parts[7]


def test_sketch_counts(spark, monkeypatch):
    rows = [("x", f"{k}", dt(2020, 1, 1), " ".join(f"s{(k * 7 + j) % 40}" for j in range(20)), k) for k in range(90)]
    sets = neardup.shingle_sets(spark.createDataFrame(rows, SCHEMA).repartition(5), 3, 6)
    runs = np.concatenate([np.frombuffer(r.runs, np.uint64) for r in sets.collect()])
    for bits in (8, 18):
        want = np.bincount((runs & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        assert (neardup.count_sketch(sets, bits) == neardup.squeezed(want)).all()
    cells, counts = neardup.merged(np.array([1, 5], np.uint32), np.array([2, 3]), [np.array([5, 0, 5], np.uint32), np.array([9], np.uint32)])
    assert cells.tolist() == [0, 1, 5, 9] and counts.tolist() == [1, 2, 5, 1]
    assert [x.tolist() for x in neardup.unpacked(neardup.packed(cells, counts))] == [[0, 1, 5, 9], [1, 2, 5, 1]]


def test_sets_of_much_text_leave_the_executors_memory(spark, monkeypatch):
    rows, sketch, kept = collection(8), neardup.count_sketch, []
    persistent = lambda: len(spark.sparkContext._jsc.getPersistentRDDs())
    monkeypatch.setattr(neardup, "count_sketch", lambda *a: kept.append(persistent()) or sketch(*a))
    monkeypatch.setattr(neardup, "KEPT_TEXT", 1000, raising=False)
    before, conf = persistent(), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    j = neardup.Join(spark.createDataFrame(rows, SCHEMA), 3, 0.5, 6, max_bits=10, cap=5, per_bucket=300)
    assert kept == [before] and {tuple(r) for r in j.pairs().collect()} == brute(rows, 3, 0.5, 6)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == conf


def test_counts_of_a_task_hold_no_more_for_more_texts():
    def batches():
        for k in range(24):
            yield pd.DataFrame({"runs": [np.random.default_rng(k).integers(0, 1 << 50, 10**6, np.uint64).tobytes()]})

    tracemalloc.start()
    total = 0
    for x in neardup.partial_counts(batches(), 24):
        total += int(neardup.unpacked(x["c"][0])[1].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 24 * 10**6 and peak < 400e6


def test_chunks_of_batches_of_any_size():
    x = pd.DataFrame({"k": np.arange(1000), "n": [1] * 990 + [neardup.PLACED + 1] * 10})
    for step, want in ((1, [100] * 9 + [91] + [1] * 9), (150, [100] * 10)):
        got = list(neardup.chunks((x.iloc[k : k + step] for k in range(0, 1000, step)), 100))
        assert pd.concat(got)["k"].tolist() == list(range(1000)) and [len(g) for g in got] == want
