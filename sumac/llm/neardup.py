"""Near-duplicate records: an exact Jaccard join over regions, and the groups it makes.

Texts become sets of hashed word runs; equal sets form a class and go on as one. Distance is 1 - Jaccard.
Voronoi regions of document pivots are exact as well, but prune nothing on texts: a partner within eps of x may lie in
the region of any pivot p with d(x, p) <= d(x, p0) + 2 eps, p0 being the nearest; texts lie near distance 1 from all
but their near copies, and at eps = 0.5 the window 2 eps is the whole space. `window_copies` measures how many regions
a document would have to be copied to (figures in the README: all of them). So a region here is the set of texts
that hold one run, which is what a Voronoi region of the pivot {run} comes to, and the windows are those of a prefix
filter: x lies in the region of its rarest run; a partner y has |x and y| >= t/(1+t) (|x|+|y|), so x is copied to the
regions of its next rarest runs as far as that leaves a common one possible, and no farther. Within a region pairs
are cut by the size, position and symmetric-difference bounds, the last on a parity sketch of BITMAP bits; what is left
is compared exactly. A region of more than `cap` texts is divided again into blocks of its members' groups, each pair
of groups a task of its own, so no region is ever held by one task.

The rarity order needs only be the same everywhere: it comes from a count sketch over all sets, of a cell a run up to
2 ** MAX_BITS cells of a byte. Beyond that cells are shared and rare runs are told apart less well, which costs time
but loses nothing: at r runs a cell the counts are off by some sqrt(r). Which regions are divided doesn't hang on the sketch
but on exact counts of the runs that it shows as frequent.

Defined cases: null bodies and bodies with fewer than `min_words` words or runs take no part; of rows
with the same id the one loaded first counts; ids are compared as strings; ties and equal texts are linked like
others; empty tables give no rows; a text of any length is one set.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from sumac.llm.words import CLASS_BITS, RUN_BITS, hashed_words, mix, shingles
from sumac.runtime import broadcast_if_small, cut, settings

#: Cells of the largest count sketch (16 MB), and of one chunk of it.
MAX_BITS, CHUNK_BITS = 24, 16
#: Cells that a task holds before it adds them up, entries that it places at once, and pairs that it weighs at once.
HELD, PLACED, WEIGHED = 4_000_000, 1_000_000, 500_000
#: While the join runs: bytes of a batch that Spark hands to Python, and shuffles are deleted once their result is kept.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(6 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Bytes of text whose sets may stay in the executors' memory; those of more text go to the shared folder.
KEPT_TEXT = 256_000_000
#: Partial counts of a chunk that one task adds before the last sum.
FAN = 256
#: Bits of the parity sketch that bounds the symmetric difference of two sets from below; sets of at most SHORT runs go
#: with its two halves laid over each other, which tells sets of their size apart as well.
BITMAP, SHORT = 512, 110


def shingle_sets(records: DataFrame, n: int = 5, min_words: int = 5) -> DataFrame:
    """records (table_name, id, loaded_at, text) to table_name, id, loaded_at, sig (16 bytes), n, runs (hashes of 8 bytes)."""

    def make(batches):
        for whole in batches:
            for x in (whole.iloc[k : k + 5000] for k in range(0, len(whole), 5000)):
                out = []
                h, b = hashed_words([t if isinstance(t, str) else None for t in x["text"]])
                owner, runs = shingles(h, b, n)
                at = np.searchsorted(owner, np.arange(len(x) + 1))
                long_enough = np.diff(b) >= min_words
                for k, (name, key, loaded) in enumerate(zip(x["table_name"], x["id"], x["loaded_at"], strict=True)):
                    if long_enough[k] and at[k + 1] > at[k]:
                        own = np.uint64(xxhash.xxh64_intdigest(name) >> (64 - RUN_BITS))  # tables share no runs
                        raw = (runs[at[k] : at[k + 1]] ^ own).tobytes()
                        out.append((name, key, loaded, xxhash.xxh128_digest(raw), int(at[k + 1] - at[k]), raw))
                yield pd.DataFrame(out, columns=["table_name", "id", "loaded_at", "sig", "n", "runs"])

    return records.select("table_name", F.col("id").cast("string").alias("id"), F.col("loaded_at").cast("timestamp").alias("loaded_at"), "text").filter("id IS NOT NULL AND text IS NOT NULL").mapInPandas(make, "table_name string, id string, loaded_at timestamp, sig binary, n int, runs binary")


def squeezed(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact up to 128, then eight steps for each doubling; never out of order."""
    big = np.round(128 + 8 * np.log2(np.maximum(counts, 128) / 128))
    return np.where(counts <= 128, counts, np.minimum(big, 255)).astype(np.uint8)


def merged(cells: np.ndarray, counts: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order with their counts, from such ones and single cells."""
    more = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint32)
    first = np.flatnonzero(np.concatenate([[True], more[1:] != more[:-1]])) if len(more) else np.empty(0, np.int64)
    if not len(cells):
        return more[first], np.diff(np.append(first, len(more)))
    both, n = np.concatenate([cells, more[first]]), np.concatenate([counts, np.diff(np.append(first, len(more)))])
    order = np.argsort(both, kind="stable")
    both, n = both[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    return both[first], np.add.reduceat(n, first)


def packed(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Cells of a chunk as steps in two bytes, counts in four."""
    return zlib.compress(np.diff(cells.astype(np.int64), prepend=0).astype(np.uint16).tobytes() + np.minimum(counts, 2**32 - 1).astype(np.uint32).tobytes(), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    n = len(raw) // 6
    return np.cumsum(np.frombuffer(raw, np.uint16, n), dtype=np.int64), np.frombuffer(raw, np.uint32, n, 2 * n).astype(np.int64)


def partial_counts(batches, bits: int):
    """k, c: counts of the runs of all batches, packed by chunk. A task holds four bytes a cell of the sketch and HELD runs,
    whatever the number of its texts."""
    size, chunk = 1 << bits, 1 << min(bits, CHUNK_BITS)
    sums, held, n = np.zeros(size, np.uint32), [], 0

    def add():
        cells, counts = merged(np.empty(0, np.uint32), np.empty(0, np.int64), held)
        sums[cells] += np.minimum(counts, 2**32 - 1 - sums[cells]).astype(np.uint32)

    for whole in batches:
        for x in (whole["runs"].iloc[k : k + 5000] for k in range(0, len(whole), 5000)):
            held.append((np.frombuffer(b"".join(x), np.uint64) & np.uint64(size - 1)).astype(np.uint32))
            n += len(held[-1])
            if n > HELD:
                add()
                held, n = [], 0
    add()
    for k in range(size // chunk):
        part = sums[k * chunk : (k + 1) * chunk]
        cells = np.flatnonzero(part)
        if len(cells):
            yield pd.DataFrame({"k": [k], "c": [packed(cells, part[cells])]})


def count_sketch(classes: DataFrame, bits: int) -> np.ndarray:
    """Counts of all runs of all classes in 2 ** bits cells, squeezed. Partial counts are added in two steps, so that
    a task holds FAN partials of a chunk, and the last one in FAN of all."""
    size, chunk = 1 << bits, 1 << min(bits, CHUNK_BITS)

    def partial(batches):
        yield from partial_counts(batches, bits)

    def total(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros(chunk, np.int64)
        for c in pdf["c"]:
            cells, counts = unpacked(c)
            out[cells] += counts
        return out

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        c = total(pdf)
        at = np.flatnonzero(c)
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "c": [packed(at, c[at])]})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "c": [zlib.compress(squeezed(total(pdf)).tobytes(), 1)]})

    made = classes.select("runs").mapInPandas(partial, "k int, c binary")
    some = made.groupBy("k", F.floor(F.spark_partition_id() / FAN).alias("p")).applyInPandas(add, "k int, c binary")
    out = np.zeros((size // chunk, chunk), np.uint8)
    for r in some.groupBy("k").applyInPandas(last, "k int, c binary").collect():  # 2 ** bits bytes at most
        out[r.k] = np.frombuffer(zlib.decompress(r.c), np.uint8)
    return out.ravel()


def _prefix(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(a.tobytes() for a in arrays), 1)


def _ordered(x: pd.DataFrame, counts: np.ndarray, bits: int, t: float):
    """Of a batch of classes: sizes, owner, run, rank of the runs in their prefixes, rarest first.

    A count of one proves that a run occurs once, so it is not placed. One run more than needed is, for runs of the same rarity."""
    n = x["n"].to_numpy(np.int64)
    runs = np.frombuffer(b"".join(x["runs"]), np.uint64)
    owner = np.repeat(np.arange(len(n)), n)
    c = counts[(runs & np.uint64((1 << bits) - 1)).astype(np.int64)]
    rarity = (owner.astype(np.uint64) << np.uint64(50)) | (c.astype(np.uint64) << np.uint64(42)) | (runs >> np.uint64(RUN_BITS - 42))
    order = np.argsort(rarity)
    pos = np.arange(len(runs)) - np.repeat(np.cumsum(n) - n, n)
    c = c[order]
    keep = (pos <= _prefix(n, t)[owner]) & (c > 1)
    return n, runs, owner[keep], runs[order[keep]], c[keep], pos[keep]


def census(classes: DataFrame, sketch, bits: int, t: float, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that more than cap classes are placed by, with exact counts (at most placed entries / cap of them), and the
    placed entries of each longest word's class.

    Only runs whose cell lies above its like by half of cap are counted one by one, batch by batch before the shuffle."""
    low, few = int(squeezed(np.array([cap // 2]))[0]), np.uint64(RUN_BITS - CLASS_BITS)

    def count(batches):
        counts, kinds = sketch.value, np.zeros(1 << CLASS_BITS, np.int64)
        least = max(low, int(np.median(counts[:: max(1, len(counts) >> 20)])) + 1)
        for whole in batches:
            for x in (whole.iloc[k : k + 5000] for k in range(0, len(whole), 5000)):
                if not len(x):
                    continue
                _, _, _, placed, c, _ = _ordered(x, counts, bits, t)
                kinds += np.bincount((placed >> few).astype(np.int64), minlength=len(kinds))
                r, k = np.unique(placed[c >= least], return_counts=True)
                if len(r):
                    yield pd.DataFrame({"run": r.astype(np.int64), "k": k.astype(np.int64)})
        some = np.flatnonzero(kinds)
        yield pd.DataFrame({"run": -1 - some, "k": kinds[some]})

    rows = classes.select("n", "runs").mapInPandas(count, "run bigint, k bigint").groupBy("run").agg(F.sum("k").alias("k")).filter((F.col("k") > cap) | (F.col("run") < 0)).collect()
    hot = sorted((r.run, r.k) for r in rows if r.run >= 0)
    kinds = np.zeros(1 << CLASS_BITS, np.int64)
    for r in rows:
        if r.run < 0:
            kinds[-1 - r.run] = r.k
    return np.array([r for r, _ in hot], np.uint64), np.array([k for _, k in hot], np.int64), kinds


def spread(kinds: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each class of runs its number of parts and the place of the first of them in the third array, which names the
    bucket of every part. A part holds a bucket at most; the largest go first, to the bucket that holds least."""
    most = max(1, int(kinds.sum()) // buckets)
    parts = np.maximum(1, -(-kinds // most))
    first = np.cumsum(parts) - parts
    size = np.repeat(kinds / parts, parts)
    to = np.zeros(len(size), np.int64)
    loads = [(0.0, b) for b in range(buckets)]
    for k in np.argsort(-size, kind="stable"):
        load, b = loads[0]
        to[k] = b
        heapq.heapreplace(loads, (load + size[k], b))
    return parts.astype(np.uint64), first, to


def chunks(batches, rows: int = 5000):
    """The rows of batches of any size, `rows` at once, fewer only where they hold more than PLACED runs."""
    held, k, n = [], 0, 0
    for x in batches:
        while len(x):
            part, x = x.iloc[: rows - k], x.iloc[rows - k :]
            held.append(part)
            k, n = k + len(part), n + part["n"].sum()
            if k == rows or n > PLACED:
                yield pd.concat(held, ignore_index=True)
                held, k, n = [], 0, 0
    if held:
        yield pd.concat(held, ignore_index=True)


def place(classes: DataFrame, sketch, hot, bits: int, t: float, buckets: int, cap: int) -> DataFrame:
    """bucket, docs, entries, marks: for each batch of classes, the regions they fall in, in columns.

    Regions go to buckets by the longest word of their run, which neighbouring runs of a text share, so that a text goes to
    few buckets; those of a frequent word are parted by hash. A hot run has its region cut into blocks: its members fall into groups by their own
    hash, and each pair of groups is a block, which both groups are sent to."""

    def send(batches):
        counts, (hot_run, hot_count, parts, part_at, to) = sketch.value, hot.value
        for whole in chunks(batches):
            todo = [whole]
            while todo:
                x = todo.pop()
                if len(x) > 1 and x["n"].sum() > PLACED:  # long texts
                    todo += [x.iloc[len(x) // 2 :], x.iloc[: len(x) // 2]]
                    continue
                n, every, owner, runs, _, pos = _ordered(x, counts, bits, t)
                groups = np.ones(len(runs), np.int64)
                if len(hot_run):
                    at = np.minimum(np.searchsorted(hot_run, runs), len(hot_run) - 1)
                    is_hot = hot_run[at] == runs
                    groups[is_hot] = -(-hot_count[at[is_hot]] // cap)
                if len(x) > 1 and groups.sum() > PLACED:  # members of many blocks
                    todo += [x.iloc[len(x) // 2 :], x.iloc[: len(x) // 2]]
                    continue
                all_owner = np.repeat(np.arange(len(n)), n)
                parity = np.bincount(all_owner * BITMAP + ((every >> np.uint64(24)).astype(np.int64) & (BITMAP - 1)), minlength=len(n) * BITMAP)
                bitmap = np.packbits((parity & 1).astype(np.uint8).reshape(len(n), BITMAP), axis=1)
                folded = bitmap[:, : BITMAP // 16] ^ bitmap[:, BITMAP // 16 :]
                ref = np.frombuffer(b"".join(s[:8] for s in x["sig"]), np.uint64)
                own = (mix(ref[owner] + np.uint64(1)) % groups.astype(np.uint64)).astype(np.int64)
                rep = np.repeat(np.arange(len(runs)), groups)
                other = np.arange(len(rep)) - np.repeat(np.cumsum(groups) - groups, groups)
                i, j = np.minimum(own[rep], other), np.maximum(own[rep], other)
                with np.errstate(over="ignore"):
                    key = mix(runs[rep] + mix((i * groups[rep] + j).astype(np.uint64)))
                side = np.where(i == j, 2, np.where(own[rep] == i, 0, 1)).astype(np.uint8)
                kind = (runs[rep] >> np.uint64(RUN_BITS - CLASS_BITS)).astype(np.int64)
                bucket = to[part_at[kind] + (key % parts[kind]).astype(np.int64)]
                by = np.argsort(bucket, kind="stable")
                bounds = np.searchsorted(bucket[by], np.arange(buckets + 1))
                out = []
                for k in np.flatnonzero(np.diff(bounds)):
                    e = by[bounds[k] : bounds[k + 1]]
                    d, times = np.unique(owner[rep[e]], return_counts=True)
                    entries = _pack((key[e] >> np.uint64(32)).astype(np.uint32))
                    marks = _pack(times.astype(np.uint32), pos[rep[e]].astype(np.uint32), side[e])
                    few = n[d] <= SHORT
                    out.append((int(k), _pack(ref[d], n[d].astype(np.uint32), folded[d[few]], bitmap[d[~few]]), entries, marks))
                yield pd.DataFrame(out, columns=["bucket", "docs", "entries", "marks"])

    return classes.select("sig", "n", "runs").mapInPandas(send, "bucket int, docs binary, entries binary, marks binary")


def _unpack(d: bytes, e: bytes, m: bytes, base: int) -> tuple[np.ndarray, ...]:
    """refs, sizes, folded bitmaps of the sets, whole bitmaps of the long ones in their order, and of the entries set (counted from base), key, position, side."""
    raw = zlib.decompress(d)
    key = np.frombuffer(zlib.decompress(e), np.uint32)
    mark = zlib.decompress(m)
    k = (len(mark) - 5 * len(key)) // 4
    n = np.frombuffer(raw, np.uint32, k, 8 * k).astype(np.int32)
    few, b = n <= SHORT, BITMAP // 8
    short, long = np.empty((k, b // 2), np.uint8), np.frombuffer(raw, np.uint8, (~few).sum() * b, 12 * k + few.sum() * b // 2).reshape(-1, b).copy()
    short[few] = np.frombuffer(raw, np.uint8, few.sum() * b // 2, 12 * k).reshape(-1, b // 2)
    short[~few] = long[:, : b // 2] ^ long[:, b // 2 :]
    doc = np.repeat(np.arange(base, base + k, dtype=np.int32), np.frombuffer(mark, np.uint32, k))
    pos, side = np.frombuffer(mark, np.uint32, len(key), 4 * k).astype(np.int32), np.frombuffer(mark, np.uint8, len(key), 4 * k + 4 * len(key)).copy()
    return np.frombuffer(raw, np.uint64, k).copy(), n, short.view(np.uint64), long.view(np.uint64), doc, key, pos, side


def region_pairs(t: float):
    """Candidates of buckets of regions, one after another: pairs that the bounds do not exclude. Rows come in the order of
    their buckets and are unpacked as they come, so that of a bucket only its columns are held."""

    def find_all(batches):
        bucket, parts, base = None, [[] for _ in range(8)], 0
        for x in batches:
            for k, *packs in zip(x["bucket"], x["docs"], x["entries"], x["marks"], strict=True):
                if k != bucket and base:
                    yield find(parts)
                    parts, base = [[] for _ in range(8)], 0
                bucket, some = k, _unpack(*packs, base)
                base += len(some[0])
                for own, a in zip(parts, some, strict=True):
                    own.append(a)
        if base:
            yield find(parts)

    def find(parts: list[list[np.ndarray]]) -> pd.DataFrame:
        out = []
        while parts:  # one column after another, so that only one is held twice
            out.append(np.concatenate(parts.pop(0)))
        ref, n_all, half, whole, doc, key, pos, side = out
        del out
        row = np.cumsum(n_all > SHORT, dtype=np.int32) - 1  # of a long set in `whole`
        by = key.astype(np.uint64)
        by <<= np.uint64(32)
        by |= n_all[doc].astype(np.uint64)
        order = np.argsort(by).astype(np.int32)
        del by
        doc, key, side = doc[order], key[order], side[order]
        n = n_all[doc]
        left = n - pos[order]
        del order, pos
        first = n - left <= _prefix(n, 2 * t / (1 + t))  # as the smaller one of a pair it need be placed no farther
        split = bool((side != 2).any())
        found, held, most_held, step, live = [], 0, 1_000_000, 1, np.flatnonzero(first).astype(np.int32)  # the smaller ones of pairs
        del first

        def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            total = n[a] + n[b]
            need = np.ceil(t / (1 + t) * total - 1e-9).astype(np.int32)
            ok = np.minimum(left[a], left[b]) >= need
            if split:
                ok &= (side[a] == 2) | (side[a] != side[b])
            x, y, most = doc[a[ok]], doc[b[ok]], (total - 2 * need)[ok]
            diff = np.zeros(len(x), np.int32)
            for k in range(BITMAP // 128):
                diff += np.bitwise_count(half[x, k] ^ half[y, k])
            ok = diff <= most
            both = np.flatnonzero(ok & (np.minimum(n_all[x], n_all[y]) > SHORT))
            if len(both):
                u, v, diff = row[x[both]], row[y[both]], np.zeros(len(both), np.int32)
                for k in range(BITMAP // 64):
                    diff += np.bitwise_count(whole[u, k] ^ whole[v, k])
                ok[both] = diff <= most[both]
            return np.minimum(x[ok], y[ok]).astype(np.int64) * len(ref) + np.maximum(x[ok], y[ok])

        while True:
            live = live[: np.searchsorted(live, len(key) - step)]
            live = live[(key[live] == key[live + step]) & (n[live] >= t * n[live + step] - 1e-9)]
            if not len(live):
                break
            for at in range(0, len(live), WEIGHED):
                a = live[at : at + WEIGHED]
                p = alike(a, a + step)
                if len(p):
                    found.append(p)
                    held += len(p)
                    if held > most_held:  # near copies meet in many regions of a bucket
                        found, held = [np.unique(np.concatenate(found))], 0
                        most_held = max(most_held, len(found[0]))
            step += 1
        p = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        a, b = ref[p // max(len(ref), 1)], ref[p % max(len(ref), 1)]
        a, b = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
        return pd.DataFrame({"ref_a": pairs[:, 0].astype(np.int64), "ref_b": pairs[:, 1].astype(np.int64)})

    return find_all


@F.pandas_udf(T.LongType())
def first_bytes(sig: pd.Series) -> pd.Series:
    """The first 8 bytes of a signature as a number."""
    return pd.Series(np.frombuffer(b"".join(x[:8] for x in sig), np.int64), index=sig.index)


@F.pandas_udf(T.IntegerType())
def common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Runs that two sets share."""
    out = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)]
    return pd.Series(out, dtype="int32")


class Join:
    """members (table_name, id, sig), classes (sig, n, runs) and links (sig_a, sig_b, shared, similarity) of a collection.

    The sets of up to KEPT_TEXT bytes of text are kept in memory, those of more in the shared folder, so that an executor's
    memory doesn't depend on the size of the collection. They stay where they were made: of equal sets one row is kept by an anti join with the others' keys, which
    are broadcast only if a count shows at most `few` of them, as are the keys of the sets that candidates need.
    Candidates name a set by the first 8 bytes of its signature; should two sets share them, both are compared."""

    def __init__(self, records: DataFrame, n: int = 5, t: float = 0.8, min_words: int = 5, cap: int = 4096, per_bucket: int = 2_000_000, few: int = 200_000, max_bits: int = MAX_BITS):
        with settings(records.sparkSession, SETTINGS):
            self._run(records, n, t, min_words, cap, per_bucket, few, max_bits)

    def _run(self, records: DataFrame, n: int, t: float, min_words: int, cap: int, per_bucket: int, few: int, max_bits: int) -> None:
        spark = records.sparkSession
        text = records.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        sets = shingle_sets(records, n, min_words)
        sets = sets.persist(StorageLevel.MEMORY_AND_DISK) if text <= KEPT_TEXT else cut(sets)
        first = F.min_by("sig", F.struct(F.col("loaded_at").isNull(), "loaded_at", "sig")).alias("sig")
        members = cut(sets.groupBy("table_name", "id").agg(first, (F.max("sig") != F.min("sig")).alias("several")))
        self.members = members.drop("several")
        self.equal = members.groupBy("sig").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("k")).filter("k > 1")
        others = members.join(broadcast_if_small(self.equal, few), "sig").filter("id <> least").select("sig", "id")
        changed = members.filter("several").select("table_name", "id", F.col("sig").alias("good"))
        if not changed.isEmpty():
            others = others.unionByName(sets.join(broadcast_if_small(changed, few), ["table_name", "id"]).filter("sig <> good").select("sig", "id").distinct())
        self.classes = sets.join(broadcast_if_small(others, few), ["sig", "id"], "left_anti").select("sig", "n", "runs")
        self.few = few
        total = self.classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("runs"), F.coalesce(F.sum(F.col("n") - F.ceil(t * F.col("n") - 1e-9) + 2), F.lit(0)).alias("placed")).first()
        bits = min(max_bits, max(CHUNK_BITS, int(total.runs).bit_length() + 1))
        sketch = spark.sparkContext.broadcast(count_sketch(self.classes, bits))
        cap = max(cap, int(total.placed) >> 20)  # so that at most a million regions are divided
        hot, size, kinds = census(self.classes, sketch, bits, t, cap)
        copies = int(kinds.sum()) + int((size * (-(-size // cap) - 1)).sum())
        buckets = max(2, copies // per_bucket + 1)
        held = spark.sparkContext.broadcast((hot, size, *spread(kinds, buckets)))
        self.plan = {"runs": int(total.runs), "bits": bits, "placed": int(kinds.sum()), "hot": len(hot), "copies": copies, "buckets": buckets}
        placed = place(self.classes, sketch, held, bits, t, buckets, cap)
        pairs = cut(placed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(region_pairs(t), "ref_a bigint, ref_b bigint").distinct())
        sketch.unpersist()
        held.unpersist()
        needed = pairs.select(F.explode(F.array("ref_a", "ref_b")).alias("ref")).distinct()
        own = self.classes.select("*", first_bytes(F.col("sig")).alias("ref")).join(broadcast_if_small(needed, few), "ref", "left_semi").repartition("ref").dropDuplicates(["ref", "sig"])  # one exchange for both joins
        side = lambda x: own.select(F.col("ref").alias(f"ref_{x}"), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"), F.col("runs").alias(f"runs_{x}"))
        checked = pairs.join(side("a"), "ref_a").join(side("b"), "ref_b")
        shared = checked.select("sig_a", "sig_b", "n_a", "n_b", common("runs_a", "runs_b").alias("shared"))
        union = F.col("n_a") + F.col("n_b") - F.col("shared")
        self.links = cut(shared.filter(F.col("shared") >= t * union - 1e-9).select("sig_a", "sig_b", "shared", (F.col("shared") / union).alias("similarity")))
        if text <= KEPT_TEXT:
            sets.unpersist()

    def pairs(self) -> DataFrame:
        """table_name, id_a, id_b: all pairs of ids, those of equal sets included."""
        m = self.members
        ends = self.links.select(F.explode(F.array("sig_a", "sig_b")).alias("sig")).distinct()
        some = m.join(broadcast_if_small(ends, self.few), "sig", "left_semi")
        a, b = some.select("table_name", F.col("id").alias("x"), F.col("sig").alias("sig_a")), some.select(F.col("id").alias("y"), F.col("sig").alias("sig_b"))
        linked = self.links.select("sig_a", "sig_b").join(a, "sig_a").join(b, "sig_b").select("table_name", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        dup = m.join(broadcast_if_small(self.equal, self.few), "sig", "left_semi")
        equal = dup.select("table_name", F.col("id").alias("id_a"), "sig").join(dup.select(F.col("id").alias("id_b"), "sig"), "sig").filter("id_a < id_b").select("table_name", "id_a", "id_b")
        return linked.unionByName(equal)

    def groups(self) -> DataFrame:
        """table_name, id, class_id, n_links, group_id: class of equal texts, its links to other classes, least id of all it is linked to in any number of steps."""
        least = self.members.groupBy("sig").agg(F.min("id").alias("class_id"))
        degree = self.links.select(F.explode(F.array("sig_a", "sig_b")).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n_links"))
        ends = self.links.join(least.select(F.col("sig").alias("sig_a"), F.col("class_id").alias("a")), "sig_a").join(least.select(F.col("sig").alias("sig_b"), F.col("class_id").alias("b")), "sig_b")
        ends = ends.join(self.members.groupBy("sig").agg(F.min("table_name").alias("table_name")).select(F.col("sig").alias("sig_a"), "table_name"), "sig_a")
        label = components(ends.select("table_name", "a", "b"))
        out = self.members.join(least, "sig").join(degree, "sig", "left").join(label.select("table_name", F.col("node").alias("class_id"), "group_id"), ["table_name", "class_id"], "left")
        return out.select("table_name", "id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))


def window_copies(sets: DataFrame, pivots: int, eps: float) -> DataFrame:
    """n_docs, mean_copies, mean_nearest: Voronoi regions of document pivots that a set must be copied to for an exact join.

    A measurement, used by no query: the regions of all pivots p with d(x, p) <= d(x, p0) + 2 eps. The pivots are the
    `pivots` sets of least hashed signature, a bounded sample."""
    chosen = [np.frombuffer(r.runs, np.uint64) for r in sets.orderBy(F.xxhash64("sig"), "sig").limit(pivots).select("runs").collect()]
    held = sets.sparkSession.sparkContext.broadcast(chosen)

    def measure(batches):
        size = np.array([len(p) for p in held.value])
        runs, at = np.concatenate(held.value), np.repeat(np.arange(len(size)), size)
        order = np.argsort(runs, kind="stable")
        runs, at = runs[order], at[order]
        for x in batches:
            out = []
            for raw in x["runs"]:
                r = np.frombuffer(raw, np.uint64)
                lo, hi = np.searchsorted(runs, r, "left"), np.searchsorted(runs, r, "right")
                shared = np.bincount(np.concatenate([at[a:b] for a, b in zip(lo, hi, strict=True) if b > a] or [at[:0]]), minlength=len(size))
                d = 1 - shared / (len(r) + size - shared)
                out.append((int((d <= d.min() + 2 * eps + 1e-9).sum()), float(d.min())))
            yield pd.DataFrame(out, columns=["copies", "nearest"])

    made = sets.select("runs").mapInPandas(measure, "copies bigint, nearest double")
    return made.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("copies").alias("mean_copies"), F.avg("nearest").alias("mean_nearest"))


def components(edges: DataFrame) -> DataFrame:
    """table_name, node, group_id of an undirected graph (table_name, a, b), group_id being the least node of the component.

    Large stars and small stars in turn: each node's greater neighbours, then its lesser ones, are tied to the least node
    among it and its neighbours, until all edges lead to roots. A chain is halved about every round, and edges never grow
    in number."""
    t = F.col("table_name")
    edge = lambda df, u, v: df.select(t, F.col(u).alias("u"), F.col(v).alias("v"))
    nodes = edges.select(t, F.explode(F.array("a", "b")).alias("node")).distinct()
    e = cut(edges.filter("a <> b").select(t, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        ends = e.select(t, F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x"))
        if ends.groupBy(t, "x.node").agg(F.sum("x.up").alias("up"), F.max("x.down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty():
            break
        both = edge(e, "u", "v").unionByName(edge(e, "v", "u"))
        least = both.groupBy(t, "u").agg(F.least("u", F.min("v")).alias("m"))
        large = cut(edge(both.filter("v > u").join(least, ["table_name", "u"]), "v", "m").distinct())
        least = large.groupBy(t, "u").agg(F.min("v").alias("m"))
        e = cut(edge(large.join(least, ["table_name", "u"]).filter("v <> m"), "v", "m").unionByName(edge(least, "u", "m")).distinct())
    return nodes.join(e.select(t, F.col("u").alias("node"), F.col("v").alias("group_id")), ["table_name", "node"], "left").select(t, "node", F.coalesce("group_id", "node").alias("group_id"))


def bodies(questions: DataFrame, answers: DataFrame) -> DataFrame:
    one = lambda df, t: df.select(F.lit(t).alias("table_name"), "id", "loaded_at", F.col("body_text").alias("text"))
    return one(questions, "questions").unionByName(one(answers, "answers"))

