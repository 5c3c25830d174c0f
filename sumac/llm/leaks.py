"""Evaluation texts leaking into training text, by pigeonhole edit matching.

Every window of `run` words of a test item, with an error budget of e word edits, holds one of the item's
tiles untouched: tiles of q = (run + 1) // (e + 2) words laid end to end leave e + 1 whole tiles in any
such window. Tiles are looked up exactly in the documents; around each hit, Myers' bit-parallel distance
over words verifies the windows that hold the tile. Hits are verified together, at most HITS at once: one bit vector
per hit, a column of the text at a time. With one edit it must lie to one side of the untouched tile, so that only hits
whose words agree on the one side, and on the other up to an edit and again beyond it, over a whole window are verified.

Documents are never shuffled: the items are the side that goes to them, in blocks of at most `block`
tiles, TOGETHER of them in one pass over the documents, so what is broadcast at once is bounded whatever the number of items.

Defined cases: null texts and items have no words; items or documents under `run` words never match;
repeated document rows count once; extra columns are ignored; a document of any length is read whole.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumac.llm.words import hashed_words, run_hashes

#: Blocks of items that one pass over the documents searches for.
TOGETHER = 8
#: Tile hits held at a time.
HITS = 200_000
SCHEMA = "doc_id bigint, item_id bigint, distance int, n_words int, doc_word int, item_word int"


def myers(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edits between each row's pattern (at most 63 words) and any stretch of its text; 0 marks no word."""
    n, m = pattern.shape
    one, high = np.uint64(1), np.uint64(m - 1)
    pv, mv = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    score = np.full(n, m, np.int64)
    best = score.copy()
    bits = one << np.arange(m, dtype=np.uint64)
    for j in range(text.shape[1]):
        c = text[:, j]
        eq = (np.where((pattern == c[:, None]) & (c[:, None] != 0), bits, np.uint64(0))).sum(axis=1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score = score + ((ph >> high) & one).astype(np.int64) - ((mh >> high) & one).astype(np.int64)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
        best = np.minimum(best, score)
    return best


class Tiles:
    """One block of items: their words and their tiles, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], run: int, errors: int):
        self.run, self.errors, self.q = run, errors, (run + 1) // (errors + 2)
        if self.q < 1:
            raise ValueError("too many errors for so short a run")
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words, self.bounds = hashed_words([t for _, t in items])
        item, at = [], []
        for k in range(len(items)):
            if self.bounds[k + 1] - self.bounds[k] >= run:
                starts = np.arange(self.bounds[k], self.bounds[k + 1] - self.q + 1, self.q)
                item.append(np.full(len(starts), k))
                at.append(starts)
        self.item, self.at = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (item, at))
        runs = run_hashes(self.words, self.q)
        self.hash = runs[self.at] if len(self.at) else np.empty(0, np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.item, self.at, self.hash = self.item[order], self.at[order], self.hash[order]

    def search(self, ids: np.ndarray, w: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        """Leaks in documents of the words w with the bounds b."""
        runs = run_hashes(w, self.q)
        lo, hi = np.searchsorted(self.hash, runs, "left"), np.searchsorted(self.hash, runs, "right")
        owner = np.repeat(np.arange(len(b) - 1), np.diff(b))[: len(runs)]
        times = np.where(np.arange(len(runs)) + self.q <= b[owner + 1], hi - lo, 0) if len(runs) else np.empty(0, np.int64)
        total = np.cumsum(times)
        cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, HITS), "left")) if len(total) else []
        found = [self._verify(w, b, owner, lo, times, x, y) for x, y in zip(cuts, [*cuts[1:], len(times)][: len(cuts)], strict=True)]
        if not found:
            return pd.DataFrame(columns=["doc_id", "item_id", "distance", "n_words", "doc_word", "item_word"])
        out = pd.concat(found).sort_values(["doc", "item", "distance", "n_words", "doc_word", "item_word"], ascending=[True, True, True, False, True, True]).drop_duplicates(["doc", "item"])
        return pd.DataFrame({"doc_id": ids[out.doc.to_numpy(np.int64)], "item_id": self.ids[out["item"].to_numpy(np.int64)], **{c: out[c].to_numpy() for c in ("distance", "n_words", "doc_word", "item_word")}})

    def _verify(self, w, b, owner, lo, times, first: int, last: int) -> pd.DataFrame:
        """Leaks around the tile hits at places first to last of a batch's words."""
        some = times[first:last]
        pos = first + np.repeat(np.arange(last - first), some)
        tile = lo[pos] + np.arange(len(pos)) - np.repeat(np.cumsum(some) - some, some)
        doc, item, at = owner[pos], self.item[tile], self.at[tile]
        d0, d1, i0, i1 = b[doc], b[doc + 1], self.bounds[item], self.bounds[item + 1]

        def agree(p: np.ndarray, a: np.ndarray, step: int, of: np.ndarray) -> np.ndarray:
            """How many words agree from word p of the document and a of the item on."""
            n, live = np.zeros(len(p), np.int64), np.arange(len(p))
            while len(live):
                x, y, k = p[live] + step * n[live], a[live] + step * n[live], of[live]
                ok = (x >= d0[k]) & (x < d1[k]) & (y >= i0[k]) & (y < i1[k])
                ok[ok] = w[x[ok]] == self.words[y[ok]]
                live = live[ok]
                n[live] += 1
            return n

        all_hits = np.arange(len(pos))
        left = agree(pos - 1, at - 1, -1, all_hits)
        right = self.q + agree(pos + self.q, at + self.q, 1, all_hits)
        length = left + right
        found = [pd.DataFrame({"doc": doc, "item": item, "distance": 0, "n_words": length, "doc_word": pos - left - d0, "item_word": at - left - i0})[length >= self.run]]
        checked = found[0]
        if len(checked):  # the found stretch of exactly run words, verified by distance
            p0, a0 = (checked.doc_word + d0[checked.index]).to_numpy(), (checked.item_word + i0[checked.index]).to_numpy()
            k = np.arange(self.run)
            found[0] = checked[myers(self.words[a0[:, None] + k], w[p0[:, None] + k]) == 0]
        if self.errors:
            rest = np.flatnonzero(length < self.run)
            if self.errors == 1:
                most = np.zeros(len(rest), np.int64)
                for p, a, step in ((pos[rest] + right[rest], at[rest] + right[rest], 1), (pos[rest] - left[rest] - 1, at[rest] - left[rest] - 1, -1)):
                    there = (a >= i0[rest]) & (a < i1[rest])
                    for dp, da in ((1, 1), (1, 0), (0, 1)):  # a word changed, added, left out
                        gain = da + agree(p + step * dp, a + step * da, step, rest)
                        most = np.maximum(most, np.where(there | (da == 0), gain, 0))
                rest = rest[length[rest] + most >= self.run]
            shown = np.unique(found[0]["doc"].to_numpy(np.int64) * len(self.ids) + found[0]["item"].to_numpy(np.int64))
            rest = rest[~np.isin(doc[rest] * len(self.ids) + item[rest], shown)]
            for part in (rest[i : i + 20_000] for i in range(0, len(rest), 20_000)):
                for s in range(self.run - self.q + 1):  # windows that hold the tile after s of their words
                    a = at[part] - s
                    k = part[(a >= i0[part]) & (a + self.run <= i1[part])]
                    if not len(k):
                        continue
                    pattern = self.words[(at[k] - s)[:, None] + np.arange(self.run)]
                    col = (pos[k] - s - self.errors)[:, None] + np.arange(self.run + 2 * self.errors)
                    inside = (col >= d0[k][:, None]) & (col < d1[k][:, None])
                    text = np.where(inside, w[np.clip(col, 0, len(w) - 1)], np.uint64(0))
                    if self.errors > 1:
                        close = (text[:, :, None] == pattern[:, None, :]).any(axis=1).sum(axis=1) >= self.run - self.errors
                        k, pattern, text = k[close], pattern[close], text[close]
                    if len(k):
                        best = myers(pattern, text)
                        good = best <= self.errors
                        k = k[good]
                        found.append(pd.DataFrame({"doc": doc[k], "item": item[k], "distance": best[good], "n_words": self.run, "doc_word": np.maximum(pos[k] - s - d0[k], 0), "item_word": at[k] - s - i0[k]}))
        return pd.concat(found)


def item_blocks(items: DataFrame, block: int):
    """Distinct items in blocks of at most `block` words in all; the driver holds one block at a time."""
    now, size = [], 0
    for r in items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["item_id", "text"]).toLocalIterator():
        now.append((r.item_id, r.text))
        size += len(r.text) // 4 + 1
        if size >= block:
            yield now
            now, size = [], 0
    if now:
        yield now


def find_leaks(documents: DataFrame, items: DataFrame, run: int = 12, errors: int = 1, block: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, distance (word edits), n_words, doc_word, item_word: the closest leak of each pair."""
    docs, out = documents.select("doc_id", "text"), None
    blocks = item_blocks(items, block)
    while some := list(islice(blocks, TOGETHER)):
        held = [docs.sparkSession.sparkContext.broadcast(Tiles(x, run, errors)) for x in some]

        def search(batches, held=held):
            for x in batches:
                ids, hashed = x["doc_id"].to_numpy(np.int64), hashed_words([t if isinstance(t, str) else None for t in x["text"]])
                for tiles in held:
                    yield tiles.value.search(ids, *hashed)

        one = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInPandas(search, SCHEMA)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    best = F.min_by(F.struct("distance", "n_words", "doc_word", "item_word"), F.struct("distance", -F.col("n_words"), "doc_word", "item_word")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def leak_report(leaks: DataFrame) -> DataFrame:
    """Per item: documents that hold an exact or a nearly exact passage of it."""
    return leaks.groupBy("item_id").agg(F.count_if(F.col("distance") == 0).alias("n_exact"), F.count_if(F.col("distance") > 0).alias("n_near"), F.max("n_words").alias("longest_run"))
