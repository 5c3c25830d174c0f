"""Mixing sources to target weights by Pareto order sampling.

A source of share w of a mix of T tokens is to give w * T tokens. Its documents are allotted expected copies in
proportion to a weight (by default their size, so that a longer document is the likelier one), at most the source's cap; what the cap
cuts off goes to its other documents, until the target is met or every document is at the cap: then the source cannot
reach its share and is reported short. Each document gets the whole part of its expected copies for certain; the
fractional parts are inclusion odds of one more copy: documents are ranked by random odds over inclusion odds,
U / (1 - U) over p / (1 - p), and the first n of a source get it, n being the sum of its fractions, rounded. So the
sample is of fixed size and unequal probability.

The allotment takes a few rounds of sums per source, each of which can only move documents to the cap. The n-th
smallest rank of a source is found without sorting the source anywhere: ranks are counted in a fixed number of bins, the
bin that holds the cut is divided again, and only the rows of the last, narrow bin are ordered. Random numbers are
hashes of the document id and a seed. Sources are joined by broadcast only behind a count.

Defined cases: a null or blank source takes no part; names are compared without blanks around them and
case; a null or blank text has 0 tokens and is not used; repeated rows of a document count once (the least source, then size); sources without documents
or without tokens are reported with size 0 and not used; a source that cannot reach its share is used up to its cap and reported.
"""

from __future__ import annotations

import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from sumac.runtime import broadcast_if_small
from sumac.runtime import cut as checkpointed

#: A public tokenizer file, the same for all workers; a parameter of `n_tokens` and `sized`.
TOKENIZER = os.environ.get("SUMAC_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: Sources up to which their rates are broadcast.
FEW = 100_000


def source_name(c: Column) -> Column:
    c = F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
    return F.when(c != "", c)


@lru_cache(maxsize=4)
def _encoder(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def n_tokens(path: str = TOKENIZER):
    """A column function: tokens of whole texts under a public tokenizer file."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        out = []
        for k in range(0, len(texts), 256):
            some = [t if isinstance(t, str) else "" for t in texts.iloc[k : k + 256]]
            out += [len(e) for e in _encoder(path).encode_batch_fast(some, add_special_tokens=False)]
        return pd.Series(out, index=texts.index, dtype="int64")

    return count


def sized(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens of every document that has a source, one row per document."""
    d = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").filter("source IS NOT NULL AND doc_id IS NOT NULL")
    d = d.select("doc_id", "source", n_tokens(tokenizer)("text").alias("n_tokens"))
    return d.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.source", "d.n_tokens")


def targets(mix: DataFrame) -> DataFrame:
    return mix.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def capacity(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """source, size, total, target_share, max_repeats of every target; total covers listed sources and others."""
    size = docs.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n_docs"))
    total = size.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    return targets(mix).join(size, "source", "left").fillna(0, ["size", "n_docs"]).crossJoin(F.broadcast(total))  # one row


def allot(docs: DataFrame, cap: DataFrame, mix_tokens: int | None = None, weight: Column | None = None) -> DataFrame:
    """cap with rate and short: expected copies of a document are rate times its weight, at most max_repeats.

    In each round the rate follows from what the capped documents leave to the others; it only grows, so documents only
    join the capped ones, and the rounds end when none does. short: all are capped below the target."""
    w = docs.select("source", "n_tokens", (F.col("n_tokens") if weight is None else weight).cast("double").alias("w")).filter("n_tokens > 0 AND w > 0")
    goal = (F.lit(mix_tokens) if mix_tokens else F.col("total")).cast("double") * F.col("target_share")
    state = checkpointed(cap.select("*", goal.alias("goal"), F.lit(0.0).alias("rate"), F.lit(-1).cast("long").alias("capped")))  # one row a target
    while True:
        j = w.join(broadcast_if_small(state.select("source", "rate", F.col("max_repeats").alias("most")), FEW), "source")
        at = F.col("rate") * F.col("w") >= F.col("most")
        size = F.col("n_tokens").cast("double")
        sums = j.groupBy("source").agg(F.count_if(at).alias("now"), F.count_if(~at).alias("open"), F.coalesce(F.sum(F.when(at, F.col("most") * size)), F.lit(0.0)).alias("taken"), F.coalesce(F.sum(F.when(~at, F.col("w") * size)), F.lit(0.0)).alias("mass"))
        new = state.join(sums, "source", "left").select(*cap.columns, "goal", F.when(F.col("open") > 0, F.greatest("rate", (F.col("goal") - F.col("taken")) / F.col("mass"))).otherwise(F.col("rate")).alias("rate"), F.coalesce("now", F.lit(0)).alias("now"), "capped", (F.coalesce("open", F.lit(0)) == 0).alias("all_capped"))
        new = checkpointed(new.select("*", (F.col("now") != F.col("capped")).alias("moved")))
        if new.filter("moved").isEmpty():
            return new.select(*cap.columns, "rate", (F.col("all_capped") & (F.col("size") * F.col("max_repeats") < F.col("goal"))).alias("short"))
        state = new.select(*cap.columns, "goal", "rate", F.col("now").alias("capped"))


def expected_copies(docs: DataFrame, allotted: DataFrame, weight: Column | None = None) -> DataFrame:
    """docs with copies, the expected number of copies."""
    rate = broadcast_if_small(allotted.filter("size > 0").select("source", "rate", "max_repeats"), FEW)
    w = (F.col("n_tokens") if weight is None else weight).cast("double")
    copies = F.least(F.col("max_repeats").cast("double"), F.when(F.col("n_tokens") > 0, F.col("rate") * w).otherwise(F.lit(0.0)))
    return docs.join(rate, "source").select("doc_id", "source", "n_tokens", F.coalesce(copies, F.lit(0.0)).alias("copies"))


def pareto_sample(docs: DataFrame, seed: int = 42, bins: int = 1024, rounds: int = 2) -> DataFrame:
    """docs (doc_id, source, n_tokens, copies) with times: whole copies, and one more for the sample."""
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
    p = F.col("copies") - F.floor("copies")
    odds = (u / (1 - u)) / (p / (1 - p))
    docs = docs.select("*", F.floor("copies").cast("int").alias("whole"), F.when(p > 1e-12, odds / (1 + odds)).alias("rank"))
    have = docs.groupBy("source").agg(F.round(F.sum(F.col("copies") - F.floor("copies"))).cast("long").alias("left"))
    cut = checkpointed(have.select("source", F.lit(0.0).alias("lo"), F.lit(1.0).alias("width"), "left"))  # one row per source
    for _ in range(rounds):
        j = docs.filter("rank IS NOT NULL").join(broadcast_if_small(cut, FEW), "source").filter("rank >= lo AND rank < lo + width")
        n = j.groupBy("source", "lo", "width", "left", F.least(F.lit(bins - 1), F.floor((F.col("rank") - F.col("lo")) / F.col("width") * bins).cast("int")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most `bins` rows a source
        n = n.select("*", below.alias("below")).filter("below < left AND left <= below + n")
        n = n.select("source", (F.col("lo") + F.col("bin") * F.col("width") / bins).alias("lo2"), (F.col("width") / bins).alias("width2"), (F.col("left") - F.col("below")).alias("left2"))
        # a source without a cut inside its bins takes all of its documents, or none
        cut = checkpointed(cut.join(n, "source", "left").select("source", F.coalesce("lo2", F.when(F.col("left") > 0, F.lit(2.0)).otherwise(F.lit(0.0))).alias("lo"), F.coalesce("width2", F.lit(0.0)).alias("width"), F.coalesce("left2", F.lit(0)).alias("left")))
    j = docs.join(broadcast_if_small(cut, FEW), "source")
    edge = j.filter("rank >= lo AND rank < lo + width")
    edge = edge.select("doc_id", "source", (F.row_number().over(Window.partitionBy("source").orderBy("rank", "doc_id")) <= F.col("left")).alias("extra"))  # some 1 / bins ** rounds of a source
    j = j.join(edge, ["doc_id", "source"], "left")
    more = F.coalesce(F.col("extra"), F.col("rank") < F.col("lo"), F.lit(False)).cast("int")
    return j.select("doc_id", "source", "n_tokens", "copies", (F.col("whole") + more).alias("times"))


def short_sources(allotted: DataFrame) -> DataFrame:
    """Targets whose documents are all used up to the cap without reaching the share."""
    return allotted.filter("short").select("source")


def sample_checks(sample: DataFrame, allotted: DataFrame) -> DataFrame:
    """Per target: whole copies are exact, the sample has its fixed size, the cap holds, and the share is met to within one
    document's size, or the source is short and all of it is used."""
    whole = F.floor("copies")
    s = sample.groupBy("source").agg(
        F.count_if((F.col("times") < whole) | (F.col("times") > whole + 1)).alias("wrong"), F.sum(F.col("times") - whole).alias("extra"), F.sum(F.col("copies") - whole).alias("fractions"),
        F.max("times").alias("most"), F.sum(F.col("times") * F.col("n_tokens")).alias("used"), F.max("n_tokens").alias("largest"), F.count_if(F.col("n_tokens") > 0).alias("n_used"), F.sum(F.col("n_tokens") * (F.col("copies") - whole) * (1 - F.col("copies") + whole) * F.col("n_tokens")).alias("var"),
    )
    near = F.abs(F.col("used") - F.col("goal")) <= 4 * F.sqrt(F.col("var")) + F.col("largest")
    goal = F.col("total") * F.col("target_share")
    out = allotted.select("*", goal.alias("goal")).join(s, "source", "left")
    return out.select("source", F.coalesce(F.col("wrong") == 0, F.lit(True)).alias("whole_copies_exact"), F.coalesce(F.abs(F.col("extra") - F.col("fractions")) <= 0.5 + 1e-6, F.lit(True)).alias("size_fixed"), F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("cap_held"), F.coalesce(F.when(F.col("short"), F.col("used") == F.col("size") * F.col("max_repeats")).otherwise(near), F.col("size") == 0).alias("share_met"))


def shares(sample: DataFrame, cap: DataFrame) -> DataFrame:
    """Per source: documents, tokens used, share reached against the target."""
    used = sample.groupBy("source").agg(F.count_if(F.col("times") > 0).alias("n_used"), F.max("times").alias("most_times"), F.sum(F.col("times") * F.col("n_tokens")).alias("used_tokens"))
    all_used = used.agg(F.sum("used_tokens").alias("mix_tokens"))
    out = cap.join(used, "source", "left").crossJoin(F.broadcast(all_used))  # one row
    return out.select("source", "target_share", "max_repeats", "n_docs", "size", F.coalesce("n_used", F.lit(0)).alias("n_used"), F.coalesce("most_times", F.lit(0)).alias("most_times"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.round(F.coalesce(F.try_divide("used_tokens", "mix_tokens"), F.lit(0.0)), 6).alias("share"))
