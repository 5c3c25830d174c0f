"""Vectors of formulas: token training, sentence means, mean shift, statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumac.functions.columns import dot, norm, unit
from sumac.streaming.ingest import submit_chunks


def train(lines: DataFrame, dim: int = 150, window: int = 5, epochs: int = 5, least: int = 1, seed: int = 1, partitions: int = 8) -> DataFrame:
    """token, v of a skip-gram model over token lists (words)."""
    from pyspark.ml.feature import Word2Vec

    model = Word2Vec(vectorSize=dim, windowSize=window, maxIter=epochs, minCount=least, seed=seed, numPartitions=partitions, inputCol="words", outputCol="o").fit(lines)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("v"))


def elementwise_mean(df: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """by, v: mean of vectors, summed in partitions before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return df.groupBy(*by).agg(Summarizer.mean(array_to_vector(F.col(v).cast("array<double>"))).alias("_m")).select(*by, vector_to_array("_m").alias("v"))


def hashed_vectors(tokens: DataFrame, dim: int = 64) -> DataFrame:
    """token, v of every distinct token without training: 1 or -1 at a dimension of its hash."""
    digit = lambda a, n: F.conv(F.substring(F.md5("token"), a, n), 16, 10).cast("int")
    t = tokens.select("token").distinct().select("token", (digit(1, 4) % dim).alias("i"), F.when(digit(5, 1) % 2 == 0, 1.0).otherwise(-1.0).alias("s"))
    return t.select("token", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.when(k == F.col("i"), F.col("s")).otherwise(0.0)).alias("v"))


def hashed_units(tokens: Column, dim: int = 64) -> Column:
    """The sum of the hashed vectors of a row's tokens, of length one; null where nothing is left. Rows are read where they lie, none is shuffled."""

    def place(token: str) -> tuple[int, float]:
        h = hashlib.md5(token.encode()).hexdigest()
        return int(h[:4], 16) % dim, -1.0 if int(h[4], 16) % 2 else 1.0

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def f(rows: pa.Array) -> pa.Array:
        each = rows.flatten().dictionary_encode()
        at = [place(t) for t in each.dictionary.to_pylist()]
        index, sign = np.array([i for i, _ in at], np.int64), np.array([x for _, x in at])
        n, code = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(), each.indices.to_numpy()
        cell = np.repeat(np.arange(len(rows)), n) * dim + index[code]
        v = np.bincount(cell, sign[code], minlength=len(rows) * dim).reshape(len(rows), dim).astype(np.float64)
        long = np.sqrt((v * v).sum(axis=1))
        v /= np.where(long > 0, long, 1.0)[:, None]
        ends = np.concatenate([[0], np.cumsum(np.where(long > 0, dim, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v[long > 0].ravel()), mask=pa.array(long == 0))

    return f(tokens)


def sentence_vectors(tokens: DataFrame, vectors: DataFrame, key: str, dim: int) -> DataFrame:
    """Mean over in-vocabulary tokens (key, token), repeats counted; zeros where none is known."""
    known = elementwise_mean(tokens.join(vectors, "token").select(key, "v"), [key])
    zero = F.array(*[F.lit(0.0)] * dim)
    return tokens.select(key).distinct().join(known, key, "left").select(key, F.coalesce("v", zero).alias("v"))


def mean_shift(vectors: DataFrame, key: str, least: float = 1e-9) -> DataFrame:
    """Vectors less their mean, normalised; null where nothing is left."""
    m = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = m.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("mean"))
    shifted = vectors.crossJoin(F.broadcast(mean)).select(key, F.zip_with("v", "mean", lambda a, b: a.cast("double") - b).alias("s"))  # one row
    return shifted.select(key, F.when(norm(F.col("s")) >= least, unit(F.col("s"))).alias("v"))


def statistics(vectors: DataFrame) -> DataFrame:
    n = norm(F.col("v"))
    return vectors.agg(F.count("v").alias("n"), F.max(F.size("v")).cast("bigint").alias("dim"), F.round(F.avg(n), 6).alias("norm_mean"), F.round(F.stddev_pop(n), 6).alias("norm_std"), F.round(F.min(n), 6).alias("norm_min"), F.round(F.max(n), 6).alias("norm_max"))


def cone(vectors: DataFrame) -> DataFrame:
    """n_pairs, mean of all pairwise cosines, without forming pairs: (|sum of unit vectors|^2 - n) / (n (n - 1))."""
    u = vectors.filter("v IS NOT NULL").select(unit(F.col("v")).alias("u"))
    s = u.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("sq"))
    n = u.agg(F.count(F.lit(1)).alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return s.crossJoin(F.broadcast(n)).select(pairs.cast("bigint").alias("n_pairs"), F.round((F.col("sq") - F.col("n")) / (2 * pairs), 6).alias("mean_cosine"))


def golden_cosine(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with cosine in [0, 1], null where a side is missing."""
    c = dot(unit(F.col("a")), unit(F.col("b")))
    return pairs.withColumn("cosine", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))))


def cooccurrences(lines: DataFrame, window: int = 5) -> DataFrame:
    """token, context, n: how often two tokens of a line (words) lie within the window of each other."""
    at = F.posexplode("words").alias("i", "token")
    near = lambda i: F.concat(F.slice("words", F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window))), F.slice("words", i + 2, F.lit(window)))
    each = lines.filter("size(words) > 1").select("words", at).select("token", F.explode(near(F.col("i"))).alias("context"))
    return each.groupBy("token", "context").agg(F.count(F.lit(1)).alias("n"))


def train_files(spark: SparkSession, source: str, schema: str, state: str, checkpoint: str, lines: Callable[[DataFrame], DataFrame], window: int = 5, per_batch: int | None = None) -> None:
    """Counts of the files that the state lacks, added to it, then stop; a later start goes on after the last committed file.

    Counts add up exactly, whatever the batches, so that an interrupted training ends like one in a single run."""

    def add(df: DataFrame, k: int) -> None:
        cooccurrences(lines(df), window).write.mode("overwrite").parquet(f"{state}/batch={k}")

    submit_chunks(spark, source, schema, checkpoint, add, per_batch or 1_000_000)


def counted_vectors(counts: DataFrame, dim: int = 150) -> DataFrame:
    """token, n, v: positive pointwise mutual information of a token with its contexts, each context at the dimension and with the sign of its hash."""
    c = counts.groupBy("token", "context").agg(F.sum("n").alias("n"))
    own = c.groupBy("token").agg(F.sum("n").alias("total"))
    whole = own.agg(F.sum("total").alias("whole"))
    j = c.join(own, "token").join(own.select(F.col("token").alias("context"), F.col("total").alias("of_context")), "context").crossJoin(F.broadcast(whole))  # one row
    weight = F.greatest(F.lit(0.0), F.log(F.col("n").cast("double") * F.col("whole") / (F.col("total").cast("double") * F.col("of_context"))))
    digit = lambda a, n: F.conv(F.substring(F.md5("context"), a, n), 16, 10).cast("int")
    parts = j.select("token", "n", (digit(1, 4) % dim).alias("i"), (weight * F.when(digit(5, 1) % 2 == 0, 1.0).otherwise(-1.0)).alias("x")).groupBy("token", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    rows = parts.groupBy("token").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))  # at most one entry a dimension
    return rows.select("token", "n", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))).alias("v"))


def encoded(texts: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", batch: int = 256) -> DataFrame:
    """texts with v, float32 vectors of a text model. `encoder` makes the model once in each worker; it is given lists of at
    most `batch` texts. A null text has no vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for x in batches:
            known = [k for k, t in enumerate(x[text]) if isinstance(t, str)]
            out = [None] * len(x)
            if known:
                model = model or encoder()
                for a in range(0, len(known), batch):
                    some = known[a : a + batch]
                    for k, v in zip(some, np.asarray(model([x[text].iloc[k] for k in some]), np.float32), strict=True):
                        out[k] = v
            yield x.assign(v=pd.Series(out, index=x.index, dtype=object))

    fields = ", ".join(f"`{n}` {t}" for n, t in texts.drop("v").dtypes)
    return texts.drop("v").mapInPandas(run, f"{fields}, v array<float>")


def fp16(vectors: DataFrame) -> DataFrame:
    from sumac.operators.search import half

    return vectors.withColumn("v", half(F.col("v")))
