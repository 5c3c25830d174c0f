"""One row per key without shuffling the texts of keys that occur once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumac.runtime import cut


def once(df: DataFrame, key: str, few: int = 200_000) -> DataFrame:
    """df with the least row of each key; rows without a key are left out.

    Keys alone are counted first, a narrow shuffle, and those that repeat are kept. Only rows of repeated keys are
    grouped; the others stay where they are, parted from them by an anti join that is broadcast if the keys are few."""
    df = df.filter(F.col(key).isNotNull())
    many = cut(df.groupBy(key).agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select(key))
    n = many.count()
    if not n:
        return df
    many = F.broadcast(many) if n <= few else many
    rest = [c for c in df.columns if c != key]
    least = df.join(many, key, "left_semi").groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    return df.join(many, key, "left_anti").select(key, *rest).unionByName(least)
