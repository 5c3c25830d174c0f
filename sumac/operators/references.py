"""References to records that do not exist: states of direct orphans and their fixpoint cascade.

Foreign keys of any number of tables are brought into one narrow table of references, which meets one
row of facts per target key (first load, first removal). Bad references are direct orphans. Children of
orphaned records then become indirect orphans: semi-joins down the foreign-key graph are repeated until
a round finds no new record. Every record enters the frontier once, so cycles end.

Defined cases: a null or blank key is no reference; blanks around a key and a trailing ".0" do not matter;
repeated rows of a record count once (the one loaded first, then the smallest in all its columns); a
null reference time is never "deleted" or "late" and has a null month; empty tables give no rows; a
removal log with several rows for a key counts the first removal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumac.runtime import cut


@dataclass(frozen=True)
class ForeignKey:
    """field of table names id of target; time says when the reference was made, loaded orders repeated rows."""

    table: str
    field: str
    target: str
    record_id: str = "id"
    time: str = "loaded_at"
    loaded: str = "loaded_at"


def normal_key(c: Column) -> Column:
    """The key without surrounding blanks and a trailing ".0"; null if nothing is left."""
    c = F.regexp_replace(c.cast("string"), r"^[\s ​﻿]+|[\s ​﻿]+$", "")
    c = F.regexp_replace(c, r"\.0$", "")
    return F.when(c != "", c)


def first_loaded(df: DataFrame, key: str, loaded: str, fields: list[str]) -> DataFrame:
    """One row per key: the one loaded first, ties by the remaining fields."""
    rest = [F.col(c) for c in fields if c not in (key, loaded)]
    order = F.struct(F.col(loaded).isNull(), F.col(loaded), *rest)
    body = F.struct(*[F.col(c) for c in dict.fromkeys([loaded, *fields])])
    return df.groupBy(F.col(key)).agg(F.min_by(body, order).alias("_row")).select(F.col(key).alias("_key"), "_row")


def references(tables: dict[str, DataFrame], keys: list[ForeignKey]) -> DataFrame:
    """table_name, field_name, record_key, target_table, ref_key, ref_time: one row per reference."""
    out = None
    for fk in keys:
        one = first_loaded(tables[fk.table].select(*dict.fromkeys([fk.record_id, fk.field, fk.time, fk.loaded])), fk.record_id, fk.loaded, [fk.field, fk.time])
        one = one.select(
            F.lit(fk.table).alias("table_name"),
            F.lit(fk.field).alias("field_name"),
            F.col("_key").cast("string").alias("record_key"),
            F.lit(fk.target).alias("target_table"),
            normal_key(F.col(f"_row.{fk.field}")).alias("ref_key"),
            F.col(f"_row.{fk.time}").cast("timestamp").alias("ref_time"),
        ).filter("ref_key IS NOT NULL AND record_key IS NOT NULL")
        out = one if out is None else out.unionByName(one)
    return out


def target_facts(tables: dict[str, DataFrame], keys: list[ForeignKey], removed: DataFrame) -> DataFrame:
    """target_table, ref_key, first_loaded, is_stored, removed_at: one row per key stored or removed."""
    stored = None
    for target in sorted({fk.target for fk in keys}):
        one = tables[target].select(F.lit(target).alias("target_table"), normal_key(F.col("id")).alias("ref_key"), F.col("loaded_at").cast("timestamp").alias("first_loaded"), F.lit(None).cast("timestamp").alias("removed_at"), F.lit(1).alias("is_stored"))
        gone = removed.select(F.lit(target).alias("target_table"), normal_key(F.col("post_id")).alias("ref_key"), F.lit(None).cast("timestamp").alias("first_loaded"), F.col("removed_at").cast("timestamp"), F.lit(0).alias("is_stored"))
        both = one.unionByName(gone)
        stored = both if stored is None else stored.unionByName(both)
    return stored.filter("ref_key IS NOT NULL").groupBy("target_table", "ref_key").agg(F.min("first_loaded").alias("first_loaded"), F.min("removed_at").alias("removed_at"), F.max("is_stored").alias("is_stored"))


def resolve(refs: DataFrame, facts: DataFrame) -> DataFrame:
    """refs with ref_state: deleted, missing, late or null (fine). A hot key is one fact row, so only the reference side is skewed and AQE may split it."""
    state = (
        F.when(F.col("removed_at") <= F.col("ref_time"), F.lit("deleted"))
        .when(F.coalesce(F.col("is_stored"), F.lit(0)) == 0, F.lit("missing"))
        .when(F.col("first_loaded") > F.col("ref_time"), F.lit("late"))
    )
    return refs.join(facts, ["target_table", "ref_key"], "left").select("table_name", "field_name", "record_key", "target_table", "ref_key", "ref_time", state.alias("ref_state"))


def orphan_references(tables: dict[str, DataFrame], keys: list[ForeignKey], removed: DataFrame) -> DataFrame:
    """Direct and inherited orphan references.

    Columns: table_name, field_name, record_key, ref_key, ref_state, ref_month, origin, depth. ref_state is
    that of the reference itself for direct orphans and "inherited" for a good reference to an orphaned
    record; depth is 0 for direct ones, else the number of the cascade's round.
    """
    refs = cut(resolve(references(tables, keys), target_facts(tables, keys, removed)))
    bad, fine = refs.filter("ref_state IS NOT NULL"), refs.filter("ref_state IS NULL")
    targets = sorted({fk.target for fk in keys})
    found = bad.select("*", F.lit("direct").alias("origin"), F.lit(0).alias("depth"))
    record = [F.col("table_name").alias("target_table"), normal_key(F.col("record_key")).alias("ref_key")]
    frontier = cut(bad.filter(F.col("table_name").isin(targets)).select(*record).distinct())
    seen, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        hit = cut(fine.join(frontier, ["target_table", "ref_key"], "left_semi"))
        found = found.unionByName(hit.select("table_name", "field_name", "record_key", "target_table", "ref_key", "ref_time", F.lit("inherited").alias("ref_state"), F.lit("inherited").alias("origin"), F.lit(depth).alias("depth")))
        frontier = cut(hit.filter(F.col("table_name").isin(targets)).select(*record).distinct().join(seen, ["target_table", "ref_key"], "left_anti"))
        seen = seen.unionByName(frontier)
    return found.select("table_name", "field_name", "record_key", "ref_key", "ref_state", F.date_format("ref_time", "yyyy-MM").alias("ref_month"), "origin", "depth")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, field, month, origin and state."""
    return orphans.groupBy("table_name", "field_name", "ref_month", "origin", "ref_state").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("ref_key").alias("n_keys"))
