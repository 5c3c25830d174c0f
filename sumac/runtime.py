"""Session helpers shared by every operator: table access, lineage cuts, size checks."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "sumac", cores: str = "*") -> SparkSession:
    """A local session for tests and benches; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return guarded(spark)


def guarded(spark: SparkSession) -> SparkSession:
    """Turn off the partitioning that Spark 4.1 claims for unions: with adaptive plans it joins rows of a union
    more than once (m6_rerank gave 20,500 rows for 12,500). The setting costs at most an exchange after a union.
    Times are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    except Exception:  # a Spark without the setting has not got the fault
        pass
    return spark


@contextmanager
def settings(spark: SparkSession, of: dict[str, str]):
    """Settings of the session for what runs inside; a Spark that does not know one goes on without it."""
    old = {}
    for k, v in of.items():
        try:
            before = spark.conf.get(k)
            spark.conf.set(k, v)
            old[k] = before
        except Exception:
            pass
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    guarded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a
    temporary folder and a cluster an error, since a folder of one machine is lost to the others."""
    sc = guarded(spark).sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="sumac-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a checkpoint in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows: a count in all partitions at once, of which only numbers travel.

    Frames asked for are narrow keys, cheap to make again, or kept."""
    return df.count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only behind a check of the size; beyond it Catalyst picks a shuffle join."""
    return F.broadcast(df) if small_enough(df, max_rows) else df
