"""Sinks: JSON lines, runs, judgements, wide metric tables, manifests. Each writes in parallel; order is kept where the format has one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumac.functions.columns import doc_key, topic_key
from sumac.runtime import broadcast_if_small, cut


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def run_lines(run: DataFrame, name: str, rounded: bool = True) -> DataFrame:
    """value: qid Q0 doc rank score name, scores with six decimals or as they are."""
    score = F.format_string("%.6f", F.col("score").cast("double")) if rounded else F.col("score").cast("string")
    return run.select(F.concat_ws("\t", "qid", F.lit("Q0"), "doc_id", F.col("rank").cast("string"), score, F.lit(name)).alias("value"), "qid", "rank")


def write_run(run: DataFrame, path: str, name: str, rounded: bool = True) -> None:
    """A run in order of qid as string, then rank; a range partition per file, so files joined in order are the run."""
    run_lines(run, name, rounded).orderBy("qid", "rank").select("value").write.mode("overwrite").text(path)


def qrel_lines(qrels: DataFrame) -> DataFrame:
    return qrels.select(F.concat_ws("\t", "qid", F.lit("0"), "doc_id", F.col("rel").cast("string")).alias("value"), topic_key(F.col("qid")).alias("t"), doc_key(F.col("doc_id")).alias("d"))


def write_qrels(qrels: DataFrame, path: str) -> None:
    """Judgements by natural topic and numeric document; an existing path is an error."""
    qrel_lines(qrels).orderBy("t", "d").select("value").write.mode("errorifexists").text(path)


def wide_metrics(metrics: DataFrame, names: list[str] | None = None) -> DataFrame:
    """run, metric, value to one row a run, one column a metric, N/A where missing. names bounds the columns and saves a pass."""
    df = metrics.withColumn("value", F.format_string("%.4f", F.col("value").cast("double")))
    return df.groupBy("run").pivot("metric", names).agg(F.first("value")).na.fill("N/A")


def mixed_rows(frames: list[DataFrame]) -> DataFrame:
    """Union of all columns, blanks where a frame has none."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in out.columns])


def write_by_year(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("year").json(path)


def token_map(tokens: DataFrame) -> DataFrame:
    """kind, token, id: injective, by sorted token; node ids from 60000, edge ids from 500. Ranks come from sorted ranges, not from one task."""
    kinds = tokens.select("kind", "token").distinct()
    ranked = kinds.orderBy("kind", "token").select("kind", "token", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("m"))
    inside = (F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("n")
    ranked = cut(ranked.select("kind", "token", "part", inside))
    # one row a kind and partition
    sizes = ranked.groupBy("kind", "part").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("k"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("k").over(Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = F.when(F.col("kind") == "N", F.lit(60000)).otherwise(F.lit(500))
    return ranked.join(broadcast_if_small(sizes.select("kind", "part", "first", before.alias("before")), 100_000), ["kind", "part"]).select("kind", "token", (base + F.col("before") + F.col("n") - F.col("first")).cast("bigint").alias("id"))


def escaped(token):
    """Line breaks, tabs and backslashes of a token written so that they can be read back."""
    return F.replace(F.replace(F.replace(token, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))


def checksums(spark, path: str) -> DataFrame:
    """file_name, sha256 of every file below path; each file is one row, so for manifests and reports."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("sha256"))


def track(metrics: DataFrame, path: str, run_id: str) -> None:
    """Append a run's metrics to the tracker's table; a run id that is there already is resumed, not doubled."""
    df = metrics.withColumn("run_id", F.lit(run_id))
    try:
        old = metrics.sparkSession.read.parquet(path).select("run_id", "metric")
        df = df.join(old, ["run_id", "metric"], "left_anti")
    except Exception as e:  # the first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").parquet(path)


def markdown(rows: list[dict], columns: list[str], title: str) -> str:
    """A small report table; rows are already on the driver."""
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([f"# {title}", "", line(columns), line(["---"] * len(columns)), *[line([r.get(c) for c in columns]) for r in rows]])


def corpus_lines(tuples: DataFrame) -> DataFrame:
    """One line a formula: its encoded tuples joined by blanks."""
    return tuples.select(F.array_join("words", " ").alias("value"))


def schema_report(frames: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    return [(name, c, t) for name, df in frames.items() for c, t in df.dtypes]
