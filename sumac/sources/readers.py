"""Readers of posts, topics, formula shards, judgements, runs and audits. All are lazy and splittable unless said otherwise."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POST_SCHEMA = "_Id STRING, _PostTypeId INT, _ParentId STRING, _Title STRING, _Tags STRING, _Score INT, _AcceptedAnswerId STRING, _Body STRING"
NULLS = ("", "null", "None")


class _Math(HTMLParser):
    """Text pieces and formulas of a post: a math-container span becomes its text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.formulas, self.depth, self.id, self.latex = [], [], 0, None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.depth and tag == "span":
            self.depth += 1
        elif not self.depth and tag == "span" and "math-container" in (a.get("class") or "").split():
            self.depth, self.id, self.latex = 1, a.get("id") or "", []

    def handle_endtag(self, tag):
        if self.depth and tag == "span":
            self.depth -= 1
            if not self.depth:
                latex = "".join(self.latex).strip()
                self.parts.append(latex)
                self.formulas.append({"formula_id": self.id, "latex": latex})

    def handle_data(self, data):
        (self.latex if self.depth else self.parts).append(data if self.depth else data.strip())


def html_text(markup: str | None) -> dict:
    """text with formulas in place, pieces joined by one blank, and the formulas."""
    p = _Math()
    p.feed(markup or "")
    p.close()
    return {"text": " ".join(x for x in p.parts if x).strip(), "formulas": p.formulas}


def html_text_udf():
    @F.pandas_udf("struct<text:string,formulas:array<struct<formula_id:string,latex:string>>>")
    def f(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html_text(x) for x in c], columns=["text", "formulas"])

    return f


def posts_xml(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One row per <row>, malformed ones kept as nulls; attributes without their underscore."""
    df = spark.read.format("xml").option("rowTag", "row").option("mode", "PERMISSIVE").schema(POST_SCHEMA).load(path)
    df = df.select(*[F.col(c).alias(c[1:]) for c in df.columns])
    return df.limit(limit) if limit else df


def split_posts(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers and questions; other post types are dropped. One scan each, narrow after the filter."""
    from sumac.functions.columns import post_tags

    body = html_text_udf()(F.col("Body"))
    base = [F.col("Id").alias("id"), F.coalesce("Score", F.lit(0)).alias("score")]
    answers = posts.filter("PostTypeId = 2").select(*base, F.col("ParentId").alias("parent_id"), body.alias("b"))
    questions = posts.filter("PostTypeId = 1").select(*base, F.coalesce("Title", F.lit("")).alias("title"), post_tags(F.coalesce("Tags", F.lit(""))).alias("tags"), F.col("AcceptedAnswerId").alias("accepted_answer_id"), body.alias("b"))
    flat = lambda df: df.select("*", F.col("b.text").alias("body_text"), F.col("b.formulas").alias("formulas")).drop("b")
    return flat(answers), flat(questions)


def topics_xml(spark: SparkSession, path: str) -> DataFrame:
    """Task 1 topics: number attribute, title, question and tags elements as written."""
    df = spark.read.format("xml").option("rowTag", "Topic").schema("_number STRING, Title STRING, Question STRING, Tags STRING").load(path)
    return df.select(F.col("_number").alias("topic_id"), F.col("Title").alias("title"), F.col("Question").alias("question"), F.col("Tags").alias("tags"))


def formula_topics_xml(spark: SparkSession, path: str) -> DataFrame:
    """Task 2 topics that have both a formula id and LaTeX."""
    df = spark.read.format("xml").option("rowTag", "Topic").schema("_number STRING, Latex STRING, Formula_Id STRING").load(path)
    df = df.select(F.col("_number").alias("topic_id"), F.trim("Latex").alias("query_latex"), F.trim("Formula_Id").alias("source_formula_id"))
    return df.filter("query_latex <> '' AND source_formula_id <> ''")


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines skipped, malformed ones dropped or fatal."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def numbered_tsv(spark: SparkSession, path: str | list[str], schema: str | None = None, columns: list[str] | None = None, limit: int | None = None, skip_unreadable: bool = False) -> DataFrame:
    """Numbered TSV shards with headers: shard number, unlimited field size, projected to columns.

    An unreadable shard is an error unless skip_unreadable; `skipped_files` then names those that were left out."""
    reader = spark.read.option("sep", "\t").option("header", True).option("maxCharsPerColumn", -1).option("quote", "").option("ignoreCorruptFiles", skip_unreadable)
    df = (reader.schema(schema) if schema else reader).csv(path)
    shard = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).try_cast("int").alias("shard")
    df = df.select(*(columns or df.columns), shard)
    return df.limit(limit) if limit else df


def skipped_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file_name of every non-empty file of which no line can be read. Files are read as lines, one column of which only the first is needed."""
    paths = [path] if isinstance(path, str) else path
    there = spark.read.format("binaryFile").load(paths).filter("length > 0").select("path")
    lines = spark.read.option("ignoreCorruptFiles", True).text(paths).select(F.col("_metadata.file_path").alias("path")).distinct()
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    return there.select(name).join(lines.select(name), "file_name", "left_anti")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Fields of white-space separated lines with their place: file, start of its block, line within the block.

    Splits are packed into partitions by size, so that row numbers alone do not follow the files."""
    df = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return df.select(F.split(F.trim(F.col("value")), r"\s+").alias("p"), place.alias("pos"))


def qrels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """qid, doc_id, rel; lines of fewer than four fields skipped; of repeated pairs the last wins, by file name and line."""
    df = _lines(spark, path).filter(F.size("p") >= 4).select(F.col("p")[0].alias("qid"), F.col("p")[2].alias("doc_id"), F.col("p")[3].try_cast("int").alias("rel"), "pos")
    return df.groupBy("qid", "doc_id").agg(F.max_by("rel", "pos").alias("rel"))


def run(spark: SparkSession, path: str, six_only: bool = False) -> DataFrame:
    """qid, doc_id, rank, score, pos of a run with or without its Q0 column, told apart line by line."""
    df = _lines(spark, path).filter(F.size("p") >= 5)
    q0 = F.upper(F.col("p")[1]) == "Q0"
    if six_only:
        df = df.filter(q0 & (F.size("p") >= 6))
    at = lambda a, b: F.when(q0, F.get("p", F.lit(a))).otherwise(F.get("p", F.lit(b)))
    return df.select(F.col("p")[0].alias("qid"), at(2, 1).alias("doc_id"), at(3, 2).try_cast("int").alias("rank"), at(4, 3).try_cast("double").alias("score"), "pos")


def instance_run(spark: SparkSession, path: str) -> DataFrame:
    """topic, formula_id, post_id, rank, score of an instance run."""
    df = _lines(spark, path).filter(F.size("p") >= 5)
    return df.select(F.col("p")[0].alias("topic"), F.col("p")[1].alias("formula_id"), F.col("p")[2].alias("post_id"), F.col("p")[3].try_cast("int").alias("rank"), F.col("p")[4].try_cast("double").alias("score"))


def null_spellings(c: Column) -> Column:
    return F.when(~F.trim(c).isin(*NULLS), c)


def audit_csv(spark: SparkSession, path: str) -> DataFrame:
    """Audit table with every spelling of null as null; numbers are cast by the caller."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return df.select(*[null_spellings(F.col(c)).alias(c) for c in df.columns])


def golden_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Golden formula pairs; a missing column is an error."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    missing = {"query_equation", "candidate_equation", "relevance"} - set(df.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    return df


def checked_runs(spark: SparkSession, paths: list[str], least: int = 2) -> list[str]:
    """paths, after each was seen to be a non-empty file; at least two of them."""
    if len(paths) < least:
        raise ValueError(f"at least {least} runs are needed")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for p in paths:
        path = hadoop.Path(p)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            raise FileNotFoundError(p)
        if any(f.isDirectory() for f in fs.listStatus(path)):
            raise ValueError(f"not a file, nor a folder of part files: {p}")
        if fs.getContentSummary(path).getLength() == 0:
            raise ValueError(f"empty run: {p}")
    return paths


def unescaped(c: Column) -> Column:
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else html.unescape(x))

    return f(c)
