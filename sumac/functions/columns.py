"""Scalar column functions of the engine, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumac.functions.formula import ESCAPES

#: Display names of the metric engine's measures.
FAMILIES = {"ndcg_cut": "ndcg", "P": "precision", "recall": "recall", "map_cut": "map"}
CUTOFFS = (5, 10, 20, 100, 1000)
#: Price of a million tokens by model, and of any other.
RATES = {"judge-large": 2.5, "judge-small": 0.15, "judge-mini": 0.1}
DEFAULT_RATE = 0.15
REFERENCE_JOIN = "\n\n---\n\n"


def post_tags(c: Column) -> Column:
    """<a><b> to a list."""
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(c, "<", ""), ">", " "), r"\s+"), lambda x: x != "")


def topic_tags(c: Column) -> Column:
    """Comma list, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def query_text(title: Column, question: Column) -> Column:
    """Title and question for retrieval; null if nothing is left."""
    t = F.trim(F.concat_ws(" ", title, question))
    return F.when(t != "", t)


def question_text(title: Column, question: Column, judge: bool) -> Column:
    """Title, blank line, question; the judge's is trimmed."""
    t = F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(question, F.lit("")))
    return F.regexp_replace(t, r"^\s+|\s+$", "") if judge else t


def topic_key(c: Column) -> Column:
    """A.301 to a struct that sorts naturally."""
    return F.struct(F.split_part(c, F.lit("."), F.lit(1)).alias("series"), F.split_part(c, F.lit("."), F.lit(2)).try_cast("int").alias("number"))


def doc_key(c: Column) -> Column:
    """Numeric ids first, by value."""
    n = c.try_cast("bigint")
    return F.struct(n.isNull().alias("text"), n.alias("number"), c.alias("id"))


def strip_math(c: Column) -> Column:
    """LaTeX without its outer delimiters and environments."""
    s = F.regexp_replace(F.trim(c), r"(?s)\\begin\{[^}]*\}(.*?)\\end\{[^}]*\}", "$1")
    return F.trim(
        F.when(s.startswith("$$") & s.endswith("$$") & (F.length(s) >= 4), F.regexp_replace(s, r"^\$\$|\$\$$", ""))
        .when(s.startswith("\\[") & s.endswith("\\]"), F.regexp_replace(s, r"^\\\[|\\\]$", ""))
        .when(s.startswith("$") & s.endswith("$") & (F.length(s) >= 2), F.regexp_replace(s, r"^\$|\$$", ""))
        .otherwise(s)
    )


def drop_percent(c: Column) -> Column:
    return F.regexp_replace(c, r"([^\\])%", "$1")


def query_variables(c: Column) -> Column:
    """Identifiers qvar_x as query variable elements."""
    return F.regexp_replace(c, r"<mi.*?>qvar_(.*)</mi>", '<mws:qvar xmlns:mws="http://search.mathweb.org/ns" name="$1"/>')


def clean_symbol(c: Column) -> Column:
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    out = s
    for code, to in ESCAPES.items():
        out = F.replace(out, F.lit(chr(code)), F.lit(to))
    return F.when(s.isin("⁡", "⁢", "⁣", "⁤"), F.lit("")).otherwise(out)


def tag_facts(tag: Column) -> Column:
    """variable, wildcard, number, matrix, typed."""
    return F.struct(
        (tag.startswith("V!") | tag.startswith("?")).alias("is_variable"),
        tag.startswith("?").alias("is_wildcard"),
        tag.startswith("N!").alias("is_number"),
        tag.startswith("M!").alias("is_matrix"),
        (F.substring(tag, 2, 1) == "!").alias("has_type"),
    )


def binary(rel: Column) -> Column:
    return (rel >= 2).cast("int")


def agreement(human: Column, judge: Column) -> Column:
    """Signed delta, graded and binary agreement; null where a label is."""
    return F.struct((judge - human).alias("delta"), (judge == human).alias("agree_graded"), (binary(judge) == binary(human)).alias("agree_binary"))


def year_of(name: Column) -> Column:
    y = F.regexp_extract(name, "(2020|2021|2022)", 1)
    return F.when(y != "", y)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def metric_cache_key(topic: Column, metric: Column, question: Column, response: Column, contexts: Column, reference: Column, model: Column, needs_context: Column, needs_reference: Column) -> Column:
    return cache_key(topic, metric, question, response, F.when(needs_context, F.array_join(contexts, "\n")), F.when(needs_reference, reference), model)


def refuses_anywhere(response: Column, phrase: str) -> Column:
    return F.contains(F.lower(response), F.lit(phrase.lower()))


def refuses_first(response: Column, prefix: str) -> Column:
    return F.lower(F.regexp_replace(response, r"^\s+|\s+$", "")).startswith(prefix.lower())


def at_ceiling(completion: Column, most: Column) -> Column:
    return completion >= most


def score_of_distance(d: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + d)


def cosine_of_distance(d: Column) -> Column:
    return F.lit(1.0) - d / F.lit(2.0)


def metric_name(c: Column, prime: bool = False) -> Column:
    """ndcg_cut_10 to ndcg@10 or ndcg'@10."""
    mark = "'@" if prime else "@"
    out = F.when(c.isin("map", "bpref"), F.concat(c, F.lit("'" if prime else "")))
    for family, name in FAMILIES.items():
        out = out.when(c.rlike(f"^{family}_\\d+$"), F.concat(F.lit(name + mark), F.regexp_extract(c, r"(\d+)$", 1)))
    return out


def is_shallow(metric: Column) -> Column:
    """No cutoff, or one of 5, 10, 20 after the last @."""
    return ~F.contains(metric, F.lit("@")) | F.element_at(F.split(metric, "@"), -1).isin("5", "10", "20")


def cost(tokens: Column, model: Column) -> Column:
    rate = F.coalesce(F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv])[model], F.lit(DEFAULT_RATE))
    return F.round(tokens / F.lit(1e6) * rate, 6)


def prompt(system: str, user: str, question: Column, contexts: Column) -> Column:
    """system and user message; {question} and {context} of the user template are filled, an empty context takes its heading along."""
    block = F.when(F.size(contexts) > 0, F.concat(F.lit("Context:\n"), F.array_join(contexts, "\n\n"), F.lit("\n\n"))).otherwise(F.lit(""))
    return F.struct(F.lit(system).alias("system"), F.replace(F.replace(F.lit(user), F.lit("{context}"), block), F.lit("{question}"), question).alias("user"))


def number_or_null(c: Column) -> Column:
    """Blank, null, none and nan cells are not scored."""
    n = F.when(~F.lower(F.trim(c)).isin("", "null", "none", "nan"), c).try_cast("double")
    return F.when(~F.isnan(n), n)


def judge_label(raw: Column) -> Column:
    """label and parse_ok of a judge's JSON, fenced or bare; broken JSON and labels outside 0 to 3 do not parse."""
    bare = F.regexp_replace(raw, r"^\s*```(?:json)?\s*|\s*```\s*$", "")
    label = F.try_variant_get(F.try_parse_json(bare), "$.label", "int")
    label = F.when(label.between(0, 3), label)
    return F.struct(label.alias("label"), label.isNotNull().alias("parse_ok"))


# Vectors: arrays of float, sums in double


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Squared L2."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """L2 normalised; a zero vector passes through. The norm is an array's element, so it is worked out once a vector."""
    n = norm(a)
    return F.zip_with(a, F.array_repeat(F.when(n > 0, n).otherwise(F.lit(1.0)), F.size(a)), lambda x, y: x.cast("double") / y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def scaled(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: x.cast("double") * F.lit(float(k)))


def fused(*parts: Column) -> Column:
    """Unit sum of unit parts; null if a part is null."""
    total = unit(parts[0])
    for p in parts[1:]:
        total = plus(total, unit(p))
    return unit(total)
