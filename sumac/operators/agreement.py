"""Agreement of labels and of system rankings: confusion, kappa, tau, rho, fits, fuzziness, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

GRADES = (0, 1, 2, 3)


def paired(human: DataFrame, judge: DataFrame, lossless: bool = False) -> DataFrame:
    """human (qid, doc_id, rel) with the judge's label; lossless makes misses and repeats an error."""
    h, j = human.select("qid", "doc_id", F.col("rel").alias("human")), judge.select("qid", "doc_id", F.col("rel").alias("judge"))
    out = h.join(j, ["qid", "doc_id"])
    if lossless:
        lost = h.join(j, ["qid", "doc_id"], "left_anti").agg(F.count(F.lit(1)).alias("n"))
        twice = j.groupBy("qid", "doc_id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("n"))
        n = lost.unionByName(twice).agg(F.sum("n").alias("n"))
        out = out.crossJoin(F.broadcast(n)).filter(F.assert_true(F.col("n") == 0, F.lit("pairs are missing or repeated")).isNull()).drop("n")
    return out


def confusion(pairs: DataFrame, grades: tuple[int, ...] = GRADES) -> DataFrame:
    """human, judge, n with zero cells kept."""
    g = pairs.sparkSession.createDataFrame([(a, b) for a in grades for b in grades], "human int, judge int")
    n = pairs.groupBy("human", "judge").agg(F.count(F.lit(1)).alias("n"))
    return g.join(n, ["human", "judge"], "left").select("human", "judge", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def kappa(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, observed agreement, Cohen's kappa and its linearly weighted form over grades and over two classes."""
    by = by or []
    p = pairs.filter("human IS NOT NULL AND judge IS NOT NULL")
    top = float(len(GRADES) - 1)

    def marginal(h: Column, j: Column, k: int, name: str) -> list[Column]:
        return [F.count_if(h == g).alias(f"{name}h{g}") for g in range(k)] + [F.count_if(j == g).alias(f"{name}j{g}") for g in range(k)]

    b = lambda c: (F.col(c) >= 2).cast("int")
    a = p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("human") == F.col("judge")).alias("same"),
        F.count_if(b("human") == b("judge")).alias("same2"),
        F.sum(F.abs(F.col("human") - F.col("judge")) / top).alias("off"),
        *marginal(F.col("human"), F.col("judge"), 4, "g"),
        *marginal(b("human"), b("judge"), 2, "b"),
    )
    n = F.when(F.col("n") > 0, F.col("n").cast("double"))
    chance = sum((F.col(f"gh{g}") * F.col(f"gj{g}") for g in GRADES), F.lit(0)) / (n * n)
    chance2 = sum((F.col(f"bh{g}") * F.col(f"bj{g}") for g in (0, 1)), F.lit(0)) / (n * n)
    expected = sum((F.col(f"gh{x}") * F.col(f"gj{y}") * F.lit(abs(x - y) / top) for x in GRADES for y in GRADES), F.lit(0.0)) / (n * n)
    k = lambda po, pe: F.round(F.when(pe < 1, (po - pe) / (F.lit(1.0) - pe)).when(pe.isNotNull(), F.lit(1.0)), 6)
    return a.select(
        *by,
        "n",
        F.round(F.col("same") / n, 6).alias("agree"),
        k(F.col("same") / n, chance).alias("kappa"),
        F.round(F.when(expected > 0, F.lit(1.0) - (F.col("off") / n) / expected).when(expected.isNotNull(), F.lit(1.0)), 6).alias("kappa_linear"),
        F.round(F.col("same2") / n, 6).alias("agree_binary"),
        k(F.col("same2") / n, chance2).alias("kappa_binary"),
    )


def segments(pairs: DataFrame, by: str) -> DataFrame:
    """Agreement for each value of by, unknown where it is empty."""
    key = F.when(F.trim(F.coalesce(F.col(by), F.lit(""))) == "", F.lit("unknown")).otherwise(F.col(by))
    return kappa(pairs.withColumn("segment", key), ["segment"])


def system_pairs(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All pairs of systems (system, x, y); systems are runs, so few."""
    by = by or []
    a = scores.select(*by, F.col("system").alias("s"), F.col("x").alias("xs"), F.col("y").alias("ys"))
    b = scores.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("system").alias("t"), F.col("x").alias("xt"), F.col("y").alias("yt"))
    on = F.col("s") < F.col("t")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(b, on).drop(*[f"_{c}" for c in by])


def kendall(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_pairs, tau_b (corrected for ties) and tau = (C - D) / (C + D)."""
    by = by or []
    dx, dy = F.signum(F.col("xs") - F.col("xt")), F.signum(F.col("ys") - F.col("yt"))
    c = system_pairs(scores, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(dx * dy > 0).alias("c"), F.count_if(dx * dy < 0).alias("d"), F.count_if(dx != 0).alias("nx"), F.count_if(dy != 0).alias("ny"))
    diff = (F.col("c") - F.col("d")).cast("double")
    return c.select(*by, "n_pairs", F.round(F.try_divide(diff, F.sqrt(F.col("nx").cast("double") * F.col("ny"))), 6).alias("tau_b"), F.round(F.try_divide(diff, (F.col("c") + F.col("d")).cast("double")), 6).alias("tau"))


def average_rank(c: str, by: list[str]) -> Column:
    """Rank with ties at their mean."""
    w, t = Window.partitionBy(*by).orderBy(c), Window.partitionBy(*by, c)
    return F.rank().over(w) + (F.count(F.lit(1)).over(t) - 1) / F.lit(2.0)


def spearman(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Correlation of average ranks."""
    by = by or []
    s = scores.withColumn("_all", F.lit(1)) if not by else scores
    keys = by or ["_all"]
    r = s.select(*keys, average_rank("x", keys).alias("rx"), average_rank("y", keys).alias("ry"))
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho")).drop("_all")


def fit(scores: DataFrame) -> DataFrame:
    """Least squares of y on x."""
    return scores.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))


def fuzziness(scores: DataFrame, steps: int = 11, least: float = 0.05) -> DataFrame:
    """Of pairs whose judge scores (y) differ by more than f, the share that human scores (x) order otherwise; adopted marks the smallest f below least."""
    f = scores.sparkSession.range(steps).select((F.col("id") / 100.0).alias("f"))
    p = system_pairs(scores).crossJoin(F.broadcast(f)).filter(F.abs(F.col("ys") - F.col("yt")) > F.col("f") + 1e-9)  # a fixed table of steps
    e = p.groupBy("f").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if((F.col("xs") - F.col("xt")) * (F.col("ys") - F.col("yt")) < 0).alias("n_wrong"))
    e = e.withColumn("error", F.round(F.col("n_wrong") / F.col("n_pairs"), 6))
    low = e.filter(F.col("error") < least).agg(F.min("f").alias("best"))
    return e.crossJoin(F.broadcast(low)).select("f", "n_pairs", "n_wrong", "error", F.coalesce(F.col("f") == F.col("best"), F.lit(False)).alias("adopted"))


def verdict(tau: Column) -> Column:
    return F.when(tau.isNull(), F.lit("insufficient")).when(tau >= 0.7, F.lit("validated")).when(tau >= 0.4, F.lit("marginal")).otherwise(F.lit("rejected"))
