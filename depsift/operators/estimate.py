"""Conditional distributions P(rhs | lhs): estimators, queries, calibration.

``empirical`` is what was counted.  ``backoff`` stands for a model that must
generalize: each pattern is judged without one of its own rows and leans on the
marginal, so a pattern that was seen once says nothing, however pure it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depsift.operators.counts import contingency, marginal


def conditional(train: DataFrame, lhs: Sequence[str], rhs: str, *, strength: float = 0.0, temperature: float = 1.0) -> DataFrame:
    """lhs..., value, p for each value seen with each pattern.  With a strength, the
    counts lean on the marginal: p = (k + strength * m) / (n + strength), and what a
    pattern never showed keeps the rest of the mass.  With a temperature, the seen
    values' p ^ (1 / T) are renormalized."""
    seen = contingency(train, lhs, rhs).where("rhs IS NOT NULL")
    by = Window.partitionBy(*lhs)
    m = marginal(train, rhs, valid=True).select(F.col("value").alias("rhs"), F.col("p").alias("m"))
    rows = seen.join(m, "rhs").withColumn("n", F.sum("k").over(by))
    rows = rows.withColumn("p", (F.col("k") + strength * F.col("m")) / (F.col("n") + strength))
    if temperature != 1.0:
        rows = rows.withColumn("p", F.pow(F.col("p"), F.lit(1.0 / temperature)))
        rows = rows.withColumn("p", F.col("p") / F.sum("p").over(by))
    return rows.select(*lhs, F.col("rhs").alias("value"), "k", "p")


def evidence_patterns(evidence: DataFrame, table: DataFrame, lhs: Sequence[str]) -> DataFrame:
    """The rows of ``table`` for each row of ``evidence`` (values, in columns of lhs)."""
    return evidence.join(table, list(lhs), "left")


def summary(distribution: DataFrame, lhs: Sequence[str]) -> DataFrame:
    """top1 and entropy of each pattern's distribution."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1.0), F.col("p")))
    return distribution.groupBy(*lhs).agg(F.max("p").alias("top1"), F.sum(-p * F.log(p)).alias("entropy"))


def soft_contingency(train: DataFrame, lhs: Sequence[str], rhs: str, *, top: int = 3, most: int = 128, beta: float = 12.0) -> DataFrame:
    """The ``most`` commonest patterns with their ``top`` right sides: rank, value, p, the
    share of rows p_lhs and the empirical weight."""
    rows = conditional(train, lhs, rhs)
    by = Window.partitionBy(*lhs)
    ranked = rows.withColumns({"n": F.sum("k").over(by), "rank": F.row_number().over(by.orderBy(F.desc("p"), "value"))}).where(F.col("rank") <= top)
    heads = ranked.where("rank = 1").orderBy(F.desc("n"), *lhs).limit(most).select(*lhs, (F.col("n") / (F.col("n") + beta)).alias("empirical_weight"), (F.col("n") / train.count()).alias("p_lhs"))
    return ranked.join(heads, list(lhs)).select(*lhs, F.col("rank").cast("long").alias("rank"), "value", "p", "p_lhs", "empirical_weight")


def brier_and_ece(train: DataFrame, val: DataFrame, lhs: Sequence[str], rhs: str, *, bins: int = 15, strength: float = 0.0, temperature: float = 1.0) -> DataFrame:
    """Brier score and expected calibration error of the top value over validation rows
    with a known pattern and a right side."""
    d = conditional(train, lhs, rhs, strength=strength, temperature=temperature)
    tops = d.groupBy(*lhs).agg(F.max(F.struct("p", F.col("value").alias("v"))).alias("t"), F.sum(F.col("p") * F.col("p")).alias("sq"))
    own = d.select(*lhs, F.col("value").alias(rhs), F.col("p").alias("own"))
    rows = val.where(F.col(rhs).isNotNull()).join(tops, list(lhs)).join(own, [*lhs, rhs], "left")
    rows = rows.select(
        (F.col("sq") - 2 * F.coalesce("own", F.lit(0.0)) + 1).alias("brier"), F.col("t.p").alias("confidence"), (F.col("t.v") == F.col(rhs)).cast("double").alias("right"),
    )
    bucket = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    binned = rows.groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("brier").alias("b"), F.avg("confidence").alias("c"), F.avg("right").alias("r"))
    return binned.agg(F.sum("n").alias("examples"), (F.sum("b") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("c") - F.col("r"))) / F.sum("n")).alias("ece"))


def fit_temperature(train: DataFrame, val: DataFrame, lhs: Sequence[str], rhs: str, *, strength: float = 1.0, grid: Sequence[float] = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)) -> float:
    """The temperature of a grid with the least negative log-likelihood on all validation
    rows with a known pattern and a right side; equal rows are counted first."""
    d = conditional(train, lhs, rhs, strength=strength)
    masses = d.groupBy(*lhs).agg(*(F.sum(F.pow("p", F.lit(1.0 / t))).alias(f"__mass{i}") for i, t in enumerate(grid)))
    own = d.select(*lhs, F.col("value").alias(rhs), F.col("p").alias("__own"))
    counted = val.where(F.col(rhs).isNotNull()).groupBy(*lhs, rhs).agg(F.count(F.lit(1)).alias("__times"))
    rows = counted.join(masses, list(lhs)).join(own, [*lhs, rhs], "left")

    def loss(i: int, t: float):
        q = F.coalesce(F.pow("__own", F.lit(1.0 / t)), F.lit(0.0)) / F.col(f"__mass{i}")
        return F.sum(-F.log(F.greatest(q, F.lit(1e-12))) * F.col("__times"))

    losses = rows.agg(*(loss(i, t).alias(f"__loss{i}") for i, t in enumerate(grid))).first()
    return 1.0 if losses[0] is None else float(min(zip(losses, grid, strict=True))[1])


def holdout(train: DataFrame, val: DataFrame, lhs: Sequence[str], rhs: str) -> DataFrame:
    """accuracy, coverage, examples of the majority value of each pattern on validation
    rows; ties go to the value that is commoner overall, then to the smaller one."""
    overall = marginal(train, rhs, valid=True).select(F.col("value").alias("rhs"), F.col("n").alias("overall"))
    rank = F.row_number().over(Window.partitionBy(*lhs).orderBy(F.desc("k"), F.desc("overall"), "rhs"))
    majority = contingency(train, lhs, rhs).where("rhs IS NOT NULL").join(overall, "rhs").withColumn("r", rank).where("r = 1").select(*lhs, F.col("rhs").alias("__majority"))
    known = F.col(rhs).isNotNull()
    for c in lhs:
        known = known & F.col(c).isNotNull()
    rows = val.where(known).join(majority, list(lhs), "left")
    hit = F.col("__majority").isNotNull()
    return rows.agg(
        F.coalesce(F.sum((F.col("__majority") == F.col(rhs)).cast("double")) / F.nullif(F.count_if(hit), F.lit(0)), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.count_if(hit) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("coverage"),
        F.count_if(hit).alias("examples"),
    )
