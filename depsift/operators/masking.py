"""What training a conditional model needs: masks, weights, objectives, losses.

A network is not part of this package; these operators feed any model that fills in
masked columns, and measure the estimators that stand in for one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsift.operators.counts import marginal, with_total
from depsift.operators.estimate import conditional


def _unit(*parts) -> Column:
    """A number from 0 to 1 that depends on the parts only."""
    text = F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def observed(df: DataFrame, key: Column, columns: Sequence[str], ratios: Sequence[float] = (0.2, 0.5, 0.8), seed: int = 0) -> DataFrame:
    """Adds ``observed``: the columns that stay visible in each row.  A row has one of the
    ratios; at least one column is visible and at least one is not.  Columns are ranked
    by a hash, so the same row, columns and seed give the same mask everywhere."""
    share = F.element_at(F.array(*map(F.lit, ratios)), (F.floor(_unit(key, "ratio", seed) * len(ratios)) + 1).cast("int"))
    visible = F.greatest(F.lit(1), F.least(F.lit(len(columns) - 1), F.round(share * len(columns)).cast("int")))
    ranked = F.array_sort(F.array(*(F.struct(_unit(key, c, seed).alias("u"), F.lit(c).alias("c")) for c in columns)))
    names = F.transform(ranked, lambda x: x["c"])
    return df.withColumn("observed", F.array_sort(F.slice(names, F.lit(1), visible)))


def masked(df: DataFrame, columns: Sequence[str], token: str = "[MASK]") -> DataFrame:
    """Columns that a row does not observe become the mask token."""
    return df.withColumns({c: F.when(F.array_contains("observed", c), F.col(c).cast("string")).otherwise(F.lit(token)) for c in columns})


def class_weights(train: DataFrame, column: str, gamma: float = 0.5) -> DataFrame:
    """value, weight: (1 / (n + 1)) ^ gamma over the mean of that."""
    raw = marginal(train, column, valid=True).withColumn("w", F.pow(1 / (F.col("n") + 1), F.lit(gamma)))
    return with_total(raw, __mean=F.avg("w")).select("value", (F.col("w") / F.col("__mean")).alias("weight"))


def objectives(columns: Sequence[dict], count: int, most: int = 2, seed: int = 0) -> list[tuple[tuple[str, ...], str]]:
    """Pairs of left and right sides to train on: right sides with weight
    1 + sqrt(unique ratio) / 2, left sides of 1 to ``most`` columns of which 70 % are drawn
    by ``identifier`` strength.  ``columns``: name, unique_ratio, identifier."""
    import random

    r = random.Random(seed)
    out = []
    for _ in range(count):
        rhs = r.choices(columns, [1 + 0.5 * c["unique_ratio"] ** 0.5 for c in columns])[0]
        rest = [c for c in columns if c is not rhs]
        lhs: list[str] = []
        for _ in range(r.randint(1, min(most, len(rest)))):
            left = [c for c in rest if c["name"] not in lhs]
            weights = [c["identifier"] + 1e-6 for c in left] if r.random() < 0.7 else None
            lhs.append(r.choices(left, weights)[0]["name"])
        out.append((tuple(sorted(lhs)), rhs["name"]))
    return out


def validation_loss(train: DataFrame, val: DataFrame, lhs: Sequence[str], rhs: str, *, strength: float = 1.0, weighted: bool = False) -> DataFrame:
    """examples and mean negative log-likelihood of right sides on validation rows: known
    patterns by the smoothed conditional, unseen values and patterns by the marginal's
    share; with ``weighted``, by class weights."""
    m = marginal(train, rhs, valid=True).select(F.col("value").alias(rhs), F.col("p").alias("m"))
    d = conditional(train, lhs, rhs, strength=strength).select(*lhs, F.col("value").alias(rhs), "p")
    n = train.where(F.col(rhs).isNotNull()).groupBy(*lhs).agg(F.count(F.lit(1)).alias("n"))
    rows = val.where(F.col(rhs).isNotNull()).select(*lhs, rhs).join(m, rhs).join(n, list(lhs), "left").join(d, [*lhs, rhs], "left")
    p = F.coalesce("p", strength * F.col("m") / (F.coalesce("n", F.lit(0)) + strength))
    if weighted:
        rows = rows.join(class_weights(train, rhs).select(F.col("value").alias(rhs), "weight"), rhs)
    w = F.col("weight") if weighted else F.lit(1.0)
    return rows.agg(F.count(F.lit(1)).alias("examples"), (F.sum(-F.log(p) * w) / F.sum(w)).alias("loss"))
