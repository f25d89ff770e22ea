"""Numbers and running sums along an order, without one task for all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: Sequence[Column], bucket: Column, *, by: Sequence[str] = (), sums: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``__at`` (1, 2, ... along ``order``) and running sums that include the row.

    ``bucket`` must rise along the order.  Rows are ordered within their buckets only;
    what comes before a bucket is found on the buckets' totals, a short row each.  With
    ``by``, each of its values has an order of its own.
    """
    sums, by = sums or {}, list(by)
    rows = df.withColumn("__bucket", bucket)
    within = Window.partitionBy(*by, "__bucket").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({"__at": F.row_number().over(within), **{k: F.sum(v).over(upto) for k, v in sums.items()}})
    totals = rows.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"), *(F.sum(v).alias(k) for k, v in sums.items()))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = totals.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), zero).alias("__n0"), *(F.coalesce(F.sum(k).over(before), zero).alias(f"__0{k}") for k in sums))
    same = F.col("__bucket").eqNullSafe(F.col("__b"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = local.join(offsets, same).withColumns({"__at": F.col("__at") + F.col("__n0"), **{k: F.col(k) + F.col(f"__0{k}") for k in sums}})
    return joined.drop("__bucket", "__b", "__n0", *(f"__{c}" for c in by), *(f"__0{k}" for k in sums))


def place_in(value: Column, bounds: Column) -> Column:
    """How many of the bounds are below a value: a bucket that rises with it."""
    return F.size(F.filter(bounds, lambda b: b < value))
