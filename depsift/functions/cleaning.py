"""Projections that clean source columns: all are built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without white space at either end (any white space, not only blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def to_number(c: Column) -> Column:
    """A double, or null for what isn't a number."""
    return c.try_cast("double")


def days_since_2000(c: Column, fmt: str | None = None) -> Column:
    """Days from 2000-01-01 to a date or a text that is one, null if it isn't."""
    return F.datediff(F.try_to_date(c, fmt) if fmt else c.try_cast("date"), F.lit("2000-01-01").cast("date"))


def currency(c: Column) -> Column:
    """The number of a text with dollar signs, commas and blanks: ``$350,00`` is 35000."""
    return F.regexp_replace(c, r"[$,\s]", "").try_cast("double")


def first_integer(c: Column) -> Column:
    """The first signed integer inside a text."""
    return F.regexp_extract(c, r"-?\d+", 0).try_cast("double")


def text_or_null(c: Column, nulls: tuple[str, ...] = ("", "nan", "none")) -> Column:
    """Null for texts that only say that nothing is there."""
    return F.when(F.lower(trimmed(c)).isin(*nulls), F.lit(None)).otherwise(trimmed(c))


def without_literals(c: Column, literals: tuple[str, ...]) -> Column:
    return F.when(c.isin(*literals), F.lit(None)).otherwise(c) if literals else c


def labelled(c: Column, positive: str, negative: str) -> Column:
    """1 and 0 for the two labels of a target, null for others."""
    return F.when(trimmed(c) == positive, 1).when(trimmed(c) == negative, 0)


_FALSE, _TRUE = ("f", "false", "0"), ("t", "true", "1")


def is_boolean(df: DataFrame, column: str) -> bool:
    """Whether all values of a text column are words for true and false."""
    word = F.lower(trimmed(F.col(column).cast("string")))
    seen = df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_if(~word.isin(*_FALSE, *_TRUE)).alias("other")).first()
    return seen["n"] > 0 and seen["other"] == 0


def boolean(c: Column) -> Column:
    word = F.lower(trimmed(c.cast("string")))
    return F.when(word.isin(*_FALSE), 0).when(word.isin(*_TRUE), 1)


def drop_sparse_rows(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Rows with a value in at least ``share`` of the columns."""
    return df.na.drop(thresh=math.ceil(share * len(df.columns)))


def zscore(df: DataFrame, columns: list[str], log: bool = False) -> DataFrame:
    """Standardized copies (mean 0, deviation 1) of numeric columns, of log1p if asked;
    a constant column becomes 0."""
    source = {c: F.log1p(F.col(c).cast("double")) if log else F.col(c).cast("double") for c in columns}
    stats = df.agg(*(f(v).alias(f"{n}_{c}") for c, v in source.items() for n, f in (("mean", F.mean), ("std", F.stddev_pop)))).first()
    return df.withColumns({c: (v - (stats[f"mean_{c}"] or 0.0)) / (stats[f"std_{c}"] or 1.0) for c, v in source.items()})


def standardized_interval(low: float, high: float, mean: float, deviation: float) -> tuple[float, float]:
    """A raw interval on the scale of ``zscore``."""
    return (low - mean) / (deviation or 1.0), (high - mean) / (deviation or 1.0)
