"""Canonical tokens: what counts as the same value of a column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsift.functions.cleaning import trimmed


def canonical_text(c: Column, null_literals: tuple[str, ...] = ()) -> Column:
    """Trimmed, lower-cased, backticks as apostrophes, white space runs as one blank;
    empty texts and the given literals are null.  Compatibility forms are folded by
    ``fold_forms`` first, where there are any."""
    base = F.when(c.isin(*null_literals), F.lit(None)).otherwise(c) if null_literals else c
    lowered = F.lower(base.cast("string"))
    # Most values have nothing to fold: one look is cheaper than three replacements.
    folded = F.nullif(F.regexp_replace(F.translate(trimmed(lowered), "`", "'"), r"(?U)\s+", " "), F.lit(""))
    return F.when(lowered.rlike(r"(?U)[\s`]"), folded).otherwise(F.nullif(lowered, F.lit("")))


def canonical_integer(c: Column) -> Column:
    """The text of the number cut off towards zero, null for what is no number."""
    number = c.try_cast("double")
    return F.when(F.isnan(number), F.lit(None)).otherwise(number).try_cast("bigint").cast("string")


def fold_forms(df: DataFrame, *columns: str) -> DataFrame:
    """NFKC forms of text columns.  One look tells which columns hold more than plain
    ASCII; of these, Python sees the distinct values that do.  Without any, the frame is
    returned as it is."""
    if not columns:
        return df
    odd = {c: ~F.col(c).rlike(r"^[\x00-\x7F]*$") for c in columns}
    found = df.agg(*(F.max(v).alias(c) for c, v in odd.items())).first()

    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFKC", v))

    for c in columns:
        if found[c]:
            folded = df.where(odd[c]).select(F.col(c).alias("__raw")).distinct().select("__raw", nfkc("__raw").alias("__folded"))
            joined = df.join(folded, F.col(c) == F.col("__raw"), "left")
            df = joined.withColumn(c, F.coalesce("__folded", c)).drop("__raw", "__folded")
    return df
