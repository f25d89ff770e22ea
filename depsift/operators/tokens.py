"""Splits, vocabularies, buckets and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from depsift.functions.canonical import canonical_integer, canonical_text, fold_forms
from depsift.operators.counts import with_total
from depsift.operators.order import numbered, place_in

#: Ids below this stand for null, unknown, masked and rare.
RESERVED = 4


def row_key(*columns: str) -> Column:
    return F.concat_ws("|", *(F.col(c).cast("string") for c in columns))


def split_of(key: Column) -> Column:
    """train, val or test, about 80 to 10 to 10, by a hash of the row's key: the same on
    every run, for every order of rows."""
    bucket = F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(10))
    return F.when(bucket < 8, "train").when(bucket == 8, "val").otherwise("test")


def vocabulary(train: DataFrame, column: str, min_count: int = 1) -> DataFrame:
    """token, n, token_id of a column's tokens, commonest first, ties by the token."""
    counted = train.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("token")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    # Counts, and beginnings of tokens where many have the same count, cut the order into buckets.
    bucket = F.struct(-F.col("n"), F.when(F.col("n") <= 64, F.left("token", F.lit(2))).otherwise(""))
    return numbered(counted, [F.desc("n"), F.col("token")], bucket).select("token", "n", (F.col("__at") + RESERVED - 1).cast("long").alias("token_id"))


def quantiles(df: DataFrame, columns: dict[str, Column], bins: int = 32) -> dict[str, list[float]]:
    """For each named column of numbers, its distinct quantiles at i / bins by linear
    interpolation; a single value v gives [v, v + 1], no value [0, 1].

    Values are counted and ordered within buckets between approximate quantiles; where
    a bucket's rows are known to hold a wanted rank, the exact value is looked up.
    """
    if not columns:
        return {}
    names = list(columns)
    numbers = df.select(*(columns[c].cast("double").alias(f"c{i}") for i, c in enumerate(names)))
    shares = F.array(*(F.lit(i / 256) for i in range(1, 256)))
    cells = F.inline(F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"c{i}").alias("v")) for i in range(len(names)))))
    counted = numbers.select(cells).where("v IS NOT NULL").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    bounds = numbers.agg(F.array(*(F.percentile_approx(f"c{i}", shares, F.lit(2000)) for i in range(len(names)))).alias("__bounds"))
    rows = counted.crossJoin(F.broadcast(bounds))  # one row
    totals = rows.groupBy("c").agg(F.sum("n").alias("total"))
    placed = numbered(rows, [F.col("v")], place_in(F.col("v"), F.get("__bounds", F.col("c"))), by=["c"], sums={"__run": F.col("n")}).join(totals, "c")
    wanted = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: _ranks(i, bins, F.col("total"))))
    hit = F.filter(wanted, lambda t: (t["rank"] < F.col("__run")) & (t["rank"] >= F.col("__run") - F.col("n")))
    found: dict[str, dict] = {c: {} for c in names}
    for r in placed.select("c", "v", F.inline(hit)).collect():  # 2 * (bins + 1) rows a column
        found[names[r["c"]]][r["i"], r["above"]] = (r["v"], r["part"])
    out = {}
    for c, at in found.items():
        edges = sorted({low + (at[i, True][0] - low) * part if part else low for (i, above), (low, part) in at.items() if not above})
        out[c] = [0.0, 1.0] if not edges else edges if len(edges) > 1 else [edges[0], edges[0] + 1]
    return out


def _ranks(i: Column, bins: int, total: Column) -> Column:
    """The ranks around place i / bins of ``total`` rows, and the part between them."""
    place = i * (total - 1) / bins
    low = F.floor(place)
    return F.array(*(F.struct(i.alias("i"), F.lit(above).alias("above"), rank.alias("rank"), (place - low).alias("part")) for above, rank in ((False, low), (True, F.ceil(place)))))


def quantile_edges(train: DataFrame, column: str, bins: int = 32) -> list[float]:
    """``quantiles`` of one column."""
    return quantiles(train, {column: F.col(column)}, bins)[column]


def bucket_of(value: Column, edges: list[float]) -> Column:
    """Number of inner edges up to a value; values outside fall in the outer buckets."""
    inner = F.array(*(F.lit(float(e)) for e in edges[1:-1])) if len(edges) > 2 else F.array().cast("array<double>")
    number = value.cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), F.size(F.filter(inner, lambda e: e <= number)))


def label_codes(df: DataFrame, column: str, order: Column) -> DataFrame:
    """value, code of the trimmed values of a text column in the order in which they first
    come by ``order``; codes start at 0."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(F.trim(column).alias("value")).agg(F.min(order).alias("__first"))
    if isinstance(firsts.schema["__first"].dataType, StringType):
        bucket = F.left("__first", F.lit(3))
    else:
        shares = F.array(*(F.lit(i / 256) for i in range(1, 256)))
        firsts = with_total(firsts, __bounds=F.percentile_approx("__first", shares, F.lit(2000)))
        bucket = place_in(F.col("__first"), F.col("__bounds"))
    return numbered(firsts, [F.col("__first"), F.col("value")], bucket).select("value", (F.col("__at") - 1).cast("long").alias("code"))


def encode(df: DataFrame, column: str, words: DataFrame, *, rare: bool = False, out: str | None = None) -> DataFrame:
    """Adds the id of a column's token: 0 for null, 3 for tokens that are not in the
    vocabulary if rare ones were cut, else 1."""
    lookup = words.select(F.col("token").alias("__token"), F.col("token_id").alias("__id"))
    joined = df.join(lookup, F.col(column).cast("string") == F.col("__token"), "left")
    number = F.when(F.col(column).isNull(), F.lit(0)).otherwise(F.coalesce("__id", F.lit(3 if rare else 1))).cast("long")
    return joined.withColumn(out or f"{column}_id", number).drop("__token", "__id")


def decode(df: DataFrame, column: str, words: DataFrame, out: str = "token") -> DataFrame:
    names = words.select(F.col("token_id").alias("__id"), F.col("token").alias("__token"))
    reserved = F.element_at(F.array(*map(F.lit, ("[NULL]", "[UNK]", "[MASK]", "[RARE]"))), (F.col(column) + 1).cast("int"))
    joined = df.join(names, F.col(column) == F.col("__id"), "left")
    return joined.withColumn(out, F.when(F.col(column) < RESERVED, reserved).otherwise(F.col("__token"))).drop("__id", "__token")


def tokens(df: DataFrame, kinds: dict[str, str], *, bins: int = 32, null_literals: tuple[str, ...] = (), edges: dict[str, list[float]] | None = None) -> DataFrame:
    """Canonical text for every column of ``kinds`` (categorical, discrete_numeric or
    continuous_bucket); null stands for all that is missing or unreadable.  Bucket edges
    are taken from ``edges`` or measured on ``df``, all columns in one pass."""
    edges = dict(edges or {})
    edges |= quantiles(df, {c: _number(df, c) for c, k in kinds.items() if k == "continuous_bucket" and c not in edges}, bins)
    texts = [c for c, k in kinds.items() if k == "categorical" and isinstance(df.schema[c].dataType, StringType)]
    df = fold_forms(df, *texts)
    out = {}
    for c, kind in kinds.items():
        if kind == "categorical":
            plain = df.schema[c].dataType.simpleString() != "string"
            out[c] = F.col(c).cast("string") if plain else canonical_text(F.col(c), null_literals)
        elif kind == "discrete_numeric":
            out[c] = canonical_integer(_number(df, c))
        else:
            out[c] = F.format_string("bin_%02d", bucket_of(_number(df, c), edges[c]))
            out[c] = F.when(bucket_of(_number(df, c), edges[c]).isNotNull(), out[c])
    return df.select(*(c for c in df.columns if c not in kinds), *(v.alias(c) for c, v in out.items()))


def _number(df: DataFrame, column: str) -> Column:
    """Numbers as doubles, dates as days since 2000-01-01."""
    kind = df.schema[column].dataType.simpleString()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.datediff(F.col(column).cast("date"), F.lit("2000-01-01").cast("date")).cast("double")
    return F.col(column).try_cast("double") if kind == "string" else F.col(column).cast("double")
