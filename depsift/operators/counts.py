"""Counting: marginals, support tables of one candidate, and all candidates at once.

The batched form is what a search runs, over a table of 64-bit hashes.  Mappers read
``CHUNK`` rows at a time as Arrow columns, number the values of each side once and count
the pairs of numbers of each candidate; what they hand on are counts.  So a row is never
copied for each candidate, and a value that fills a third of the table is one row a
chunk.  One contingency serves both directions of a pair.  At 10^9 different values the
chance that any two have the same hash is under 3 %.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depsift.operators.order import numbered
from depsift.settings import Settings

#: Rows that a mapper counts at once.
CHUNK = 1 << 18


def with_total(df: DataFrame, **totals: Column) -> DataFrame:
    """Adds aggregates over all rows to each row.  They are one row, so nothing needs to
    meet in one task; a window over the whole table would move all of it there."""
    return df.crossJoin(F.broadcast(df.agg(*(v.alias(k) for k, v in totals.items()))))


def marginal(df: DataFrame, column: str, *, valid: bool = False) -> DataFrame:
    """value, n, p of a column; with ``valid``, of its values that aren't null."""
    rows = df.where(F.col(column).isNotNull()) if valid else df
    counted = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return with_total(counted, __total=F.sum("n")).withColumn("p", F.col("n") / F.col("__total")).drop("__total")


def _chunks(most: int):
    """Joins Arrow batches to tables of at least ``most`` rows; the last may have fewer."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held)

    return run


def value_counts(table: DataFrame) -> DataFrame:
    """(at, v, k): the counts of each value of each 64-bit column, null among them, by the
    column's place."""
    chunks = _chunks(CHUNK)

    def run(batches):
        for chunk in chunks(batches):
            for at, column in enumerate(chunk.columns):
                found = pc.value_counts(column)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), at, np.int32)), found.field("values"), found.field("counts")], ["at", "v", "k"])

    return table.mapInArrow(run, "at int, v long, k long").groupBy("at", "v").agg(F.sum("k").alias("k"))


def marginal_stats(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, total, valid, vocabulary, entropy, top1 over the values that aren't null,
    for a table of hashed columns."""
    counted = value_counts(table.select(*columns))
    known = F.col("v").isNotNull()
    k = F.when(known, F.col("k"))
    stats = counted.groupBy("at").agg(
        F.sum("k").alias("total"), F.coalesce(F.sum(k), F.lit(0)).alias("valid"), F.count_if(known).alias("vocabulary"), F.max(k).alias("mx"), F.sum(k * F.log(k.cast("double"))).alias("kl")
    )
    return stats.select(
        F.get(F.array(*map(F.lit, columns)), F.col("at")).alias("column"), "total", "valid", "vocabulary",
        F.when(F.col("valid") > 0, F.log(F.col("valid").cast("double")) - F.col("kl") / F.col("valid")).otherwise(0.0).alias("entropy"), F.coalesce(F.col("mx") / F.col("valid"), F.lit(0.0)).alias("top1"),
    )


def pattern_stats(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., rhs, k) -> a row a pattern: n, eff, entropy, top1, non_null_ratio.  A
    pattern without any right side has entropy 0 and top1 0."""
    k = F.when(F.col("rhs").isNotNull(), F.col("k"))
    return (
        counted.groupBy(*by)
        .agg(F.sum("k").alias("n"), F.coalesce(F.sum(k), F.lit(0)).alias("eff"), F.max(k).alias("mx"), F.sum(k * F.log(k.cast("double"))).alias("kl"))
        .select(
            *by, "n", "eff",
            F.when(F.col("eff") > 0, F.greatest(F.lit(0.0), F.log(F.col("eff").cast("double")) - F.col("kl") / F.col("eff"))).otherwise(0.0).alias("entropy"),
            F.coalesce(F.col("mx") / F.col("eff"), F.lit(0.0)).alias("top1"),
            (F.col("eff") / F.col("n")).alias("non_null_ratio"),
        )
    )


def contingency(df: DataFrame, lhs: Sequence[str], rhs: str) -> DataFrame:
    """Counts of (lhs..., rhs) with no null on the left."""
    rows = df
    for c in lhs:
        rows = rows.where(F.col(c).isNotNull())
    return rows.groupBy(*lhs, F.col(rhs).alias("rhs")).agg(F.count(F.lit(1)).alias("k"))


def retained(s: Settings, *, high_card: bool = False) -> Column:
    """Whether a pattern counts: enough rows, enough valid ones, or pure; and few nulls."""
    floor = max(s.min_effective_support_count, s.high_card_min_effective_support_count) if high_card else s.min_effective_support_count
    pure = max(s.min_pure_support_count, s.high_card_min_effective_support_count) if high_card else s.min_pure_support_count
    ok = (F.col("n") >= s.min_support_count) | (F.col("eff") >= floor) | ((F.col("top1") >= s.min_row_purity) & (F.col("eff") >= pure))
    return ok & (F.col("non_null_ratio") >= s.min_non_null_ratio) if s.min_non_null_ratio > 0 else ok


def priority(s: Settings) -> Column:
    non_null = F.greatest(F.lit(1e-6), F.least(F.lit(1.0), F.col("non_null_ratio")))
    return F.pow(F.col("eff") + 1.0, F.lit(s.priority_effective_alpha)) * F.pow(non_null, F.lit(s.priority_non_null_beta))


def support(df: DataFrame, lhs: Sequence[str], rhs: str, s: Settings | None = None, *, high_card: bool = False) -> DataFrame:
    """The support table of one candidate: patterns that count, with priority, weight
    and empirical weight."""
    s = s or Settings()
    rows = pattern_stats(contingency(df, lhs, rhs), lhs).where(retained(s, high_card=high_card)).withColumn("priority", priority(s))
    if s.max_support_rows:
        rows = budget(rows, lhs, s)
    rows = with_total(rows, __total=F.sum("n"))
    rows = rows.withColumns({"weight": F.col("n") / F.col("__total"), "empirical_weight": F.col("n") / (F.col("n") + s.support_beta)}).drop("__total")
    if s.independence_weight > 0:
        rows = with_independence(df, rows, lhs, s)
    return rows


def with_independence(df: DataFrame, rows: DataFrame, lhs: Sequence[str], s: Settings) -> DataFrame:
    """Weights that mix in what independent columns would give a pattern."""
    total = df.count()
    product = F.lit(1.0)
    for c in lhs:
        p = df.groupBy(F.col(c).alias(f"__{c}")).agg((F.count(F.lit(1)) / total).alias(f"__p_{c}"))
        rows = rows.join(p, F.col(c) == F.col(f"__{c}"))
        product = product * F.col(f"__p_{c}")
    shrunk = F.col("n") / total + s.independence_weight * (1 - F.col("n") / (F.col("n") + s.support_beta)) * product
    rows = with_total(rows.withColumn("weight", shrunk), __total=F.sum("weight"))
    rows = rows.withColumn("weight", F.col("weight") / F.col("__total"))
    return rows.drop("__total", *(x for c in lhs for x in (f"__{c}", f"__p_{c}")))


def budget(rows: DataFrame, lhs: Sequence[str], s: Settings, by: Sequence[str] = ()) -> DataFrame:
    """At most ``max_support_rows`` patterns (of each value of ``by``): the head by priority,
    of the tail those at the middles of evenly spaced shares of its priority, then evenly
    spaced ones until it is full."""
    limit, head = s.max_support_rows, min(s.support_head_rows, s.max_support_rows)
    rest, by = limit - head, list(by)
    order = [F.desc("priority"), *lhs]
    # Priorities are powers of counts: their magnitude is a bucket that falls along the order.
    bucket = -F.floor(F.log2("priority") * 4)
    placed = numbered(rows, order, bucket, by=by).withColumnRenamed("__at", "__place")
    tail = F.col("__place") > head
    mass = F.when(tail, F.col("priority")).otherwise(0.0)
    placed = _with_totals(placed, by, __all=F.count(F.lit(1)), __mass=F.sum(mass))
    placed = numbered(placed, order, bucket, by=by, sums={"__run": mass}).drop("__at")

    def step(run):
        return F.floor(F.when(F.col("__mass") > 0, run / F.col("__mass")).otherwise(0.0) * rest + 0.5)

    placed = placed.withColumn("__hit", tail & (step(F.col("__run")) > step(F.col("__run") - mass)))
    free = (tail & ~F.col("__hit")).cast("long")
    placed = _with_totals(placed, by, __frees=F.sum(free), __hits=F.sum(F.col("__hit").cast("long")))
    placed = numbered(placed, order, bucket, by=by, sums={"__free": free}).drop("__at")
    want, at, last = F.lit(rest) - F.col("__hits"), F.col("__free") - 1, F.greatest(F.col("__frees") - 1, F.lit(1))
    # The first of want evenly spaced places that isn't below this one is this one.
    nearest = F.ceil(at * (want - 1) / last)
    spaced = (at == 0) | ((want > 1) & (nearest < want) & (F.floor(nearest * (F.col("__frees") - 1) / F.greatest(want - 1, F.lit(1))) == at))
    keep = (F.col("__all") <= limit) | ~tail | F.col("__hit") | ((free > 0) & (want > 0) & spaced)
    return placed.where(keep).drop("__place", "__all", "__mass", "__run", "__hit", "__free", "__frees", "__hits")


def _with_totals(df: DataFrame, by: Sequence[str], **totals: Column) -> DataFrame:
    if not by:
        return with_total(df, **totals)
    return df.join(df.groupBy(*by).agg(*(v.alias(k) for k, v in totals.items())), list(by))


def support_mass(table: DataFrame, rows: int) -> DataFrame:
    """patterns, retained_mass and effective_retained_mass of a support table."""
    return table.agg(F.count(F.lit(1)).alias("patterns"), (F.sum("n") / rows).alias("retained_mass"), (F.sum("eff") / rows).alias("effective_retained_mass"))


def support_probability(table: DataFrame, evidence: dict[str, str]) -> DataFrame:
    """The weight of one pattern, 0 if it isn't in the table.  Values are matched by
    column, in any order."""
    rows = table
    for c, v in evidence.items():
        rows = rows.where(F.col(c).cast("string") == F.lit(v))
    return rows.agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("probability"))


# --- all candidates at once ---------------------------------------------------


def key(columns: Sequence[str]) -> Column:
    """A 64-bit number for the values of some columns, null if one of them is."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return F.when(known, F.xxhash64(*columns))


def hashed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every column as one 64-bit number; null stays null."""
    return df.select(*(key([c]).alias(c) for c in columns))


def exact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``hashed``, but whole numbers stay as they are: they need less room."""
    whole = {"tinyint", "smallint", "int", "bigint"}
    kinds = dict(df.dtypes)
    return df.select(*((F.col(c).cast("long") if kinds[c] in whole else key([c])).alias(c) for c in columns))


def distinct_sketches(table: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]], per_job: int = 100) -> tuple[dict, dict]:
    """Approximate numbers of distinct values and pairs, from sketches that are merged in
    the mappers: nothing but sketches is shuffled.  Collected, a number each."""
    ones = table.agg(*(F.hll_sketch_estimate(F.hll_sketch_agg(c)).alias(c) for c in columns)).first().asDict()
    twos: dict[tuple[str, str], int] = {}
    for start in range(0, len(pairs), per_job):
        some = pairs[start : start + per_job]
        row = table.agg(*(F.hll_sketch_estimate(F.hll_sketch_agg(key(p))).alias(f"p{i}") for i, p in enumerate(some))).first()
        twos |= {p: row[f"p{i}"] for i, p in enumerate(some)}
    return ones, twos


def accuracy_bound(rows: int, patterns: float, pairs: float) -> float:
    """The most that the accuracy strength can be.  Each further right side of a pattern
    takes a row from its commonest one, so at most 1 - (pairs - patterns) / rows of the
    rows agree, and the strength is never above that share."""
    return 1.0 - max(0.0, pairs - patterns) / max(rows, 1)


def _pair_counts(table: DataFrame, sides: list[tuple[str, ...]], records: list[tuple[int, int, int]]) -> DataFrame:
    """(number, place of a, place of b) of each record -> cand, a, b, k with the keys of the
    two sides; the counts are those of chunks of rows."""
    chunks = _chunks(CHUNK)

    def run(batches):
        for chunk in chunks(batches):
            n, coded = chunk.num_rows, []
            for column in chunk.columns:
                found = pc.dictionary_encode(column, null_encoding="encode").combine_chunks()
                coded.append((found.indices.to_numpy().astype(np.int64), found.dictionary))
            for number, i, j in records:
                (x, left), (y, right) = coded[i], coded[j]
                both, width = x * len(right) + y, max(len(right), 1)
                if len(left) * width <= 4 * n:
                    k = np.bincount(both)
                    cells = np.flatnonzero(k)
                    k = k[cells]
                else:
                    found = pc.value_counts(pa.array(both))
                    cells, k = found.field("values").to_numpy(), found.field("counts").to_numpy()
                cand = np.full(len(cells), number, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cand), left.take(pa.array(cells // width)), right.take(pa.array(cells % width)), pa.array(k.astype(np.int64))], ["cand", "a", "b", "k"])

    keys = table.select(*((F.col(c[0]) if len(c) == 1 else key(c)).alias(f"s{i}") for i, c in enumerate(sides)))
    return keys.mapInArrow(run, "cand int, a long, b long, k long")


def batched_contingency(table: DataFrame, candidates: Sequence[tuple[int, Sequence[str], str]]) -> DataFrame:
    """(number, lhs columns, rhs) of each candidate -> cand, lhs, rhs, k over a table of
    hashed columns; rows with a null on the left are left out."""
    sides = sorted({tuple(lhs) for _, lhs, _ in candidates} | {(rhs,) for _, _, rhs in candidates})
    at = {side: i for i, side in enumerate(sides)}
    rows = _pair_counts(table, sides, [(n, at[tuple(lhs)], at[(rhs,)]) for n, lhs, rhs in candidates]).where("a IS NOT NULL")
    return rows.groupBy("cand", F.col("a").alias("lhs"), F.col("b").alias("rhs")).agg(F.sum("k").alias("k"))


def pair_contingency(table: DataFrame, pairs: Sequence[tuple[int, int, str, str]]) -> DataFrame:
    """(number of a -> b, number of b -> a, a, b) -> cand, lhs, rhs, k of both
    directions from one count.  A number below 0 leaves a direction out."""
    sides = sorted({(x,) for p in pairs for x in p[2:]})
    at = {side: i for i, side in enumerate(sides)}
    counted = _pair_counts(table, sides, [(n, at[(p[2],)], at[(p[3],)]) for n, p in enumerate(pairs)]).groupBy("cand", "a", "b").agg(F.sum("k").alias("k"))
    ways = F.array(*(F.struct(F.lit(p[0]).alias("forward"), F.lit(p[1]).alias("back")) for p in pairs))
    numbered = counted.withColumn("way", F.get(ways, F.col("cand")))
    both = F.array(F.struct(F.col("way.forward").alias("cand"), F.col("a").alias("lhs"), F.col("b").alias("rhs"), F.col("k")), F.struct(F.col("way.back").alias("cand"), F.col("b").alias("lhs"), F.col("a").alias("rhs"), F.col("k")))
    return numbered.select(F.inline(both)).where("cand >= 0 AND lhs IS NOT NULL")


def contingencies(table: DataFrame, wanted: Sequence[tuple[Sequence[str], str]]) -> DataFrame:
    """cand, lhs, rhs, k of all (lhs columns, rhs), numbered by their places; both
    directions of a pair of columns come from one count."""
    number = {(tuple(lhs), rhs): i for i, (lhs, rhs) in enumerate(wanted)}
    pairs = sorted({tuple(sorted((*lhs, rhs))) for lhs, rhs in number if len(lhs) == 1})
    parts = []
    if pairs:
        parts.append(pair_contingency(table, [(number.get(((a,), b), -1), number.get(((b,), a), -1), a, b) for a, b in pairs]))
    if compound := [(i, *w) for w, i in number.items() if len(w[0]) > 1]:
        parts.append(batched_contingency(table, compound))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def all_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return list(itertools.combinations(columns, 2))
