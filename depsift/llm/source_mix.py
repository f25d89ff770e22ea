"""Mixing sources to target weights with hash-threshold histograms (op 1).

Each document has a fixed place on a line: the first 60 bits of the MD5 of its
doc_id.  A source takes the documents up to some place on that line, so a larger
budget takes all that a smaller one takes.  The place is found without sorting
documents: sum the words by source and by the top 12 bits of the place, find the
bucket in which the running sum passes the budget, and look at the next bits in
that bucket alone.  The last look is at single places.  A budget above the size of
the source takes every document once and finds the place for the second copies.

Sizes: the sums have at most 4,096 buckets a source and are aggregated before the
shuffle, so a source with a third of all rows costs no more than another.  The
table of sources is written and read back; Spark broadcasts it only below
``spark.sql.autoBroadcastJoinThreshold``.  The shares are found with windows over
that table, which has one row a source.

Defined cases: a null text has no words; a text of any length is counted whole; null is
a source of its own, after all others; a null doc_id stands where an empty text does; a
source without words has the target 0; an empty table gives an empty one.  Rows with the
same doc_id, repeated rows among them, stand at one place and are taken together.
Documents stay whole, so a source misses its target by half of the document at the
threshold at most.  Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depsift.llm.shared import keep, word_count

#: Bits of the place that each look leaves for the next.
LOOKS = (48, 36, 24, 0)


def place(id_col: str):
    """60 bits of MD5 as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), share=(3, 2), most=2) -> DataFrame:
    """(__source, __size) -> the same with ``__target``.

    The weights repeat along the order of the sources.  With budget B, each source
    gets min(most * size, weight * x), where x makes the sum B: sources are taken
    in the order in which they fill up, and the first that does not fill up, given
    that all before it do, fixes x.  ``share`` is B over the sum of sizes, as a
    fraction, so that all but the last division is in whole numbers.
    """
    up, down = share
    all_rows, order = Window.partitionBy(), Window.orderBy(F.col("__source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long")
    fill = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("__source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest_num = F.lit(up).cast("long") * F.col("__total") - F.lit(down) * F.coalesce(F.sum("__cap").over(before), F.lit(0))
    return (
        sizes.withColumn("__w", weight)
        .withColumn("__cap", F.lit(most).cast("long") * F.col("__size"))
        .withColumn("__total", F.sum("__size").over(all_rows))
        .withColumn("__num", rest_num)
        .withColumn("__den", F.lit(down).cast("long") * F.sum("__w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        # Sizes times sums of weights may be above 64 bits.
        .withColumn("__full", F.col("__cap").cast("decimal(20,0)") * F.col("__den").cast("decimal(18,0)") <= F.col("__w").cast("decimal(18,0)") * F.col("__num").cast("decimal(20,0)"))
        .withColumn("__open", F.min(F.when(~F.col("__full"), F.struct(F.col("__cap") / F.col("__w"), F.col("__num").alias("n"), F.col("__den").alias("d")))).over(all_rows))
        .select("__source", "__size", F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise((F.col("__w") * F.col("__open.n")).cast("double") / F.col("__open.d")).alias("__target"))
    )


def thresholds(sized: DataFrame, **options) -> DataFrame:
    """(__place, __source, __size) of all documents -> a row a source: size, target,
    ``__base`` whole copies and the place ``__cut`` up to which there is one more."""
    sources = targets(sized.groupBy("__source").agg(F.sum("__size").alias("__size")), **options)
    full = F.col("__target") >= F.col("__size")
    state = keep(
        sources.select(
            F.col("__source").alias("__s"), "__size", "__target", full.cast("long").alias("__base"),
            (F.col("__target") - F.when(full, F.col("__size")).otherwise(0)).alias("__need"),
            F.lit(0).cast("long").alias("__done"), F.lit(0).cast("long").alias("__at"), F.lit(0).cast("long").alias("__sum"),
        ),
        "sources",
    )
    above = 60
    for bits in LOOKS:
        inside = sized.select("__place", "__source", F.col("__size").alias("__words")).join(
            state.select("__s", "__at"), F.col("__source").eqNullSafe(F.col("__s")) & (F.shiftright("__place", above) == F.col("__at"))
        )
        sums = inside.groupBy("__source", F.shiftright("__place", bits).alias("__next")).agg(F.sum("__words").alias("__w"))
        run = F.sum("__w").over(Window.partitionBy("__source").orderBy("__next"))
        sums = sums.withColumn("__run", run).join(state.select("__s", "__need", "__done"), F.col("__source").eqNullSafe(F.col("__s")))
        edge = sums.where("__done + __run >= __need").groupBy("__source").agg(F.min(F.struct("__next", "__w", "__run")).alias("__e"))
        state = keep(
            state.join(edge, F.col("__source").eqNullSafe(F.col("__s"))).select(
                "__s", "__size", "__target", "__base", "__need",
                (F.col("__done") + F.col("__e.__run") - F.col("__e.__w")).alias("__done"),
                F.col("__e.__next").alias("__at"), F.col("__e.__w").alias("__sum"),
            ),
            "sources",
        )
        above = bits
    over, under = F.col("__done") + F.col("__sum") - F.col("__need"), F.col("__need") - F.col("__done")
    return state.select("__s", "__size", "__target", "__base", F.when(over < under, F.col("__at")).otherwise(F.col("__at") - 1).alias("__cut"))


def sized(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    return docs.select(F.col(id_col).alias("__id"), place(id_col).alias("__place"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).cast("long").alias("__size"))


def copies(place_col):
    """How often the mix takes a document that stands at ``place_col``."""
    return F.col("__base") + (place_col <= F.col("__cut")).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    cuts = thresholds(keep(sized(docs), "sized"), **options).select(F.col("__s"), "__base", "__cut")
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("__row"), place("doc_id").alias("__place"), F.col("source").alias("__source"))
    taken = rows.join(cuts, F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__times", copies(F.col("__place")))
    return taken.where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select("__row.*")


def query(spark, sf_dir):
    """op1: doc_id, size, source_size, target, taken of every document."""
    rows = keep(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sized")
    cuts = thresholds(rows).select("__s", F.col("__size").alias("source_size"), F.col("__target").alias("target"), "__base", "__cut")
    taken = rows.join(cuts, F.col("__source").eqNullSafe(F.col("__s")))
    return taken.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * copies(F.col("__place"))).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS place,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::BIGINT AS weight,
             2 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, 3 * total - 2 * coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
             2 * sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den FROM w),
x AS (SELECT *, cap * den <= weight * num AS is_full FROM f),
o AS (SELECT num AS n, den AS dn FROM x WHERE NOT is_full ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (weight * n)::DOUBLE / dn::DOUBLE END AS target
      FROM x LEFT JOIN o ON true),
b AS (SELECT *, target >= source_size AS base, target - CASE WHEN target >= source_size THEN source_size ELSE 0 END AS need FROM t),
p AS (SELECT source, place, sum(size) AS words FROM d GROUP BY source, place),
r AS (SELECT p.*, b.need, sum(words) OVER (PARTITION BY p.source ORDER BY place) AS run FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source),
e AS (SELECT source, arg_min(CASE WHEN run - need < need - (run - words) THEN place ELSE place - 1 END, place) AS cut FROM r WHERE run >= need GROUP BY source)
SELECT doc_id, size, b.source_size, b.target, (size * (b.base::INT + (place <= e.cut)::INT))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
