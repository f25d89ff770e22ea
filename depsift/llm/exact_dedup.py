"""Exact dedup by deterministic block naming (op 3).

Every text is cut into blocks of fixed size.  All distinct blocks are sorted and
get integer names in that order; then adjacent pairs of names are named the same
way, level by level, until one name stands for the whole text.  Names come from
sorting whole values and never from hashing, so equal names mean equal texts.

Documents leave as soon as they are identified: one whose length and two border
blocks occur nowhere else is equal to nothing, and one whose names have shrunk to
a single one is done.  So the texts that are cut up are those with a possible
partner only.  Length and borders are compared by one 64-bit number: where it
differs, the texts do, and where it is the same by chance, the names decide.  The
table of such numbers that occur twice is written, so that Spark broadcasts it
below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.

Skew: the distinct blocks and pairs come from partially aggregated ``distinct``s,
and the joins that hand names back are plain sort-merge joins, which adaptive
execution splits where one block belongs to a third of all rows.  A group's verdict is
handed back to rows of a few numbers, by a join that is split likewise; texts and other
columns meet their verdict by a number of their own.

Defined cases: a null text counts as empty; all empty texts are equal; a text of any
length is named whole; an empty table gives an empty one.  Rows that repeat, or repeat a
doc_id, are rows of their own: ``group_size`` counts each, and exactly one row of a group
stays (of several rows with the largest doc_id, any one).  A null doc_id is below every
other.  Other columns pass through untouched, whatever their names, but for one named
``__dedup``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.llm.shared import ascii_lower, keep

_KEY = "__key"


def name_in_order(values: DataFrame, name: str) -> DataFrame:
    """Sort the distinct rows of ``values`` and number them in that order."""
    return keep(values.distinct().orderBy(*values.columns).withColumn(name, F.monotonically_increasing_id()), "names")


def identify(texts: DataFrame, block_chars: int) -> DataFrame:
    """(__uid, __text) -> (__uid, __level, __name): equal texts, and no others, share
    level and name."""
    one_empty = F.array(F.lit(""))
    blocks = F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    cut = texts.select("__uid", F.posexplode(F.when(F.col("__text") == "", one_empty).otherwise(blocks)).alias("__pos", "__block"))
    names = name_in_order(cut.select("__block"), "__name")
    level = keep(cut.join(names, "__block").select("__uid", "__pos", "__name"), "level")
    done, depth = None, 0
    while True:
        width = level.groupBy("__uid").agg(F.max("__pos").alias("__last"), F.min("__name").alias("__name"))
        ready = width.where("__last = 0").select("__uid", F.lit(depth).alias("__level"), "__name")
        done = ready if done is None else done.unionByName(ready)
        rest = level.join(width.where("__last > 0").select("__uid"), "__uid", "left_semi")
        even = F.col("__pos") % 2 == 0
        pairs = keep(
            rest.groupBy("__uid", F.shiftright("__pos", 1).alias("__pos")).agg(
                F.max(F.when(even, F.col("__name"))).alias("__left"),
                F.coalesce(F.max(F.when(~even, F.col("__name"))), F.lit(-1)).alias("__right"),
            ),
            "pairs",
        )
        if pairs.isEmpty():
            return done
        names = name_in_order(pairs.select("__left", "__right"), "__name")
        level = keep(pairs.join(names, ["__left", "__right"]).select("__uid", "__pos", "__name"), "level")
        depth += 1


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 2048, border_chars: int = 32, carry: list[str] | None = None) -> DataFrame:
    """Return the ``carry`` columns (all, if none are named) of every row with
    ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` in a struct ``__dedup``."""
    carry = [c for c in docs.columns if c != "__dedup"] if carry is None else carry
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    raw = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.struct(*(f"`{c}`" for c in carry)).alias("__row"),
        F.col(id_col).alias("__id"),
        text.alias("__text"),
        F.xxhash64(F.octet_length(raw), *(ascii_lower(f(raw, F.lit(border_chars))) for f in (F.left, F.right))).alias(_KEY),
    )
    tied = keep(rows.groupBy(_KEY).count().where("count > 1").select(_KEY), "tied")
    sha = F.sha2("__text", 256).alias("text_sha256")

    alone = rows.select("__row", "__id", _KEY, sha).join(tied, _KEY, "left_anti")
    alone = alone.select("__row", F.struct(F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256").alias("__dedup"))

    close = keep(rows.join(tied, _KEY, "left_semi").withColumn("__uid", F.monotonically_increasing_id()), "close")
    ident = keep(identify(close.select("__uid", "__text"), block_chars), "ident")
    members = close.select("__uid", "__id").join(ident, "__uid")
    # Most texts that may have a copy have none; only real groups are handed back.
    groups = members.groupBy("__level", "__name").agg(F.max(F.struct("__id", "__uid")).alias("__best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    verdicts = members.join(keep(groups, "groups"), ["__level", "__name"]).select("__uid", "__best", "group_size")
    named = close.select("__uid", "__row", "__id", sha).join(verdicts, "__uid", "left")
    single = F.col("group_size").isNull()
    grouped = named.select(
        "__row",
        F.struct(
            F.when(single, F.col("__id")).otherwise(F.col("__best.__id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (single | (F.col("__uid") == F.col("__best.__uid"))).alias("kept"),
            "text_sha256",
        ).alias("__dedup"),
    )
    return alone.unionByName(grouped).select("__row.*", "__dedup")


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, carry=["doc_id"]).select("doc_id", "__dedup.*")


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
