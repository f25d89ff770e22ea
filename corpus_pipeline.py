"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, source mix, packing.

Each stage takes all that the one before it kept.  The first four return the columns
of ``documents``; the last returns the packed pieces.  Rows that repeat stay rows of
their own until a dedup stage joins them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depsift.llm import exact_dedup, ngram_join, packing, quality_rules, source_mix
from depsift.llm.shared import keep, settle, table


#: Words of a shingle of the near-duplicate stage; its similarity as a fraction.
NEAR_WORDS, NEAR_SIMILARITY = 5, (80, 100)
#: Parts in which it shuffles and compares signatures, so that they fit beside the stages' tables.
NEAR_PARTS = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs."""
    judged = quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"))
    return judged.where("__quality.kept").select(*(f"`{c}`" for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.exact_dedup(docs).where("__dedup.kept").select(*(f"`{c}`" for c in docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, 0.8), the row with the smallest doc_id; of rows that
    repeat that doc_id, the one written first."""
    settle(spark)
    rows = keep(docs.select(F.struct(*docs.columns).alias("__row"), F.struct("doc_id", F.monotonically_increasing_id().alias("__uid")).alias("__id")), "rows")
    found = ngram_join.near_duplicates(rows, id_col="__id", text_col="__row.text", words=NEAR_WORDS, similarity=NEAR_SIMILARITY, parts=NEAR_PARTS)
    dropped = keep(found.where(~F.col("__row").eqNullSafe(F.col("__near.component_id"))).select(F.col("__row.__uid").alias("__uid")), "dropped")
    return rows.withColumn("__uid", F.col("__id.__uid")).join(dropped, "__uid", "left_anti").select("__row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return source_mix.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram jaccard join", near),
    ("source mix", mix),
    ("best-fit packing", pack),
]

#: Token ids are beyond SQL: tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
