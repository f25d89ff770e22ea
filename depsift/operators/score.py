"""Scores of many candidates from their pattern statistics, as one aggregation.

The estimator that stands for a trained model judges each pattern without one of the
rows of its commonest value and mixes in the marginal: with e valid rows and strength
k, the marginal's share is k / (e - 1 + k).  So a pattern seen once scores like the
marginal, and a large one like its counts.  With the empirical estimator both signals
are the counts, and the steps that fuse them change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depsift.functions.scores import accuracy_strength, clip, coverage_factor, empirical_blend, entropy_strength, low_card, ramp
from depsift.operators.counts import budget, priority
from depsift.operators.sides import SUMS
from depsift.settings import Settings

META = "cand int, lhs_columns array<string>, rhs_column string, identifier double, rhs_unique_ratio double, rhs_unique long, high_card boolean, group_factor double"


def candidate_meta(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), META)


def estimated(patterns: DataFrame, s: Settings) -> DataFrame:
    """Adds model_top1 and model_entropy; needs the marginal's ``m_top1``, ``m_entropy``."""
    if s.estimator == "empirical":
        return patterns.withColumns({"model_top1": F.col("top1"), "model_entropy": F.col("entropy")})
    k, others = s.backoff_strength, F.greatest(F.col("eff") - 1, F.lit(0)).cast("double")
    lean = F.lit(k) / (others + k)
    left = F.when(others > 0, (F.col("top1") * F.col("eff") - 1) / others).otherwise(F.lit(0.0))
    return patterns.withColumns(
        {
            "model_top1": (1 - lean) * left + lean * F.col("m_top1"),
            "model_entropy": (1 - lean) * F.col("entropy") + lean * F.col("m_entropy"),
        }
    )


def core_scores(patterns: DataFrame, marginals: DataFrame, meta: DataFrame, rows: int, s: Settings) -> DataFrame:
    """(cand, lhs, n, eff, entropy, top1, non_null_ratio) of all candidates, the
    marginals of right sides and the candidates' facts -> a row a candidate that passes
    the early tests, with model, empirical and fused scores.  ``times``, if there, is how many
    patterns a row stands for; it then has no lhs, and a cap on patterns is not possible."""
    m = marginals.select(F.col("column").alias("rhs_column"), "vocabulary", F.col("entropy").alias("m_entropy"), F.col("top1").alias("m_top1"))
    facts = meta.join(m, "rhs_column")
    floor = F.when(F.col("high_card"), max(s.min_effective_support_count, s.high_card_min_effective_support_count)).otherwise(s.min_effective_support_count)
    pure = F.when(F.col("high_card"), max(s.min_pure_support_count, s.high_card_min_effective_support_count)).otherwise(s.min_pure_support_count)
    counts = (F.col("n") >= s.min_support_count) | (F.col("eff") >= floor) | ((F.col("top1") >= s.min_row_purity) & (F.col("eff") >= pure))
    if s.min_non_null_ratio > 0:
        counts = counts & (F.col("non_null_ratio") >= s.min_non_null_ratio)
    # A short row a candidate: ``plans.search.PER_JOB`` at most, or all wider ones of a level whose rows are dealt.
    each = patterns.join(F.broadcast(facts), "cand").where(counts)
    if s.max_support_rows:
        each = budget(each.withColumn("priority", priority(s)), ["lhs"], s, by=["cand"])
    each = estimated(each, s)
    times = F.col("times") if "times" in patterns.columns else F.lit(1)
    n = F.col("n") * times
    vocabulary = F.col("vocabulary") + 4
    strengths = {
        "model_s_ent": entropy_strength(F.col("model_entropy"), F.col("m_entropy"), vocabulary),
        "model_s_acc": accuracy_strength(F.col("model_top1"), F.col("m_top1")),
        "empirical_s_ent": entropy_strength(F.col("entropy"), F.col("m_entropy"), vocabulary),
        "empirical_s_acc": accuracy_strength(F.col("top1"), F.col("m_top1")),
        "weighted_non_null_ratio": F.col("non_null_ratio"),
        "expected_entropy": F.col("model_entropy"),
        "expected_top1": F.col("model_top1"),
        "empirical_expected_entropy": F.col("entropy"),
        "empirical_expected_top1": F.col("top1"),
    }
    fixed = [c for c in facts.columns if c != "cand"]
    total = (
        each.groupBy("cand")
        .agg(
            F.sum(times).cast("long").alias("support_rows"), F.sum(F.when(F.col("eff") > 0, times).otherwise(0)).cast("long").alias("effective_support_rows"), (F.sum(n) / rows).alias("retained_mass"), (F.sum(F.col("eff") * times) / rows).alias("effective_retained_mass"),
            *((F.sum(n * v) / F.sum(n)).alias(c) for c, v in strengths.items()),
            *(F.first(c).alias(c) for c in fixed),
        )
    )
    return fused(_early(total, s), s)


def summed_scores(sums: DataFrame, marginals: DataFrame, meta: DataFrame, rows: int, s: Settings) -> DataFrame:
    """``core_scores`` from cand and the sums of its patterns, as ``sides.SUMS`` names them."""
    m = marginals.select(F.col("column").alias("rhs_column"), "vocabulary", F.col("entropy").alias("m_entropy"), F.col("top1").alias("m_top1"))
    at = {c: F.col("sums")[i] for i, c in enumerate(SUMS)}
    total = sums.join(meta.join(F.broadcast(m), "rhs_column"), "cand").select(
        "cand", at["support_rows"].cast("long").alias("support_rows"), at["effective_support_rows"].cast("long").alias("effective_support_rows"),
        (at["n"] / rows).alias("retained_mass"), (at["eff"] / rows).alias("effective_retained_mass"), *((at[c] / at["n"]).alias(c) for c in SUMS[4:]),
        *(c for c in meta.columns if c != "cand"), "vocabulary", "m_entropy", "m_top1",
    )
    return fused(_early(total, s), s)


def _early(total: DataFrame, s: Settings) -> DataFrame:
    kept = total.where((F.col("retained_mass") >= s.min_retained_mass) & (F.col("effective_retained_mass") >= s.min_effective_retained_mass))
    return kept.where((F.col("weighted_non_null_ratio") >= s.min_weighted_non_null_ratio) & (F.col("group_factor") > 0))


def fused(core: DataFrame, s: Settings) -> DataFrame:
    """Model and empirical strengths to s_ent, s_acc and score."""
    a = s.score_alpha
    u, high = F.col("rhs_unique_ratio"), ramp(F.col("rhs_unique_ratio"), s.high_card_start_ratio, s.high_card_full_ratio)
    low = low_card(u, F.col("rhs_unique"), s)
    rows = core.withColumns(
        {
            "model_score": a * F.col("model_s_ent") + (1 - a) * F.col("model_s_acc"),
            "empirical_score": a * F.col("empirical_s_ent") + (1 - a) * F.col("empirical_s_acc"),
            "coverage_factor": coverage_factor(F.col("support_rows"), F.col("effective_support_rows"), F.col("effective_retained_mass"), F.col("weighted_non_null_ratio"), s),
            "low_card": low,
        }
    )
    backed = (F.col("model_s_acc") >= s.low_card_model_floor) | (F.col("model_s_ent") >= s.low_card_model_floor)
    trusted = ~F.col("low_card") | backed
    gap = F.greatest(F.col("empirical_s_acc") - F.col("model_s_acc"), F.lit(0.0))
    boosted = (gap > 0.15) & (F.col("empirical_s_acc") >= 0.90) & (F.col("effective_support_rows") >= 10) & trusted
    scale = F.greatest(F.when(F.col("low_card"), 0.35).otherwise(1.0), high)
    weight = min(1.0, max(0.0, s.model_score_weight))
    rows = rows.withColumn("empirical_blend", empirical_blend(F.col("identifier"), u, F.col("coverage_factor"), s))
    rows = rows.withColumns(
        {
            "empirical_blend": F.when(boosted, clip(F.col("empirical_blend") + F.least(gap, F.lit(0.75)) * scale, 0.0, s.max_empirical_blend)).otherwise(F.col("empirical_blend")),
            "__model_weight": F.when(boosted, max(0.3 * weight, 0.10)).otherwise(weight),
        }
    )
    rows = rows.withColumn("empirical_bonus_weight", F.col("empirical_blend") * (1 - F.col("__model_weight")))
    out = {}
    for c in ("s_ent", "s_acc"):
        delta = F.col(f"empirical_{c}") - F.col(f"model_{c}")
        blended = F.col(f"model_{c}") + F.when(delta >= 0, F.col("empirical_bonus_weight")).otherwise(0.5 * F.col("empirical_bonus_weight")) * delta
        # Counts of identifiers are as good as the truth.
        pull = 0.70 * F.col("identifier") * F.greatest(high, F.lit(0.35))
        override = (F.col("identifier") >= 0.65) & (F.col("empirical_s_acc") >= 0.90) & trusted
        out[c] = clip(F.when(override, blended + pull * F.greatest(F.col(f"empirical_{c}") - blended, F.lit(0.0))).otherwise(blended))
    rows = rows.withColumns(out)
    return rows.withColumn("score", clip((a * F.col("s_ent") + (1 - a) * F.col("s_acc")) * F.col("coverage_factor") * F.col("group_factor"))).drop("__model_weight")


def reverse_margins(scores: DataFrame) -> DataFrame:
    """Adds reverse_score (the model's accuracy strength of the opposite direction, 0 if
    it wasn't scored) and direction_margin to single-column candidates."""
    back = scores.select(F.col("rhs_column").alias("__l"), F.col("lhs_columns")[0].alias("__r"), F.col("model_s_acc").alias("reverse_score"))
    joined = scores.join(back, (F.col("lhs_columns")[0] == F.col("__l")) & (F.col("rhs_column") == F.col("__r")), "left").drop("__l", "__r")
    joined = joined.withColumn("reverse_score", F.coalesce("reverse_score", F.lit(0.0)))
    return joined.withColumn("direction_margin", F.col("model_s_acc") - F.col("reverse_score"))
