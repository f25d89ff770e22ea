"""Scores of candidates as column expressions, and the same arithmetic on numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from depsift.settings import Settings


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ramp(c: Column, start: float, end: float) -> Column:
    """0 up to ``start``, 1 from ``end`` on, a line between; a step if they meet."""
    if end <= start:
        return F.when(c >= end, 1.0).otherwise(0.0)
    return clip((c - start) / (end - start))


def ramp_value(value: float, start: float, end: float) -> float:
    if end <= start:
        return 1.0 if value >= end else 0.0
    return min(1.0, max(0.0, (value - start) / (end - start)))


def entropy_strength(entropy: Column, marginal_entropy: Column, vocabulary: Column) -> Column:
    """How much of the marginal entropy is gone; tiny marginal entropies count as a
    twentieth of the most that the vocabulary allows."""
    floor = 0.05 * F.log(F.greatest(vocabulary.cast("double"), F.lit(2.0)))
    return clip(1 - entropy / F.greatest(marginal_entropy, floor, F.lit(1e-12)))


def accuracy_strength(top1: Column, marginal_top1: Column) -> Column:
    """The share of the way from guessing the commonest value to being right."""
    return clip((top1 - marginal_top1) / F.greatest(1 - marginal_top1, F.lit(1e-12)))


def coverage_factor(rows: Column, effective_rows: Column, effective_mass: Column, non_null: Column, s: Settings) -> Column:
    by_rows = F.least(F.lit(1.0), F.log1p(rows.cast("double")) / F.log1p(F.lit(float(s.coverage_row_target))))
    by_effective = F.least(F.lit(1.0), F.log1p(effective_rows.cast("double")) / F.log1p(F.lit(float(s.coverage_effective_row_target))))
    by_mass = F.least(F.lit(1.0), effective_mass / max(s.coverage_mass_target, 1e-12))
    p = min(1.0, max(0.0, s.coverage_penalty_weight))
    return (1 - p) + p * (by_rows + by_effective + by_mass + non_null) / 4


def low_card(unique_ratio: Column, unique: Column, s: Settings) -> Column:
    """Whether a right side has few values."""
    return (unique_ratio <= s.high_card_start_ratio) | ((unique > 0) & (unique <= s.low_card_vocabulary))


def identifier_signal(role: Column, unique_ratio: Column, s: Settings) -> Column:
    named = role.isin("identifier", "quasi_identifier")
    return F.when(named, 1.0).otherwise(ramp(unique_ratio, s.identifier_start_ratio, s.identifier_full_ratio))


def identifier_value(role: str, unique_ratio: float, s: Settings) -> float:
    """``identifier_signal`` of one column's facts."""
    return 1.0 if role in ("identifier", "quasi_identifier") else ramp_value(unique_ratio, s.identifier_start_ratio, s.identifier_full_ratio)


#: Roles whose weight hints at an identifier.
HINT_ROLES = ("code_categorical", "entity_name", "geo_code", "high_card_categorical")


def profile_identifier_signal(role: str, unique_ratio: float, weight: float, s: Settings) -> float:
    """The variant for tuning: cardinality alone counts too, and hints of roles."""
    if role in ("identifier", "quasi_identifier"):
        return 1.0
    by_ratio = ramp_value(unique_ratio, s.high_card_start_ratio, s.high_card_full_ratio)
    if role in HINT_ROLES:
        return max(by_ratio, min(1.0, max(0.0, weight)))
    return max(by_ratio, ramp_value(unique_ratio, s.identifier_start_ratio, s.identifier_full_ratio))


def empirical_blend(identifier: Column, unique_ratio: Column, coverage: Column, s: Settings) -> Column:
    """Weight of what was counted next to what the estimator says."""
    high = ramp(unique_ratio, s.high_card_start_ratio, s.high_card_full_ratio)
    low = 1 - ramp(unique_ratio, s.low_card_start_ratio, s.low_card_full_ratio)
    blend = s.empirical_aux_weight + s.empirical_high_card_base * F.sqrt(F.greatest(high, 0.25 * low)) + s.empirical_high_card_bonus * high * identifier
    blend = blend + F.when(identifier >= 0.65, (0.60 * high + 0.15 * low * coverage) * identifier).otherwise(0.0)
    return clip(blend * clip(coverage), 0.0, s.max_empirical_blend)


def extrapolated_patterns(observed: float, ratio: float, sampled: int, rows: int) -> float:
    """Patterns to expect in all rows from those in a sample: by ratio or in proportion,
    but no fewer than seen and no more than rows."""
    if observed <= 0:
        return 0.0
    sampled = max(sampled, 1)
    rows = max(rows, sampled)
    return float(min(max(observed, ratio * rows, observed * rows / sampled), rows))


def group_label(name: str) -> str | None:
    """p1, p2, ... as a prefix, or the number at the end of a column name."""
    if found := re.match(r"p(\d+)", name):
        return found[1]
    found = re.search(r"(\d+)$", name)
    return found[1] if found else None


def group_factor(lhs: tuple[str, ...], rhs: str, s: Settings) -> float:
    mine, theirs = group_label(rhs), {group_label(c) for c in lhs} - {None}
    if s.group_match == "off" or mine is None or not theirs or theirs == {mine}:
        return 1.0
    return 0.0 if s.group_match == "hard" else min(1.0, max(0.0, s.cross_group_penalty))
