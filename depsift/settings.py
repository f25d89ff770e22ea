"""Settings of a search, with the defaults that thresholds and weights are tuned from."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """Everything that a search can be told.  Names follow what they bound; defaults are
    fixed values.  Without ``max_lhs_size``, the profile decides between two and three
    columns, and two is what an untuned search takes."""

    # rows and vocabularies
    continuous_bins: int = 32
    rare_token_min_freq: int = 1
    # candidates
    mode: str = "balanced"
    max_lhs_size: int | None = None
    lhs_allow: tuple[str, ...] = ()
    lhs_block: tuple[str, ...] = ()
    rhs_allow: tuple[str, ...] = ()
    rhs_block: tuple[str, ...] = ()
    group_match: str = "soft"
    cross_group_penalty: float = 0.35
    # support
    support_beta: float = 12.0
    min_support_count: int = 3
    min_effective_support_count: int = 1
    min_pure_support_count: int = 1
    high_card_min_effective_support_count: int = 2
    high_card_lhs_unique_ratio: float = 0.01
    min_row_purity: float = 0.98
    min_non_null_ratio: float = 0.0
    max_support_rows: int | None = None
    support_head_rows: int = 512
    priority_effective_alpha: float = 0.75
    priority_non_null_beta: float = 0.50
    independence_weight: float = 0.0
    # acceptance
    min_retained_mass: float = 0.02
    min_effective_retained_mass: float = 0.0
    min_weighted_non_null_ratio: float = 0.0
    min_s_ent: float = 0.90
    min_s_acc: float = 0.90
    min_score: float = 0.90
    min_direction_margin: float = -0.01
    direction_margin_mode: str = "single_only"
    # scores
    score_alpha: float = 0.60
    model_score_weight: float = 0.80
    empirical_aux_weight: float = 0.05
    empirical_high_card_base: float = 0.12
    empirical_high_card_bonus: float = 0.55
    high_card_start_ratio: float = 0.02
    high_card_full_ratio: float = 0.20
    low_card_start_ratio: float = 0.02
    low_card_full_ratio: float = 0.12
    identifier_start_ratio: float = 0.65
    identifier_full_ratio: float = 0.90
    max_empirical_blend: float = 0.90
    coverage_row_target: int = 64
    coverage_effective_row_target: int = 64
    coverage_mass_target: float = 0.10
    coverage_penalty_weight: float = 0.25
    # right sides with few values
    low_card_vocabulary: int = 16
    low_card_min_s_ent: float = 0.86
    low_card_min_s_acc: float = 0.88
    low_card_min_score: float = 0.90
    low_card_biased_top1: float = 0.50
    low_card_biased_bump: float = 0.03
    low_card_model_floor: float = 0.30
    low_card_gap_floor: float = 0.35
    low_card_min_effective_mass: float = 0.08
    low_card_holdout_min_accuracy: float = 0.90
    low_card_holdout_min_coverage: float = 0.03
    low_card_holdout_min_examples: int = 64
    low_card_compound_min_lift: float = 0.05
    # compound left sides
    compound_min_effective_rows: int = 16
    compound_min_effective_mass: float = 0.03
    compound_min_gain: float = 0.08
    low_card_compound_min_gain: float = 0.12
    delta_gain: float = 0.05
    beam_width: int = 12
    # the estimator that stands for the model
    estimator: str = "backoff"
    backoff_strength: float = 0.25

    def __post_init__(self) -> None:
        if self.max_lhs_size is not None and self.max_lhs_size < 1:
            raise ValueError(f"max_lhs_size must be 1 or more, not {self.max_lhs_size}")
        if self.mode not in ("strict", "balanced", "permissive"):
            object.__setattr__(self, "mode", "balanced")

    @property
    def widest(self) -> int:
        return self.max_lhs_size or 2

    def with_options(self, **options) -> Settings:
        return replace(self, **options)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]
