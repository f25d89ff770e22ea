"""Column profiles: statistics, families, roles, search flags, tuned settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depsift.functions.scores import extrapolated_patterns, profile_identifier_signal, ramp_value
from depsift.operators.counts import hashed, value_counts
from depsift.settings import Settings

#: Parts of names and limits that tell roles apart.
ID_WORDS = ("id", "uuid", "guid", "number", "phone", "email", "account")
HIGH_CARD_COUNT, HIGH_CARD_RATIO = 256, 0.01
QUASI_COUNT, QUASI_RATIO = 1024, 0.03
#: Rows that the profile for tuning looks at.
PROFILE_ROWS = 20_000


def families(df: DataFrame, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """date, categorical, discrete_numeric or numeric for each column; arrays, maps and
    structs are refused."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise TypeError(f"column {f.name} is {f.dataType.simpleString()}; turn it into text or numbers first")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[f.name] = "date"
        elif isinstance(f.dataType, T.IntegralType):
            out[f.name] = "discrete_numeric"
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = "numeric"
        else:
            out[f.name] = "categorical"
    return out | (overrides or {})


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, rows, unique_count, unique_ratio, marginal_top1.  Null is one value, as
    is NaN.  Values are counted by 64-bit hashes of them, in the mappers first."""
    columns = columns or df.columns
    counted = value_counts(hashed(df, columns)).withColumnRenamed("k", "n")
    stats = counted.groupBy("at").agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("unique_count"),
        (F.count(F.lit(1)) / F.sum("n")).alias("unique_ratio"),
        (F.max("n") / F.sum("n")).alias("marginal_top1"),
    )
    return stats.select(F.get(F.array(*map(F.lit, columns)), F.col("at")).alias("column"), "rows", "unique_count", "unique_ratio", "marginal_top1")


def approximate_column_stats(df: DataFrame, columns: list[str] | None = None, rsd: float = 0.02) -> DataFrame:
    """The same without tops, from one sketch a column: nothing but sketches is shuffled."""
    columns = columns or df.columns
    nulls = {c: F.max(F.col(c).isNull().cast("long")) for c in columns}
    one = df.agg(F.count(F.lit(1)).alias("rows"), *((F.approx_count_distinct(c, rsd) + nulls[c]).alias(c) for c in columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(c).alias("unique_count"), (F.col(c) / F.col("rows")).alias("unique_ratio")) for c in columns))))


def degenerate(stats: DataFrame) -> DataFrame:
    """Columns that are nearly constant, or have one or two values; a warning only."""
    return stats.where("marginal_top1 >= 0.95 OR (unique_count > 0 AND unique_count <= 2)").select(
        "column", F.when(F.col("marginal_top1") >= 0.95, "dominant_value").otherwise("few_values").alias("reason")
    )


def with_families(stats: DataFrame, family: dict[str, str]) -> DataFrame:
    pairs = F.create_map(*(x for c, f in family.items() for x in (F.lit(c), F.lit(f))))
    return stats.withColumn("family", F.coalesce(F.element_at(pairs, F.col("column")), F.lit("unknown")))


def _named(*parts: str) -> Column:
    name = F.lower("column")
    out = F.lit(False)
    for p in parts:
        out = out | name.contains(p)
    return out


def roles(stats: DataFrame) -> DataFrame:
    """Adds role, analysis_mode, rhs_mode and empirical_weight; the first rule that
    holds decides."""
    n, u, family = F.col("unique_count"), F.col("unique_ratio"), F.col("family")
    categorical = family == "categorical"
    high = (n >= HIGH_CARD_COUNT) | (u >= HIGH_CARD_RATIO)
    quasi = (n >= QUASI_COUNT) & (u >= QUASI_RATIO)
    date, small_date, small_number = family == "date", (n <= 32) & (u <= 0.05), (n <= 128) & (u <= 0.05)
    number = F.when(family == "numeric", "continuous_numeric").otherwise("discrete_numeric")
    none, exact, binned = ("excluded", "excluded"), ("exact", "exact"), ("binned", "binned")
    rules: list[tuple[Column, Column | str, tuple[str, str], float]] = [
        (n <= 1, "constant", none, 0.0),
        (u >= 0.98, "identifier", none, 1.0),
        (categorical & (u >= 0.50) & _named(*ID_WORDS), "quasi_identifier", exact, 0.95),
        (categorical & (u >= 0.50), "near_identifier", none, 0.0),
        (categorical & high & _named(*ID_WORDS) & quasi, "quasi_identifier", exact, 0.95),
        (categorical & high & _named("zip", "postal"), "geo_code", exact, 0.70),
        (categorical & high & _named("avg", "code"), "code_categorical", exact, 0.80),
        (categorical & high & _named("city", "county", "state", "country"), "location_categorical", exact, 0.55),
        (categorical & high & _named("name"), "entity_name", exact, 0.65),
        (categorical & high, "high_card_categorical", exact, 0.70),
        (categorical, "semantic_categorical", exact, 0.0),
        (date & (u >= 0.5), "temporal", none, 0.0),
        (date & small_date, "temporal", exact, 0.0),
        (date, "temporal", binned, 0.0),
        (u >= 0.5, number, none, 0.0),
        (small_number, number, exact, 0.0),
        (F.lit(True), number, binned, 0.0),
    ]
    choice = None
    for holds, role, (analysis, rhs), weight in rules:
        value = F.struct(
            (F.lit(role) if isinstance(role, str) else role).alias("role"), F.lit(analysis).alias("analysis_mode"), F.lit(rhs).alias("rhs_mode"), F.lit(weight).alias("empirical_weight")
        )
        choice = F.when(holds, value) if choice is None else choice.when(holds, value)
    return stats.withColumn("__role", choice).select(*stats.columns, "__role.*")


def model_type(frame: DataFrame) -> DataFrame:
    """categorical, continuous_bucket or discrete_numeric: how values become tokens."""
    continuous = (F.col("family") == "numeric") & (F.col("analysis_mode") != "exact")
    kind = F.when(F.col("family") == "categorical", "categorical").when(continuous | (F.col("analysis_mode") == "binned"), "continuous_bucket")
    return frame.withColumn("model_type", kind.otherwise("discrete_numeric"))


def search_flags(frame: DataFrame, mode: str = "balanced", target: str | None = None) -> DataFrame:
    """Adds lhs_policy and rhs_policy (what the modes of the role say) and lhs and rhs
    (what a search in ``mode`` may use)."""
    mode = mode if mode in ("strict", "balanced", "permissive") else "balanced"
    role, kind = F.col("role"), F.col("model_type")
    lhs_policy, rhs_policy = F.col("analysis_mode").isin("exact", "binned"), F.col("rhs_mode") == "exact"
    loose = F.lit(mode != "strict")
    identifying = role.isin("identifier", "quasi_identifier")
    part = F.col("unique_ratio") < 1.0
    rhs_kinds = kind.isin("categorical", "discrete_numeric") if mode == "balanced" else F.lit(True)
    lhs = (
        F.when(role == "constant", False)
        .when(role == "near_identifier", loose)
        .when(identifying, part)
        .otherwise(lhs_policy | loose)
    )
    rhs = (
        F.when(role == "constant", False)
        .when(role == "near_identifier", loose)
        .when(identifying, part & rhs_policy & loose)
        .otherwise(rhs_policy | (loose & rhs_kinds))
    )
    aim = F.col("column") == F.lit(target) if target else F.lit(False)
    return frame.withColumns({"lhs_policy": lhs_policy, "rhs_policy": rhs_policy, "lhs": F.when(aim, False).otherwise(lhs), "rhs": F.when(aim, False).otherwise(rhs)})


def searchability(frame: DataFrame) -> DataFrame:
    """Whether each side is open by policy, only by the mode, or not at all."""
    def say(policy: str, flag: str) -> Column:
        return F.when(F.col(flag) & F.col(policy), "policy").when(F.col(flag), "relaxed").otherwise("disabled")

    return frame.select("column", say("lhs_policy", "lhs").alias("lhs_search"), say("rhs_policy", "rhs").alias("rhs_search"))


def profile(df: DataFrame, *, columns: list[str] | None = None, overrides: dict[str, str] | None = None, mode: str = "balanced", target: str | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Statistics, family, role, model type and flags of every column.  With ``stats``, as
    ``column_stats`` gives them, no row is read."""
    df = df.select(*columns) if columns else df
    stats = with_families(column_stats(df) if stats is None else stats, families(df, overrides))
    return search_flags(model_type(roles(stats)), mode, target)


@dataclass(frozen=True)
class Summary:
    """What the profile says about a table as a whole."""

    rows: int
    lhs_columns: int
    rhs_columns: int
    identifier_strength: float
    low_card_strength: float
    high_card_strength: float
    pattern_median: float
    pattern_p75: float


def _quantile(values: list[float], q: float) -> float:
    if not values:
        return 0.0
    values = sorted(values)
    at = q * (len(values) - 1)
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


def _strength(values: list[float]) -> float:
    return max(sum(values) / len(values), _quantile(values, 0.75)) if values else 0.0


def summarize(rows: list, total_rows: int, settings: Settings) -> Summary:
    """``rows``: the profile's rows, one a column, collected."""
    lhs = [r for r in rows if r["lhs"]]
    signals = [profile_identifier_signal(r["role"], r["unique_ratio"], r["empirical_weight"], settings) for r in lhs]
    patterns = [
        p
        for r, signal in zip(lhs, signals, strict=True)
        if r["analysis_mode"] != "binned" and signal >= 0.60 and (p := extrapolated_patterns(r["unique_count"], r["unique_ratio"], r["rows"], total_rows)) >= 128
    ]
    low, high = [], []
    for r in rows:
        u = r["unique_ratio"]
        if not r["rhs"] or r["role"] in ("identifier", "quasi_identifier", "near_identifier"):
            continue
        if u < 0.30:
            low.append(1 - ramp_value(u, 0.02, 0.12))
            high.append(ramp_value(u, 0.02, 0.20) ** 0.5)
        elif u < 0.60:
            high.append(0.5 * ramp_value(u, 0.20, 0.60) ** 0.5)
    return Summary(
        max((r["rows"] for r in rows), default=0), len(lhs), sum(bool(r["rhs"]) for r in rows), _strength(signals), _strength(low), _strength(high), _quantile(patterns, 0.5), _quantile(patterns, 0.75)
    )


def tuned(settings: Settings, s: Summary) -> Settings:
    """Thresholds and weights that fit the table.  Coefficients and limits are fixed values."""

    def clip(value: float, low: float, high: float) -> float:
        return min(high, max(low, value))

    high, identifiers = s.high_card_strength, s.identifier_strength * s.low_card_strength
    need = max(high, identifiers)
    bar = clip(0.88 - 0.18 * max(high, 0.5 * s.low_card_strength), 0.70, 0.88)
    direction = max(s.identifier_strength, 0.3 * high)
    sparse = clip(s.pattern_p75 / 5000, 0, 1) * clip(s.lhs_columns / 15, 0, 1)
    cap = int(clip(1024 + round(1024 * high), 1024, 2048))
    return settings.with_options(
        max_lhs_size=settings.max_lhs_size or (3 if s.lhs_columns >= 8 and high >= 0.3 else 2),
        support_beta=clip(12 + 36 * high, 12, 48),
        min_support_count=2 if high >= 0.45 else 3,
        max_support_rows=None if settings.max_support_rows is None else cap,
        support_head_rows=int(clip(cap // 2, 256, 1024)),
        min_retained_mass=clip(0.02 - 0.01 * high, 0.01, 0.02),
        min_effective_retained_mass=clip(0.01 * high, 0.0, 0.01),
        min_s_ent=bar,
        min_s_acc=bar,
        min_score=bar,
        model_score_weight=clip(0.80 - 0.45 * need, 0.35, 0.80),
        empirical_aux_weight=clip(0.05 + 0.10 * identifiers, 0.05, 0.15),
        empirical_high_card_base=clip(0.10 + 0.30 * high, 0.10, 0.45),
        empirical_high_card_bonus=clip(0.15 + 0.25 * high, 0.15, 0.40),
        coverage_penalty_weight=clip(0.25 - 0.10 * need, 0.10, 0.25),
        delta_gain=clip(0.04 + 0.06 * high, 0.04, 0.10),
        min_direction_margin=clip(-0.02 + 0.10 * direction, -0.02, 0.08),
        min_weighted_non_null_ratio=clip(0.25 * sparse, 0.0, 0.25),
    )
