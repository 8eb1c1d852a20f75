"""Summaries of a classified prompt table: counts, coverage, overlap, instability, monthly trends.

Each report is one aggregate pass over the columns it needs. Label reports first count distinct
label combinations (a few hundred at most) and expand those, not the rows.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.stats import rate, safe_ratio
from colloquy.schema import FLAG_COLUMNS, LABEL_COLUMNS

# Flags whose coverage is reported.
COVERAGE = (
    ("interaction_mode", "interaction_mode_score"),
    ("cognitive_outsourcing_type", "cognitive_outsourcing_score"),
    ("emotion_primary", "emotion_score"),
    ("companionship", "companionship_score"),
    ("vulnerability", "vulnerability_score"),
    ("dependency", "dependency_score"),
    ("anthropomorphism", "anthropomorphism_score"),
    ("reassurance_seeking", "reassurance_seeking_score"),
    ("self_disclosure", "self_disclosure_score"),
)
# Scores that are compared.
SCORE_SETS = (
    ("interaction", (
        "interaction_mode_score", "cognitive_outsourcing_score", "emotion_score",
        "companionship_score", "vulnerability_score", "dependency_score",
    )),
    ("social_dependency", (
        "companionship_score", "vulnerability_score", "dependency_score",
        "anthropomorphism_score", "reassurance_seeking_score", "self_disclosure_score",
    )),
)


def unfold(entries: list[Column], one_row: DataFrame) -> DataFrame:
    """Turn a one-row frame into one row per struct."""
    return one_row.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def count_by(df: DataFrame, column: str, limit: int | None = 20) -> DataFrame:
    """Frequencies including null, most frequent first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("num_records"))
    return counts.orderBy(F.desc("num_records"), F.col(column)).limit(limit) if limit else counts


def summarize_classification(df: DataFrame, flags: tuple[str, ...] = FLAG_COLUMNS) -> DataFrame:
    """``metric, label, value``: label counts and flag rates in long form."""
    combos = df.groupBy(*LABEL_COLUMNS).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.col(flag).cast("int")).alias(f"_sum_{flag}") for flag in flags],
        *[F.count(flag).alias(f"_n_{flag}") for flag in flags],
    )
    labels = [
        F.struct(F.lit(name).alias("metric"), F.coalesce(F.col(name), F.lit("nan")).alias("label"),
                 F.col("_n").alias("_a"), F.lit(None).cast("long").alias("_b"))
        for name in LABEL_COLUMNS
    ]
    rates = [
        F.struct(F.lit(flag).alias("metric"), F.lit("rate").alias("label"),
                 F.coalesce(F.col(f"_sum_{flag}"), F.lit(0)).alias("_a"), F.col(f"_n_{flag}").alias("_b"))
        for flag in flags
    ]
    pieces = combos.select(F.explode(F.array(*labels, *rates)).alias("_e")).select("_e.*")
    totals = pieces.groupBy("metric", "label").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    value = F.when(F.col("label") == "rate", safe_ratio(F.col("_a"), F.coalesce("_b", F.lit(0))))
    return totals.select(
        "metric", "label",
        F.when(F.col("metric").isin(*flags), value).otherwise(F.col("_a").cast("double")).alias("value"),
    )


def unlabeled_evaluation(df: DataFrame) -> DataFrame:
    """Label distributions and four flag rates, for tables without a labelled reference."""
    wanted = ("is_companionship", "is_vulnerable", "is_dependency_signal", "is_cognitive_outsourcing")
    return summarize_classification(df, wanted)


def taxonomy_coverage(df: DataFrame) -> DataFrame:
    """Per dimension: rows, rows with a positive score, their share, and the mean score."""
    totals = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(score) > 0).alias(f"_c_{name}") for name, score in COVERAGE],
        *[F.sum(F.coalesce(F.col(score), F.lit(0.0))).alias(f"_s_{name}") for name, score in COVERAGE],
    )
    rows = [
        F.struct(
            F.lit(name).alias("dimension"),
            F.col("_n").alias("num_records"),
            F.col(f"_c_{name}").alias("covered_records"),
            safe_ratio(F.col(f"_c_{name}"), F.col("_n")).alias("coverage_rate"),
            F.coalesce(safe_ratio(F.col(f"_s_{name}"), F.col("_n")), F.lit(0.0)).alias("mean_score"),
        )
        for name, _ in COVERAGE
    ]
    return unfold(rows, totals)


def behavioral_overlap(df: DataFrame) -> DataFrame:
    """How often two flags hold together: all ordered pairs, the diagonal included."""
    pairs = list(combinations_with_replacement(FLAG_COLUMNS, 2))
    totals = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(a) & F.col(b)).alias(f"{a}&{b}") for a, b in pairs],
    )
    rows = []
    for a, b in pairs:
        both = F.col(f"`{a}&{b}`")
        for left, right in {(a, b), (b, a)}:
            rows.append(
                F.struct(
                    F.lit(left).alias("left"), F.lit(right).alias("right"), both.alias("overlap_count"),
                    safe_ratio(both, F.col("_n")).alias("overlap_rate"),
                )
            )
    return unfold(rows, totals)


def unstable_regions(df: DataFrame, margin: float = 0.08) -> DataFrame:
    """Rows whose two best scores of a set lie within ``margin``; ties follow the listed order."""
    checks = []
    for dimension, columns in SCORE_SETS:
        ranked = F.array_sort(
            F.array(
                *[
                    F.struct(
                        (-F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias("negative"),
                        F.lit(i).alias("position"), F.lit(c).alias("signal"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        )
        checks.append(F.struct(F.lit(dimension).alias("dimension"), F.slice(ranked, 1, 2).alias("top")))
    exploded = df.select("record_id", F.explode(F.array(*checks)).alias("_c"))
    first, second = F.get(F.col("_c.top"), F.lit(0)), F.get(F.col("_c.top"), F.lit(1))
    return exploded.select(
        "record_id",
        F.col("_c.dimension").alias("dimension"),
        first["signal"].alias("top_signal"),
        second["signal"].alias("second_signal"),
        (-first["negative"]).alias("top_score"),
        (F.lit(0.0) - second["negative"]).alias("second_score"),
        (second["negative"] - first["negative"]).alias("margin"),
    ).filter((F.col("top_score") > 0) & (F.col("margin") <= margin))


def _with_period(df: DataFrame, period: str) -> DataFrame:
    return df.filter(F.col(period).isNotNull())


def emotional_trend(df: DataFrame, period: str = "year_month") -> DataFrame:
    return _with_period(df, period).groupBy(period).agg(
        F.count("record_id").alias("num_records"),
        rate(F.col("is_vulnerable")).alias("vulnerability_rate"),
        rate(F.col("is_dependency_signal")).alias("dependency_rate"),
        rate(F.col("is_companionship")).alias("companionship_rate"),
        F.avg("emotion_score").alias("mean_emotion_score"),
    )


def outsourcing_trend(df: DataFrame, period: str = "year_month") -> DataFrame:
    grouped = _with_period(df, period).groupBy(period, "cognitive_outsourcing_type")
    return grouped.agg(F.count(F.lit(1)).alias("num_records"))


def dependency_trend(df: DataFrame, period: str = "year_month") -> DataFrame:
    return _with_period(df, period).groupBy(period).agg(
        F.count("record_id").alias("num_records"),
        rate(F.col("is_dependency_signal")).alias("dependency_rate"),
        rate(F.col("is_anthropomorphic")).alias("anthropomorphism_rate"),
        rate(F.col("is_reassurance_seeking")).alias("reassurance_rate"),
        F.avg("dependency_score").alias("mean_dependency_score"),
    )


def complexity_trend(df: DataFrame, period: str = "year_month") -> DataFrame:
    return _with_period(df, period).groupBy(period).agg(
        F.count("record_id").alias("num_records"),
        F.avg("prompt_sophistication_score").alias("mean_prompt_sophistication"),
        F.avg("conversational_depth_score").alias("mean_conversational_depth"),
        F.avg("recursive_interaction_score").alias("mean_recursive_interaction"),
        F.avg("self_disclosure_score").alias("mean_self_disclosure"),
    )
