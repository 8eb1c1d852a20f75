"""Trend and independence tests as DataFrame algebra over small aggregated series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions.stats import (
    chi_square_tail_p, normal_two_sided_p, safe_ratio, student_two_sided_p,
)


def tested_columns(columns: list[str], period: str) -> list[str]:
    """Trend columns that are tested: no counts, rolling means or differences."""
    return [
        c for c in columns
        if c not in (period, "num_records") and not c.endswith("_delta") and "_rolling_" not in c
    ]


def _series(trends: DataFrame, period: str, columns: list[str], strata: list[str]) -> DataFrame:
    """Long form ``strata, metric, period, x, y`` with x the ordinal of the period."""
    window = W.partitionBy(*strata).orderBy(period)
    numbered = trends.withColumn("_x", F.row_number().over(window) - 1)
    values = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("_y")) for c in columns]
    )
    return numbered.select(*strata, period, "_x", F.explode(values).alias("_m")).select(
        *strata, period, "_m.metric", F.col("_x").cast("double").alias("_x"), F.col("_m._y").alias("_y")
    )


def linear_trends(
    trends: DataFrame, period: str, columns: list[str] | None = None, strata: list[str] | None = None,
    min_periods: int = 3,
) -> DataFrame:
    """Least squares over period ordinals with r, two-sided p and slope error, per metric."""
    groups = strata or []
    names = columns or tested_columns([c for c in trends.columns if c not in groups], period)
    valid = _series(trends, period, names, groups).filter(F.col("_y").isNotNull() & ~F.isnan("_y"))
    sums = valid.groupBy(*groups, "metric").agg(
        F.regr_slope("_y", "_x").alias("slope_per_period"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_sxx("_y", "_x").alias("_sxx"),
        F.regr_syy("_y", "_x").alias("_syy"),
        F.regr_sxy("_y", "_x").alias("_sxy"),
        F.count(F.lit(1)).alias("num_periods"),
        F.min("_y").alias("_low"),
        F.max("_y").alias("_high"),
        F.min_by("_y", "_x").alias("first_value"),
        F.max_by("_y", "_x").alias("last_value"),
    ).filter(F.col("num_periods") >= min_periods)
    constant = F.col("_low") == F.col("_high")
    r = F.when(constant, F.lit(0.0)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), safe_ratio(
            F.col("_sxy"), F.sqrt(F.col("_sxx") * F.col("_syy")))))
    )
    fitted = sums.withColumn("r_value", r).withColumn("_dof", F.col("num_periods") - 2)
    r2 = F.col("r_value") * F.col("r_value")
    t = F.try_divide(F.col("r_value") * F.sqrt(F.col("_dof").cast("double")), F.sqrt(F.lit(1.0) - r2))
    p = F.when(constant, F.lit(1.0)).when(r2 >= 1.0, F.lit(0.0)).otherwise(
        student_two_sided_p(t, F.col("_dof"))
    )
    error = F.when(constant, F.lit(0.0)).otherwise(
        F.sqrt(safe_ratio((F.lit(1.0) - r2) * F.col("_syy"), F.col("_sxx")) / F.greatest("_dof", F.lit(1)))
    )
    return fitted.select(
        *groups, "metric",
        F.when(constant, F.lit(0.0)).otherwise(F.col("slope_per_period")).alias("slope_per_period"),
        "intercept", "r_value", p.alias("p_value"), error.alias("std_error"), "num_periods",
        "first_value", "last_value",
    )


def trend_statistics(trends: DataFrame, period: str = "year_month") -> DataFrame:
    """Linear trend of every rate and mean score."""
    return linear_trends(trends, period).drop("first_value", "last_value")


def with_change(statistics: DataFrame) -> DataFrame:
    """Absolute and relative (%) change from the first to the last period, and R²."""
    return statistics.withColumns(
        {
            "r_squared": F.col("r_value") * F.col("r_value"),
            "total_change": F.col("last_value") - F.col("first_value"),
            "relative_change_pct": (F.try_divide(F.col("last_value"), F.col("first_value")) - 1) * 100,
        }
    )


def mann_kendall(series: DataFrame, period: str, value: str, strata: list[str] | None = None) -> DataFrame:
    """Mann–Kendall trend test: S, z (continuity-corrected), two-sided p, direction.

    The series (one value per period) is gathered into one array per stratum, which holds as many
    entries as there are periods; S is a sum over its ordered pairs.
    """
    groups = strata or []
    points = F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), F.col(value).cast("double").alias("v"))))
    gathered = series.filter(F.col(value).isNotNull()).groupBy(*groups).agg(
        F.transform(points, lambda e: e["v"]).alias("_y")
    )
    n = F.size("_y")

    def later_signs(current: Column, i: Column) -> Column:
        later = F.slice(F.col("_y"), i + 2, F.greatest(n - i - 1, F.lit(0)))
        return F.aggregate(later, F.lit(0.0), lambda acc, v: acc + F.signum(v - current))

    s = F.aggregate(F.transform("_y", later_signs), F.lit(0.0), lambda acc, v: acc + v)
    scored = gathered.select(*groups, n.cast("long").alias("num_periods"), s.alias("s"))
    size = F.col("num_periods").cast("double")
    scored = scored.withColumn("_var", size * (size - 1) * (size * 2 + 5) / 18)
    z = (
        F.when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt("_var"))
        .when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt("_var"))
        .otherwise(F.lit(0.0))
    )
    direction = (
        F.when(F.col("s") > 0, F.lit("increasing"))
        .when(F.col("s") < 0, F.lit("decreasing"))
        .otherwise(F.lit("no trend"))
    )
    scored = scored.withColumn("z", z)
    return scored.select(
        *groups, direction.alias("trend"), "num_periods", "s", "z",
        normal_two_sided_p(F.col("z")).alias("p_value"),
    )


def chi_square_independence(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Pearson's χ² for two categorical columns; Yates' correction with one degree of freedom.

    Only observed cells are laid out: the expected counts of all cells sum to the number of records, so
    the empty ones add what the observed ones leave of it. In a 2 × 2 table every cell deviates from its
    expectation by the same d, so the corrected statistic is the plain one times ((d − min(½, d)) / d)².
    """
    observed = df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(
        F.col(rows).cast("string").alias("_r"), F.col(columns).cast("string").alias("_c")
    ).agg(F.count(F.lit(1)).alias("_o"))
    row_margin = observed.groupBy("_r").agg(F.sum("_o").alias("_rt"))
    column_margin = observed.groupBy("_c").agg(F.sum("_o").alias("_ct"))
    total = observed.agg(F.sum("_o").cast("double")).scalar()
    cells = observed.join(row_margin, "_r").join(column_margin, "_c").withColumn(
        "_e", F.col("_rt") * F.col("_ct") / total
    )
    gap = F.col("_o") - F.col("_e")
    sums = cells.agg(
        F.sum(gap * gap / F.col("_e")).alias("_seen"),
        F.sum("_e").alias("_expected"),
        F.max(F.abs(gap)).alias("_gap"),
        F.count(F.lit(1)).alias("_cells"),
        F.sum("_o").cast("long").alias("num_records"),
        F.count_distinct("_r").alias("_rows"),
        F.count_distinct("_c").alias("_columns"),
    ).withColumn("dof", (F.col("_rows") - 1) * (F.col("_columns") - 1))
    unseen = F.greatest(F.col("num_records") - F.col("_expected"), F.lit(0.0))
    plain = F.col("_seen") + F.when(F.col("_cells") < F.col("_rows") * F.col("_columns"), unseen).otherwise(0.0)
    shrink = F.coalesce(F.try_divide(F.col("_gap") - F.least(F.lit(0.5), F.col("_gap")), F.col("_gap")), F.lit(0.0))
    statistic = F.when(F.col("dof") == 1, plain * shrink * shrink).otherwise(plain)
    scored = sums.withColumn("chi_square", statistic)
    p = F.when(F.col("dof") == 0, F.lit(1.0)).otherwise(
        chi_square_tail_p(F.col("chi_square"), F.col("dof"))
    )
    return scored.select("chi_square", "dof", "num_records", p.alias("p_value"))
