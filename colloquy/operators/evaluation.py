"""Evaluation of predicted labels against a labelled table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.stats import safe_ratio
from colloquy.schema import require_columns

# Predicted columns and the labels they are held against.
DEFAULT_TARGETS = {
    name: name
    for name in (
        "interaction_mode", "cognitive_outsourcing_type", "emotion_primary", "is_companionship",
        "is_vulnerable", "is_dependency_signal", "is_cognitive_outsourcing",
    )
}


def match_labels(
    predictions: DataFrame, labels: DataFrame, id_column: str, targets: dict[str, str] | None = None
) -> DataFrame:
    """``target, true_label, predicted_label, n`` over all targets both tables have.

    Both sides are cut to the id and the targets, joined once, and counted; a pair with a missing
    value does not count for its target.
    """
    require_columns(predictions.columns, [id_column], "evaluation")
    require_columns(labels.columns, [id_column], "evaluation")
    used = {
        p: t for p, t in (targets or DEFAULT_TARGETS).items()
        if p in predictions.columns and t in labels.columns
    }
    if not used:
        raise ValueError("predictions and labels share no target")
    left = predictions.select(id_column, *[F.col(p).cast("string").alias(f"_p{i}") for i, p in enumerate(used)])
    right = labels.select(id_column, *[F.col(t).cast("string").alias(f"_t{i}") for i, t in enumerate(used.values())])
    pairs = F.array(
        *[
            F.struct(F.lit(p).alias("target"), F.col(f"_t{i}").alias("true_label"),
                     F.col(f"_p{i}").alias("predicted_label"))
            for i, p in enumerate(used)
        ]
    )
    combos = left.join(right, id_column).drop(id_column)
    combos = combos.groupBy(*combos.columns).agg(F.count(F.lit(1)).alias("_n"))
    rows = combos.select("_n", F.explode(pairs).alias("_e")).select("_n", "_e.*")
    return (
        rows.filter(F.col("true_label").isNotNull() & F.col("predicted_label").isNotNull())
        .groupBy("target", "true_label", "predicted_label")
        .agg(F.sum("_n").alias("n"))
    )


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """The full matrix per target: every true × predicted label, empty cells included as 0."""
    labels = F.array_sort(
        F.collect_set(F.col("label"))
    )
    both = counts.select("target", F.explode(F.array("true_label", "predicted_label")).alias("label"))
    universe = both.groupBy("target").agg(labels.alias("labels"))
    cells = universe.select("target", "labels", F.explode("labels").alias("true_label")).select(
        "target", "true_label", F.explode("labels").alias("predicted_label")
    )
    return cells.join(counts, ["target", "true_label", "predicted_label"], "left").select(
        "target", "true_label", "predicted_label", F.coalesce("n", F.lit(0)).alias("n")
    )


def label_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per target and label; undefined ratios are 0."""
    sides = counts.select(
        "target", "n",
        F.explode(
            F.array(
                F.struct(F.col("true_label").alias("label"), F.lit(1).alias("is_true"), F.lit(0).alias("is_pred")),
                F.struct(F.col("predicted_label").alias("label"), F.lit(0).alias("is_true"), F.lit(1).alias("is_pred")),
            )
        ).alias("_s"),
        (F.col("true_label") == F.col("predicted_label")).cast("int").alias("_hit"),
    )
    totals = sides.groupBy("target", F.col("_s.label").alias("label")).agg(
        F.sum(F.col("n") * F.col("_s.is_true")).alias("support"),
        F.sum(F.col("n") * F.col("_s.is_pred")).alias("predicted"),
        F.sum(F.col("n") * F.col("_s.is_true") * F.col("_hit")).alias("correct"),
    )
    return totals.select(
        "target", "label",
        safe_ratio(F.col("correct"), F.col("predicted")).alias("precision"),
        safe_ratio(F.col("correct"), F.col("support")).alias("recall"),
        safe_ratio(F.col("correct") * 2, F.col("predicted") + F.col("support")).alias("f1"),
        "support", "correct",
    )


def evaluation_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted averages per target over the union of labels."""
    report = label_report(counts)

    def weighted(name: str):
        return safe_ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))

    return report.groupBy("target").agg(
        F.sum("support").alias("num_rows"),
        safe_ratio(F.sum("correct"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"),
    )


def match_sizes(predictions: DataFrame, labels: DataFrame, id_column: str) -> DataFrame:
    """Row counts of both tables and of their match, as one row, from per-id counts."""
    left = predictions.groupBy(id_column).agg(F.count(F.lit(1)).alias("_p"))
    right = labels.groupBy(id_column).agg(F.count(F.lit(1)).alias("_l"))
    return left.join(right, id_column, "full_outer").agg(
        F.coalesce(F.sum("_p"), F.lit(0)).alias("num_prediction_rows"),
        F.coalesce(F.sum("_l"), F.lit(0)).alias("num_label_rows"),
        F.coalesce(F.sum(F.col("_p") * F.col("_l")), F.lit(0)).alias("num_matched_rows"),
    )
