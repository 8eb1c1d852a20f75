"""Canonical prompts to classified prompts and their diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.operators import diagnostics, evaluation
from colloquy.operators.classify import classify_prompts
from colloquy.operators.taxonomy import Taxonomy, default_taxonomy
from colloquy.session import use_utc
from colloquy.settings import ClassifySettings
from colloquy.sources.files import load_prompts, read_dataset, write_dataset
from colloquy.sources.runlog import RunClock, append_record, run_record

TRENDS = {
    "emotional_trends": diagnostics.emotional_trend,
    "cognitive_outsourcing_trends": diagnostics.outsourcing_trend,
    "dependency_trends": diagnostics.dependency_trend,
    "conversational_complexity_trends": diagnostics.complexity_trend,
}


def diagnostic_tables(classified: DataFrame) -> dict[str, DataFrame]:
    """Every report over a classified table, lazily; each reads only its own columns."""
    tables = {
        "classification_summary": diagnostics.summarize_classification(classified),
        "taxonomy_coverage": diagnostics.taxonomy_coverage(classified),
        "behavioral_overlap": diagnostics.behavioral_overlap(classified),
        "unstable_regions": diagnostics.unstable_regions(classified),
    }
    if "year_month" in classified.columns:
        tables.update({name: build(classified) for name, build in TRENDS.items()})
    return tables


def evaluation_tables(classified: DataFrame, labels: DataFrame | None, id_column: str) -> dict[str, DataFrame]:
    if labels is None:
        return {"unlabeled_evaluation": diagnostics.unlabeled_evaluation(classified)}
    counts = evaluation.match_labels(classified, labels, id_column)
    return {
        "confusion_matrix": evaluation.confusion_matrix(counts),
        "label_report": evaluation.label_report(counts),
        "evaluation": evaluation.evaluation_metrics(counts),
        "evaluation_rows": evaluation.match_sizes(classified, labels, id_column),
    }


def run_classification(
    spark: SparkSession, input_path: str, output_path: str, reports_folder: str,
    taxonomy: Taxonomy | None = None, settings: ClassifySettings = ClassifySettings(),
    labels_path: str | None = None, max_records: int | None = None, record_path: str | None = None,
    emotion_predictor=None, behavior_predictor=None,
) -> DataFrame:
    """Classify once, write, and compute the reports from the written table."""
    use_utc(spark)
    clock = RunClock()
    spec = taxonomy or default_taxonomy()
    prompts = load_prompts(
        read_dataset(spark, input_path), (settings.id_column, settings.text_column), limit=max_records
    )
    write_dataset(
        classify_prompts(prompts, spec, settings, emotion_predictor, behavior_predictor), output_path
    )
    classified = read_dataset(spark, output_path)
    labels = read_dataset(spark, labels_path) if labels_path else None
    tables = diagnostic_tables(classified)
    tables.update(evaluation_tables(classified, labels, settings.id_column))
    for name, table in tables.items():
        write_dataset(table, f"{reports_folder}/{name}.parquet")
    record = run_record(
        classified, settings.method, classified.count(), clock.seconds(), input_path=input_path,
        output_path=output_path, score_threshold=settings.score_threshold,
        labels={section: [label.name for label in entries] for section, entries in spec.items()},
        reports=sorted(tables),
    )
    if record_path:
        append_record(record, record_path)
    return record
