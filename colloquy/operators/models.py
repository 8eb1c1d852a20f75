"""Optional model labels: batched inference through an Arrow iterator UDF with a plug-in predictor.

A *predictor factory* is called once per Python worker and returns a function from a list of texts
to one ``[(label, score), ...]`` list per text. The model itself is the user's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.taxonomy import Label, Taxonomy
from colloquy.settings import ClassifySettings, ModelSettings

Predictor = Callable[[list[str]], list[list[tuple[str, float]]]]
PredictorFactory = Callable[[], Predictor]
ZeroShotFactory = Callable[[list[str]], Predictor]

BEST = "struct<label:string, score:double>"


def best_label(factory: PredictorFactory, batch_size: int):
    """UDF from text to the highest-scoring (label, score); null text gives null."""

    @F.pandas_udf(BEST)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = factory()
        for texts in batches:
            known = texts[texts.notna()]
            found: list[tuple[str | None, float | None]] = []
            for start in range(0, len(known), batch_size):
                for scores in predictor(known.iloc[start : start + batch_size].tolist()):
                    found.append(max(scores, key=lambda pair: pair[1]) if scores else ("none", 0.0))
            best = pd.DataFrame(found, columns=["label", "score"], index=known.index)
            yield best.reindex(texts.index)

    return predict


def _scored_rows(df: DataFrame, text_column: str, id_column: str, model: ModelSettings) -> DataFrame:
    """Add ``_input``: the text, or null beyond the first ``max_records`` rows by id.

    The cut-off is the id of the last scored row, found by a top-k; ids are assumed unique.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    if model.max_records is None:
        return df.withColumn("_input", text)
    first = df.select(id_column).orderBy(id_column).limit(int(model.max_records))
    cutoff = first.agg(F.max(id_column).alias("cutoff")).scalar()
    return df.withColumn("_input", F.when(F.col(id_column) <= cutoff, text))


def add_emotion_labels(
    df: DataFrame, settings: ClassifySettings, factory: PredictorFactory | None = None
) -> DataFrame:
    """``transformer_emotion_{label,score,model}``; nulls unless the model is enabled."""
    model = settings.emotion_model
    if not model.enabled:
        return df.withColumns(
            {
                "transformer_emotion_label": F.lit(None).cast("string"),
                "transformer_emotion_score": F.lit(None).cast("double"),
                "transformer_emotion_model": F.lit(None).cast("string"),
            }
        )
    if factory is None:
        raise ValueError("the emotion model is enabled but no predictor was given")
    rows = _scored_rows(df, settings.text_column, settings.id_column, model)
    rows = rows.withColumn("_best", best_label(factory, model.batch_size)(F.col("_input")))
    return rows.withColumns(
        {
            "transformer_emotion_label": F.col("_best.label"),
            "transformer_emotion_score": F.col("_best.score"),
            "transformer_emotion_model": F.lit(model.model_name),
        }
    ).drop("_input", "_best")


def candidate_texts(labels: tuple[Label, ...]) -> dict[str, str]:
    """Text shown to the model -> label name."""
    return {label.candidate_text: label.name for label in labels}


def add_behavior_labels(
    df: DataFrame, taxonomy: Taxonomy, settings: ClassifySettings, factory: ZeroShotFactory | None = None
) -> DataFrame:
    """Zero-shot mode and task labels; nulls unless enabled. Texts are mapped back to label names."""
    model = settings.behavior_model
    targets = {
        ("transformer_interaction_mode", "transformer_interaction_score"): "interaction_modes",
        ("transformer_cognitive_outsourcing_type", "transformer_cognitive_outsourcing_score"):
            "cognitive_outsourcing",
    }
    if not model.enabled:
        nulls = {}
        for label_column, score_column in targets:
            nulls[label_column] = F.lit(None).cast("string")
            nulls[score_column] = F.lit(None).cast("double")
        return df.withColumns({**nulls, "transformer_behavior_model": F.lit(None).cast("string")})
    if factory is None:
        raise ValueError("the behavior model is enabled but no predictor was given")
    rows = _scored_rows(df, settings.text_column, settings.id_column, model)
    for (label_column, score_column), section in targets.items():
        names = candidate_texts(taxonomy[section])
        back = F.create_map(*[F.lit(part) for pair in names.items() for part in pair])
        predict = best_label(_bind(factory, list(names)), model.batch_size)
        rows = rows.withColumn("_best", predict(F.col("_input"))).withColumns(
            {
                label_column: F.coalesce(F.try_element_at(back, F.col("_best.label")), F.col("_best.label")),
                score_column: F.col("_best.score"),
            }
        )
    scored = F.col("_input").isNotNull()
    return rows.withColumn(
        "transformer_behavior_model", F.when(scored, F.lit(model.model_name))
    ).drop("_input", "_best")


def _bind(factory: ZeroShotFactory, candidates: list[str]) -> PredictorFactory:
    return lambda: factory(candidates)
