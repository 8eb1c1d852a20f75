"""Rule-based behaviour labels, composite scores, flags and complexity metrics per prompt.

Everything is a narrow projection: no shuffle, no Python in the row path.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text
from colloquy.functions.planning import select_once
from colloquy.functions.stats import bounded, round_half_even
from colloquy.operators.models import add_behavior_labels, add_emotion_labels
from colloquy.operators.taxonomy import (
    Taxonomy, add_matched_keywords, default_taxonomy, lexical_form, section_scores,
)
from colloquy.schema import FLAG_COLUMNS, require_columns
from colloquy.settings import ClassifySettings

RULE_COLUMNS = (
    "interaction_mode", "interaction_mode_score", "cognitive_outsourcing_type",
    "cognitive_outsourcing_score", "emotion_primary", "emotion_score", "companionship_score",
    "vulnerability_score", "dependency_score", "reassurance_seeking_score",
    "anthropomorphism_score", "self_disclosure_score", *FLAG_COLUMNS,
)


def _score_of(taxonomy: Taxonomy, section: str, column: str, label: str) -> str:
    """SQL for the score of one label; labels the taxonomy lacks score 0."""
    names = [entry.name for entry in taxonomy[section]]
    return f"get({column}, {names.index(label)}).score" if label in names else "0.0D"


def _label(pick: str, fallback: str) -> str:
    return f"if({pick}.score > 0, {pick}.label, '{fallback}')"


def add_rule_columns(
    df: DataFrame, taxonomy: Taxonomy | None = None, text_column: str = "prompt_text",
    threshold: float = 0.35, normalized: bool = False,
) -> DataFrame:
    """Add the label, score and flag columns named in ``RULE_COLUMNS``.

    The winning label has the highest score; among equals the lexicographically largest, which is
    the order of a (score, label) struct. ``normalized`` says that the text column already has
    single spaces, as in the canonical table.
    """
    require_columns(df.columns, [text_column], "classification")
    spec = taxonomy or default_taxonomy()
    sections = {
        "_modes": "interaction_modes", "_tasks": "cognitive_outsourcing",
        "_emotions": "emotional_signals", "_signals": "composite_signals",
    }
    lexical = df.withColumn("_lexical", lexical_form(F.col(text_column), normalized))
    scored = add_matched_keywords(lexical, "_lexical", spec).withColumns(
        {column: section_scores(F.col("_matched"), spec[section]) for column, section in sections.items()}
    )

    def score(column: str, label: str) -> str:
        return _score_of(spec, sections[column], column, label)

    untouched = [f"`{name}`" for name in df.columns if name not in RULE_COLUMNS]
    picked = scored.selectExpr(
        *untouched, *sections,
        "array_max(_modes) AS _mode", "array_max(_tasks) AS _task", "array_max(_emotions) AS _emotion",
    )
    mean_fear_sadness = f"({score('_emotions', 'fear')} + {score('_emotions', 'sadness')}) / 2"
    first = picked.selectExpr(
        *untouched,
        f"{_label('_mode', 'assistant_mode')} AS interaction_mode",
        "_mode.score AS interaction_mode_score",
        f"{_label('_task', 'none')} AS cognitive_outsourcing_type",
        "_task.score AS cognitive_outsourcing_score",
        f"{_label('_emotion', 'none')} AS emotion_primary",
        "_emotion.score AS emotion_score",
        f"""greatest({score('_signals', 'companionship')}, {score('_modes', 'companion_mode')},
            {score('_emotions', 'loneliness')}, {score('_emotions', 'affection')}) AS companionship_score""",
        f"""greatest({score('_signals', 'vulnerability')}, {score('_modes', 'therapist_surrogate_mode')},
            {score('_emotions', 'vulnerability')}, least(1.0D, {mean_fear_sadness})) AS vulnerability_score""",
        f"greatest({score('_signals', 'dependency')}, {score('_emotions', 'dependency')}) AS _dependency",
        f"{score('_signals', 'reassurance_seeking')} AS reassurance_seeking_score",
        f"{score('_signals', 'anthropomorphism')} AS anthropomorphism_score",
        f"{score('_signals', 'self_disclosure')} AS _disclosure",
    )
    second = first.selectExpr(
        "*",
        "greatest(_dependency, least(1.0D, (companionship_score + vulnerability_score) / 2)) AS dependency_score",
        "greatest(_disclosure, vulnerability_score) AS self_disclosure_score",
    )
    sources = (
        "companionship_score", "vulnerability_score", "dependency_score", "cognitive_outsourcing_score",
        "reassurance_seeking_score", "anthropomorphism_score", "self_disclosure_score",
    )
    flags = [
        f"{source} >= {float(threshold)!r}D AS {flag}" for flag, source in zip(FLAG_COLUMNS, sources, strict=True)
    ]
    ordered = [name for name in RULE_COLUMNS if name not in FLAG_COLUMNS]
    flagged = second.selectExpr(*untouched, *ordered, *flags)
    return select_once(flagged, [n for n in df.columns if n not in RULE_COLUMNS], list(RULE_COLUMNS))


def add_complexity_metrics(
    df: DataFrame, text_column: str = "prompt_text", normalized: bool = False
) -> DataFrame:
    """Sentence, diversity, instruction, role and recursion metrics with two combined scores."""
    prepared = df.withColumn("_raw", text.text_or_empty(F.col(text_column)))
    prepared = prepared.withColumn("_tokens", text.words(lexical_form(F.col("_raw"), normalized)))
    tokens, source = F.col("_tokens"), F.col("_raw")
    measures = {
        "_words": F.size(tokens),
        "_chars": F.char_length(source),
        "sentence_count": text.sentence_count(source),
        "lexical_diversity": round_half_even(text.lexical_diversity(tokens), 3),
        "instruction_specificity_score": F.least(
            text.phrase_count(source, text.INSTRUCTION_PHRASES) / 4, F.lit(1.0)
        ),
        "role_prompting_score": text.has_phrase(source, text.ROLE_PHRASES).cast("double"),
        "recursive_interaction_score": F.least(
            text.phrase_count(source, text.RECURSION_PHRASES) / 3, F.lit(1.0)
        ),
    }
    untouched = [name for name in df.columns if name not in measures]
    prepared = select_once(prepared, untouched, measures)
    disclosure = F.col("self_disclosure_score") if "self_disclosure_score" in df.columns else F.lit(0.0)
    sophistication = bounded(
        F.least(F.col("_chars") / 1500, F.lit(1.0)) * 0.25
        + F.least(F.col("_words") / 250, F.lit(1.0)) * 0.25
        + F.col("lexical_diversity") * 0.15
        + F.col("instruction_specificity_score") * 0.15
        + F.col("role_prompting_score") * 0.1
        + F.col("recursive_interaction_score") * 0.1
    )
    return (
        prepared.withColumn(
            "avg_words_per_sentence", round_half_even(F.col("_words") / F.col("sentence_count"), 3)
        )
        .withColumn("prompt_sophistication_score", sophistication)
        .withColumn(
            "conversational_depth_score",
            bounded(
                F.col("recursive_interaction_score") * 0.35 + disclosure * 0.35
                + F.col("prompt_sophistication_score") * 0.3
            ),
        )
        .drop("_words", "_chars")
    )


def classify_prompts(
    df: DataFrame, taxonomy: Taxonomy | None = None, settings: ClassifySettings = ClassifySettings(),
    emotion_predictor=None, behavior_predictor=None, classified_at: str | None = None,
) -> DataFrame:
    """All classification columns: rules, complexity, optional model labels, run stamp."""
    spec = taxonomy or default_taxonomy()
    tidy = settings.normalized_text
    ruled = add_rule_columns(df, spec, settings.text_column, settings.score_threshold, tidy)
    ruled = ruled.withColumns(
        {"interaction_type": F.col("interaction_mode"), "disclosure_score": F.col("vulnerability_score")}
    )
    measured = add_complexity_metrics(ruled, settings.text_column, tidy)
    modelled = add_emotion_labels(measured, settings, emotion_predictor)
    modelled = add_behavior_labels(modelled, spec, settings, behavior_predictor)
    stamp = classified_at or datetime.now(UTC).isoformat()
    return modelled.withColumn("classified_at", F.lit(stamp))
