"""Column resolution and the names of the canonical prompt table."""

from __future__ import annotations

from collections.abc import Iterable

# The canonical prompt table, in order.
CANONICAL_COLUMNS = (
    "prompt_text", "raw_text_hash", "record_id", "conversation_id", "turn_index", "timestamp",
    "date", "year", "month", "year_month", "source_dataset", "prompt_length", "prompt_word_count",
    "language_original", "language_detected", "language", "has_question", "contains_code",
    "is_short_prompt", "is_length_outlier", "complexity_score", "disclosure_score",
    "dependency_score", "interaction_type", "semantic_cluster", "emotion_scores", "cleaned_at",
)
LABEL_COLUMNS = ("interaction_mode", "cognitive_outsourcing_type", "emotion_primary")
FLAG_COLUMNS = (
    "is_companionship", "is_vulnerable", "is_dependency_signal", "is_cognitive_outsourcing",
    "is_reassurance_seeking", "is_anthropomorphic", "is_self_disclosure",
)


def first_existing(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    """First candidate that is a column, else None."""
    present = set(columns)
    for name in candidates:
        if name in present:
            return name
    return None


def require_one_of(columns: Iterable[str], candidates: Iterable[str], purpose: str) -> str:
    """Like :func:`first_existing`, but missing is an error that lists the candidates."""
    candidates = tuple(candidates)
    found = first_existing(columns, candidates)
    if found is None:
        raise ValueError(f"no column for {purpose}; looked for {', '.join(candidates)}")
    return found


def require_columns(columns: Iterable[str], needed: Iterable[str], purpose: str) -> None:
    missing = sorted(set(needed) - set(columns))
    if missing:
        raise ValueError(f"{purpose} needs columns {', '.join(missing)}")
