"""Tunable parameters, one frozen dataclass per stage."""

from __future__ import annotations

from dataclasses import dataclass, field

# Default column candidates, thresholds, event windows and sizes.
TEXT_COLUMNS = ("prompt", "user_prompt", "text", "conversation", "instruction", "message")
TIMESTAMP_COLUMNS = ("timestamp", "created_at", "date", "time")
CONVERSATION_COLUMNS = ("conversation_id", "conv_id", "session_id", "chat_id")
TURN_COLUMNS = ("turn_index", "turn", "message_index", "index")
LANGUAGE_COLUMNS = ("language", "lang")


@dataclass(frozen=True)
class LanguageFilter:
    enabled: bool = False
    include: tuple[str, ...] = ("en", "English")


@dataclass(frozen=True)
class CanonicalSettings:
    text_columns: tuple[str, ...] = TEXT_COLUMNS
    timestamp_columns: tuple[str, ...] = TIMESTAMP_COLUMNS
    conversation_columns: tuple[str, ...] = CONVERSATION_COLUMNS
    turn_columns: tuple[str, ...] = TURN_COLUMNS
    language_columns: tuple[str, ...] = LANGUAGE_COLUMNS
    timestamp_unit: str = "ns"
    min_prompt_chars: int = 3
    min_prompt_words: int = 2
    remove_short_prompts: bool = True
    flag_long_prompts: bool = True
    long_prompt_quantile: float = 0.99
    remove_long_prompts: bool = False
    drop_duplicates: bool = True
    language_filter: LanguageFilter = field(default_factory=LanguageFilter)


@dataclass(frozen=True)
class SplitSettings:
    enabled: bool = True
    train: float = 0.7
    validation: float = 0.15
    test: float = 0.15


@dataclass(frozen=True)
class ModelSettings:
    """Opt-in model labels; ``max_records`` limits how many rows are scored (by record id)."""

    enabled: bool = False
    model_name: str | None = None
    batch_size: int = 16
    max_records: int | None = None


@dataclass(frozen=True)
class ClassifySettings:
    """``normalized_text`` says that the text has single spaces already (the canonical table)."""

    text_column: str = "prompt_text"
    id_column: str = "record_id"
    score_threshold: float = 0.35
    normalized_text: bool = False
    method: str = "rule_based_behavioral_taxonomy"
    emotion_model: ModelSettings = field(default_factory=ModelSettings)
    behavior_model: ModelSettings = field(default_factory=lambda: ModelSettings(batch_size=8))


@dataclass(frozen=True)
class EventWindow:
    name: str
    date: str
    days_before: int = 30
    days_after: int = 30


DEFAULT_EVENTS = (
    EventWindow("gpt4_release", "2023-03-14"),
    EventWindow("chatgpt_ios_release", "2023-05-18"),
)


@dataclass(frozen=True)
class AnalyticsSettings:
    id_column: str = "record_id"
    conversation_column: str = "conversation_id"
    time_column: str = "year_month"
    turn_column: str = "turn_index"
    rolling_window: int = 3
    n_archetypes: int = 8
    min_conversation_records: int = 2
    seed: int = 42
    events: tuple[EventWindow, ...] = DEFAULT_EVENTS


@dataclass(frozen=True)
class ClusterSettings:
    sample_size: int | None = None
    min_cluster_size: int = 50
    min_samples: int = 10
    kmeans_k: tuple[int, ...] = (20, 50)
    seed: int = 42
