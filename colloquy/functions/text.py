"""Text expressions: normalization, counts, flags and bounded complexity scores.

Every function takes and returns a ``Column`` and stays inside the JVM. Word boundaries are written
as look-arounds over letters, numbers and underscore, which does not depend on what the running JDK
takes ``\\b`` and ``\\w`` to mean.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
WORD_START = rf"(?<!{WORD})"
WORD_END = rf"(?!{WORD})"
FOLDING_LETTERS = "[\u017f\u212a\u0130\u0131]"

# Word lists and patterns behind the text flags.
QUESTION_WORDS = (
    "what", "why", "how", "when", "where", "who", "which", "can", "could", "would", "should",
    "is", "are", "do", "does",
)
CODE_ALTERNATIVES = (
    r"```", r"def\s+\w+\(", r"class\s+\w+", r"import\s+\w+", r"from\s+\w+\s+import",
    r"function\s+\w+\(", r"print\s*\(", r"console\.log", r"SELECT\s+.+\s+FROM",
)
CODE_FRAGMENTS = ("```", "def", "class", "import", "function", "print", "console.log", "select")
COMMON_ENGLISH_WORDS = (
    "a", "an", "and", "are", "can", "do", "for", "how", "i", "in", "is", "it", "me", "my", "of",
    "on", "please", "the", "to", "what", "with", "you",
)
ROLE_PHRASES = ("act as", "you are", "pretend to be", "roleplay as")
INSTRUCTION_PHRASES = (
    "step by step", "format as", "do not", "make sure", "include", "avoid", "use a", "write in",
)
RECURSION_PHRASES = (
    "previous", "above", "again", "continue", "revise", "rewrite", "follow up", "as before",
    "same as",
)
LENGTH_BINS = (
    (10, "Very Short (≤10)"), (30, "Short (11-30)"), (100, "Medium (31-100)"),
    (None, "Long (>100)"),
)
CONVERSATION_BINS = (
    (1, "Single-turn"), (3, "Short (2-3 turns)"), (10, "Medium (4-10 turns)"),
    (None, "Long (>10 turns)"),
)


def any_word(words: tuple[str, ...], boundary: str) -> str:
    """Regex for lower-cased text: one of the words between characters outside ``boundary``.

    The look-ahead on the first letters comes first, so most positions fail on one comparison.
    """
    initials = "".join(sorted({word[0] for word in words}))
    return f"(?=[{initials}])(?<!{boundary})(?:{'|'.join(words)})(?!{boundary})"


def whole_phrases(phrases: tuple[str, ...]) -> str:
    """Case-insensitive regex that finds any of the phrases between word boundaries."""
    return f"(?iu){WORD_START}(?:{'|'.join(phrases)}){WORD_END}"


def code_pattern() -> str:
    body = "|".join(CODE_ALTERNATIVES).replace(r"\s", SPACE).replace(r"\w", WORD)
    return f"(?isu)(?:{body})"


def may_hold(text: Column, fragments: tuple[str, ...]) -> Column:
    """Cheap necessary condition for a case-insensitive match of a pattern with these fragments.

    A plain search in the lower-cased text costs far less than a case-insensitive one with word
    boundaries. Letters outside ASCII that fold to an ASCII letter survive lower-casing, so a text
    with one of them passes.
    """
    initials = "".join(sorted({fragment[0] for fragment in fragments}))
    literals = "|".join(fragment.replace(".", r"\.") for fragment in fragments)
    folded = F.when(F.octet_length(text) == F.char_length(text), False).otherwise(text.rlike(FOLDING_LETTERS))
    return F.lower(text).rlike(f"(?=[{initials}])(?:{literals})") | folded


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def normalize_whitespace(text: Column) -> Column:
    """Collapse Unicode whitespace runs to one space and trim; null becomes the empty string."""
    return F.trim(F.regexp_replace(text_or_empty(text), f"{SPACE}+", " "))


def word_count(normalized: Column) -> Column:
    """Number of space-separated tokens of whitespace-normalized text."""
    return F.when(normalized == "", F.lit(0)).otherwise(F.size(F.split(normalized, " "))).cast("long")


def char_count(text: Column) -> Column:
    return F.char_length(text).cast("long")


def ascii_ratio(text: Column) -> Column:
    """Share of ASCII code points; plain ASCII text is recognised by its byte length alone."""
    ascii_chars = F.char_length(F.regexp_replace(text, r"[^\x00-\x7f]+", ""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lit(1.0)).otherwise(
        ascii_chars / F.greatest(F.char_length(text), F.lit(1))
    )


def detect_language(text: Column) -> Column:
    """``en`` for mostly-ASCII text with a common English word or at most three distinct words."""
    lowered = F.lower(text)
    common = any_word(COMMON_ENGLISH_WORDS, "[a-z']")
    few_words = F.size(F.array_distinct(F.regexp_extract_all(lowered, F.lit("[a-z']+"), F.lit(0)))) <= 3
    english = (ascii_ratio(text) >= 0.85) & (lowered.rlike(common) | few_words)
    return F.when((text != "") & english, F.lit("en")).otherwise(F.lit("unknown"))


def normalize_language_label(label: Column) -> Column:
    """Blank or missing labels become ``unknown``; English spellings become ``en``."""
    lowered = F.lower(normalize_edges(label))
    return (
        F.when(lowered.isin("en", "eng", "english"), F.lit("en"))
        .when(lowered == "", F.lit("unknown"))
        .otherwise(lowered)
    )


def normalize_edges(text: Column) -> Column:
    """Strip Unicode whitespace at both ends; null becomes the empty string."""
    return F.regexp_replace(text_or_empty(text), f"^{SPACE}+|{SPACE}+$", "")


def has_question(text: Column) -> Column:
    """A question mark or one of the question words as a whole word."""
    folded = F.octet_length(text) != F.char_length(text)
    return (
        text.contains("?")
        | F.lower(text).rlike(any_word(QUESTION_WORDS, WORD))
        | F.when(folded, text.rlike(FOLDING_LETTERS) & text.rlike(whole_phrases(QUESTION_WORDS))).otherwise(False)
    )


def contains_code(text: Column) -> Column:
    return may_hold(text, CODE_FRAGMENTS) & text.rlike(code_pattern())


def complexity_proxy(length: Column, words: Column, question: Column, code: Column) -> Column:
    """Bounded length / word-count score with small bonuses for questions and code."""
    score = (
        F.least(length / 1000, F.lit(1.0)) * 0.45
        + F.least(words / 150, F.lit(1.0)) * 0.45
        + question.cast("double") * 0.1
        + code.cast("double") * 0.1
    )
    return F.least(score, F.lit(1.0))


def sentence_count(text: Column) -> Column:
    return F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1)).cast("long")


def words(normalized: Column) -> Column:
    """Tokens of whitespace-normalized text; empty text has none.

    The text is bound by an array of one, as a column that is named twice would be computed twice.
    """
    def tokens(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))

    return F.get(F.transform(F.array(normalized), tokens), F.lit(0))


def lexical_diversity(lowered_tokens: Column) -> Column:
    """Distinct over all lower-cased tokens (0 for none), unrounded."""
    return F.size(F.array_distinct(lowered_tokens)) / F.greatest(F.size(lowered_tokens), F.lit(1))


def phrase_count(text: Column, phrases: tuple[str, ...]) -> Column:
    count = F.regexp_count(text, F.lit(whole_phrases(phrases)))
    return F.when(may_hold(text, phrases), count).otherwise(F.lit(0))


def has_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    return may_hold(text, phrases) & text.rlike(whole_phrases(phrases))


def without_links(text: Column) -> Column:
    """Lower-cased text without URLs; texts that hold no beginning of one are not searched for them."""
    non_space = r"[^\x09-\x0d\x1c-\x20\x85\p{Z}]"
    lowered = F.lower(text_or_empty(text))
    no_links = F.regexp_replace(lowered, f"http{non_space}+|www{non_space}+", "")
    return F.when(lowered.contains("http") | lowered.contains("www"), no_links).otherwise(lowered)


def clean_text(text: Column) -> Column:
    """Lower-case, drop URLs, keep only ``a``-``z`` and single spaces."""
    return F.trim(F.regexp_replace(without_links(text), "[^a-z]+", " "))


def content_tokens(cleaned: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Tokens longer than two characters that are no stopwords."""
    def keep(token: Column) -> Column:
        long_enough = F.char_length(token) > 2
        return long_enough & ~token.isin(*stopwords) if stopwords else long_enough

    return F.filter(words(cleaned), keep)


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` consecutive tokens joined by a space."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def bin_label(value: Column, bins: tuple[tuple[int | None, str], ...]) -> Column:
    """Label of the first bin whose inclusive upper bound holds the value."""
    label = None
    for upper, name in bins:
        if upper is None:
            return F.lit(name) if label is None else label.otherwise(F.lit(name))
        condition = value <= upper
        label = F.when(condition, F.lit(name)) if label is None else label.when(condition, F.lit(name))
    return label


def length_category(word_total: Column) -> Column:
    return bin_label(word_total, LENGTH_BINS)


def conversation_category(prompts: Column) -> Column:
    return bin_label(prompts, CONVERSATION_BINS)


def period_bin(
    period: Column,
    early_until: str = "2023-08",
    late_from: str = "2024-01",
    labels: tuple[str, str, str] = ("Early", "Middle", "Late"),
) -> Column:
    """Early / middle / late by comparing ``yyyy-MM`` strings."""
    return (
        F.when(period <= early_until, F.lit(labels[0]))
        .when(period >= late_from, F.lit(labels[2]))
        .when(period.isNotNull(), F.lit(labels[1]))
    )
