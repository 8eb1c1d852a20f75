"""Quality rules, line first: lines that fail go, and documents that lose too much text go with them.

All of it is one narrow projection of built-in functions. Nothing is shuffled.

Defined results: a missing or empty text has no words and fails; a repeated row gets the same result
again; a row without an id is judged like any other; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.planning import select_once
from colloquy.llm.common import SPACE, WORD, let, whole_text, words_of

# Symbols that prose hardly uses, and ends of sentences.
SYMBOLS = r"[#*$%&|<>]"
SENTENCE_END = r"[.!?…:;\"'”»)\]][\x20\x09-\x0D]*$"
NAVIGATION_MARK = r"[|»›·]|[\x20]>[\x20]"
# Phrases of page furniture, in lower case.
BOILERPLATE = (
    "cookie policy", "uses cookies", "accept all cookies", "privacy policy", "terms of use",
    "terms of service", "all rights reserved", "javascript is disabled", "enable javascript",
    "subscribe to our newsletter", "click here", "sign up for", "lorem ipsum", "skip to content",
    "back to top", "share this page", "powered by wordpress",
)
# Words of menus, in lower case.
MENU_WORDS = (
    "home", "about", "contact", "menu", "login", "logout", "search", "sitemap", "next", "previous",
    "register", "help", "faq", "news", "blog", "archive", "categories", "share", "print", "rss",
)


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules.

    ``min_words`` and ``max_repeat_percent`` reject a document before its lines are looked at. A line
    fails for more than ``max_symbol_percent`` of symbols or ``max_doubled_percent`` of words that end
    in doubled marks, for ``min_marks`` menu separators, for being a menu or page furniture, or, below
    ``min_line_words`` words, for ending without a sentence's end. A document that loses more than
    ``max_lost_percent`` of its characters to failing lines is rejected.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 8
    max_doubled_percent: int = 30
    min_marks: int = 3
    min_line_words: int = 4
    max_lost_percent: int = 50


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many words stand in a window of ``window`` words that the text holds at least twice.

    Windows are sorted with their positions, so that equal ones are neighbours: n log n for any text.
    """

    def windows(w: Column) -> Column:
        def at(i: Column) -> Column:
            parts = [F.get(w, i + k) for k in range(window)]
            return F.struct(F.xxhash64(*parts).alias("h"), F.concat_ws(" ", *parts).alias("s"), i.alias("p"))

        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - window), at))

    def found(ordered: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            same = lambda y: F.coalesce((y["h"] == x["h"]) & (y["s"] == x["s"]), F.lit(False))
            return same(F.get(ordered, i + 1)) | same(F.get(ordered, i - 1))

        positions = F.transform(F.filter(ordered, twice), lambda x: x["p"])
        covered = F.flatten(F.transform(positions, lambda p: F.array(*[p + k for k in range(window)])))
        return F.size(F.array_distinct(covered))

    counted = let(words, lambda w: F.when(F.size(w) > window, let(windows(w), found)).otherwise(F.lit(0)))
    return counted.cast("long")


def failing_line(line: Column, rules: QualityRules) -> Column:
    """Whether a line that has a word fails the punctuation, navigation or boilerplate rule."""
    n_words = F.regexp_count(line, F.lit(WORD))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    doubled = F.regexp_count(line, F.lit(r"[!?#*$%&]{2}"))
    punctuation = (
        (symbols * 100 > F.length(line) * rules.max_symbol_percent)
        | (doubled * 100 > n_words * rules.max_doubled_percent)
        | ((n_words < rules.min_line_words) & ~line.rlike(SENTENCE_END))
    )
    menu = rf"^[{SPACE}]*(?:(?:{'|'.join(MENU_WORDS)})(?:[{SPACE}]+|$))+$"
    navigation = (F.regexp_count(line, F.lit(NAVIGATION_MARK)) >= rules.min_marks) | F.lower(line).rlike(menu)
    boilerplate = F.lower(line).rlike("|".join(BOILERPLATE))
    return punctuation | navigation | boilerplate


def quality(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per row: counts, ``base_failed``, ``kept`` and ``clean_text`` without failing lines."""
    text = F.col("_text")
    source = df.select(F.col(f"`{id_column}`").alias(id_column), whole_text(text_column).alias("_text"))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    judged = let(
        lines,
        lambda all_lines: let(
            F.filter(all_lines, lambda line: ~failing_line(line, rules)),
            lambda good: F.struct(
                F.size(all_lines).cast("long").alias("n_lines"),
                (F.size(all_lines) - F.size(good)).cast("long").alias("n_failing_lines"),
                (F.size(all_lines) - F.size(F.array_distinct(all_lines))).cast("long").alias("n_dup_lines"),
                F.length(F.array_join(all_lines, "")).cast("long").alias("line_chars"),
                (F.length(F.array_join(all_lines, "")) - F.length(F.array_join(good, ""))).cast("long")
                .alias("lost_chars"),
                F.array_join(good, "\n").alias("good_text"),
            ),
        ),
    )
    counted = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    facts = select_once(source, [id_column, "_text"], {"_counts": counted, "_lines": judged})
    n_words, repeats = F.col("_counts.n_words"), F.col("_counts.n_repeat_words")
    base_failed = (n_words < rules.min_words) | (repeats * 100 > n_words * rules.max_repeat_percent)
    lost = F.col("_lines.lost_chars") * 100 > F.col("_lines.line_chars") * rules.max_lost_percent
    return facts.select(
        id_column, n_words.alias("n_words"), F.col("_counts.word_chars"),
        (F.octet_length(text) - F.octet_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.col("_lines.n_dup_lines"), repeats.alias("n_repeat_words"), base_failed.alias("base_failed"),
        (~base_failed & ~lost).alias("kept"), F.col("_lines.n_lines"), F.col("_lines.n_failing_lines"),
        F.col("_lines.lost_chars"),
        F.when(F.col("_lines.n_failing_lines") == 0, text).otherwise(F.col("_lines.good_text")).alias("clean_text"),
    )


def quality_filter(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = "n_chars",
                   rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows that are kept, with all their columns, their failing lines taken out of the text.

    ``length_column``, if it exists, is measured again.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    judged = quality(df.select(whole.alias("_row"), F.col(f"`{text_column}`").alias("_input")), "_row", "_input", rules).filter("kept")
    columns = []
    for name in df.columns:
        if name == text_column:
            columns.append(F.col("clean_text").alias(name))
        elif name == length_column:
            columns.append(F.length("clean_text").cast(dict(df.dtypes)[name]).alias(name))
        else:
            columns.append(F.col(f"_row.`{name}`").alias(name))
    return judged.select(*columns)
