"""Input views over the driver tables, in Spark and in SQL.

The synthetic texts hold no behaviour keywords, so prompts get one of 24 fixed phrases appended by a
rule over their keys, the same way on both sides.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.canonical import normalize_records
from colloquy.operators.classify import add_complexity_metrics, add_rule_columns
from colloquy.operators.taxonomy import default_taxonomy, normalize_keyword
from colloquy.sources.files import spread

STAMP = "2024-06-01T00:00:00+00:00"

# The phrases, in order.
PHRASES = (
    "Please debug this Python function, the script has an error.",
    "Explain step by step how do I study for the exam.",
    "Brainstorm creative story ideas and improve this outline.",
    "I feel alone and lonely, talk to me and keep me company.",
    "I have anxiety and trauma and I cannot cope, maybe therapy.",
    "Should I quit? Help me choose, list pros and cons.",
    "My partner wants a breakup, any relationship advice?",
    "Help with career goals and a daily schedule, plan my day.",
    "Remember this and summarize my notes to keep track.",
    "Reassure me, is this normal? Calm me down, I panic.",
    "I am sad, hopeless and crying tonight.",
    "I am so happy, excited and grateful.",
    "I am confused and stuck, this is unclear.",
    "I am frustrated, it is not working, I hate this.",
    "I love you, thank you for being here, I appreciate you.",
    "I need you, I depend on you, don't leave.",
    "Are you real? Do you care? I trust you, you understand me.",
    "I have never told anyone, this is personal, I am ashamed.",
    "Write an email and edit the cover letter, then proofread.",
    "Act as a tutor. Rewrite the above and do not include code.",
    "Continue as before, revise the previous draft again.",
    "ok thanks",
    "Translate and format the SQL, fix this grammar.",
    "I am scared, worried and afraid of my therapist.",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose texts are worked on row by row: small scans are spread over the cores."""
    return spread(table(spark, folder, name))


def _phrase(key: Column) -> Column:
    phrases = F.from_json(F.lit(json.dumps(PHRASES)), "array<string>")
    return F.get(phrases, F.pmod(key, F.lit(len(PHRASES))).cast("int"))


def _moment(key: Column, hours: Column) -> Column:
    day = F.make_dt_interval(F.pmod(key * 37, F.lit(240)).cast("int"), hours.cast("int"))
    return F.lit("2023-01-15").cast("timestamp") + day


def seeded_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """User turns of ``conversations`` with a phrase and a timestamp: raw prompt columns."""
    users = text_table(spark, folder, "conversations").filter(F.col("role") == "user")
    return users.select(
        F.col("conv_id").alias("conversation_id"),
        F.col("turn").alias("turn_index"),
        F.concat("text", F.lit(" "), _phrase(F.col("conv_id") * 7 + F.col("turn") * 3)).alias("prompt"),
        _moment(F.col("conv_id"), F.col("turn")).alias("timestamp"),
    )


def seeded_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as prompts: one conversation per source, a phrase and a timestamp by id."""
    return text_table(spark, folder, "documents").select(
        F.col("source").alias("conversation_id"),
        F.col("doc_id").alias("turn_index"),
        F.concat("text", F.lit(" "), _phrase(F.col("doc_id"))).alias("prompt"),
        _moment(F.col("doc_id"), F.lit(0)).alias("timestamp"),
        F.col("lang").alias("language"),
    )


def raw_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as raw prompts with their real text (exact copies included)."""
    return text_table(spark, folder, "documents").select(
        F.col("source").alias("conversation_id"),
        F.col("doc_id").alias("turn_index"),
        F.col("text").alias("prompt"),
        _moment(F.col("doc_id"), F.lit(0)).alias("timestamp"),
        F.col("lang").alias("language"),
    )


def classified(raw: DataFrame) -> DataFrame:
    canonical = normalize_records(raw, "suite", cleaned_at=STAMP)
    return add_complexity_metrics(add_rule_columns(canonical, normalized=True), normalized=True)


def classified_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return classified(seeded_prompts(spark, folder))


def classified_documents(spark: SparkSession, folder: str) -> DataFrame:
    return classified(seeded_documents(spark, folder))


# SQL side -----------------------------------------------------------------------------------------

WS = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+"
WC = r"\p{L}\p{N}_"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


SQL_PHRASES = f"phrases(i, phrase) AS (VALUES {sql_values(list(enumerate(PHRASES)))})"

SQL_SEEDED_PROMPTS = f"""{SQL_PHRASES},
raw AS (
  SELECT CAST(conv_id AS VARCHAR) AS conversation_id, turn AS turn_index,
         text || ' ' || phrase AS prompt,
         TIMESTAMP '2023-01-15' + to_days(CAST((conv_id * 37) % 240 AS INTEGER)) + to_hours(turn) AS "timestamp",
         CAST(NULL AS VARCHAR) AS lang, FALSE AS has_lang
  FROM conversations JOIN phrases ON i = (conv_id * 7 + turn * 3) % 24
  WHERE role = 'user')"""

SQL_SEEDED_DOCUMENTS = f"""{SQL_PHRASES},
raw AS (
  SELECT source AS conversation_id, doc_id AS turn_index, text || ' ' || phrase AS prompt,
         TIMESTAMP '2023-01-15' + to_days(CAST((doc_id * 37) % 240 AS INTEGER)) AS "timestamp",
         lang, TRUE AS has_lang
  FROM documents JOIN phrases ON i = doc_id % 24)"""

SQL_RAW_DOCUMENTS = """raw AS (
  SELECT source AS conversation_id, doc_id AS turn_index, text AS prompt,
         TIMESTAMP '2023-01-15' + to_days(CAST((doc_id * 37) % 240 AS INTEGER)) AS "timestamp",
         lang, TRUE AS has_lang
  FROM documents)"""

QUESTION = "what|why|how|when|where|who|which|can|could|would|should|is|are|do|does"
ENGLISH = "a|an|and|are|can|do|for|how|i|in|is|it|me|my|of|on|please|the|to|what|with|you"
CODE = (
    rf"(?is)(```|def\s+[{WC}]+\(|class\s+[{WC}]+|import\s+[{WC}]+|from\s+[{WC}]+\s+import|"
    rf"function\s+[{WC}]+\(|print\s*\(|console\.log|SELECT\s+.+\s+FROM)"
)


def sql_detect(text: str) -> str:
    return f"""CASE WHEN {text} <> ''
       AND length(regexp_replace({text}, '[^\\x00-\\x7f]', '', 'g')) / length({text}) >= 0.85
       AND (len(list_filter(regexp_extract_all(lower({text}), '[a-z'']+'),
                            lambda w: regexp_full_match(w, '{ENGLISH}'))) > 0
            OR len(list_distinct(regexp_extract_all(lower({text}), '[a-z'']+'))) <= 3)
       THEN 'en' ELSE 'unknown' END"""


# raw -> canon: the canonical columns, before filters.
SQL_CANON = f"""norm AS (
  SELECT trim(regexp_replace(coalesce(prompt, ''), '{WS}', ' ', 'g')) AS prompt_text, * EXCLUDE (prompt) FROM raw),
counted AS (
  SELECT *, sha256(prompt_text) AS raw_text_hash, CAST(length(prompt_text) AS BIGINT) AS prompt_length,
         CAST(CASE WHEN prompt_text = '' THEN 0 ELSE len(string_split(prompt_text, ' ')) END AS BIGINT) AS prompt_word_count,
         (contains(prompt_text, '?') OR regexp_matches(prompt_text, '(?i)(^|[^{WC}])({QUESTION})($|[^{WC}])')) AS has_question,
         regexp_matches(prompt_text, '{CODE}') AS contains_code,
         {sql_detect("prompt_text")} AS language_detected
  FROM norm),
canon AS (
  SELECT prompt_text, raw_text_hash, 'prompt_' || substr(raw_text_hash, 1, 16) AS record_id, conversation_id,
         turn_index, "timestamp", CAST("timestamp" AS DATE) AS "date", CAST(year("timestamp") AS INTEGER) AS "year",
         CAST(month("timestamp") AS INTEGER) AS "month", strftime("timestamp", '%Y-%m') AS year_month,
         'suite' AS source_dataset, prompt_length, prompt_word_count, lang AS language_original, language_detected,
         CASE WHEN NOT has_lang THEN language_detected
              WHEN lower(trim(coalesce(lang, ''))) IN ('en', 'eng', 'english') THEN 'en'
              WHEN trim(coalesce(lang, '')) = '' THEN 'unknown' ELSE lower(trim(lang)) END AS "language",
         has_question, contains_code, prompt_word_count < 2 AS is_short_prompt, FALSE AS is_length_outlier,
         least(1.0, 0.45 * least(1.0, prompt_length / 1000) + 0.45 * least(1.0, prompt_word_count / 150)
               + 0.1 * CAST(has_question AS INTEGER) + 0.1 * CAST(contains_code AS INTEGER)) AS complexity_score,
         CAST(0 AS DOUBLE) AS disclosure_score, CAST(0 AS DOUBLE) AS dependency_score, CAST(NULL AS VARCHAR) AS interaction_type,
         CAST(NULL AS VARCHAR) AS semantic_cluster, '{STAMP}' AS cleaned_at
  FROM counted)"""

# canon -> processed: filters, deduplication, outlier flag.
SQL_PROCESSED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY raw_text_hash ORDER BY conversation_id, turn_index) AS rn
  FROM canon WHERE prompt_length >= 3 AND NOT is_short_prompt),
kept AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1),
processed AS (
  SELECT * REPLACE (prompt_word_count > (SELECT quantile_cont(prompt_word_count, 0.99) FROM kept) AS is_length_outlier)
  FROM kept)"""

UNIT = "CAST(CAST('0x' || substr(sha256({key}), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0"


def sql_split(key: str) -> str:
    unit = UNIT.format(key=key)
    return f"CASE WHEN {unit} < 0.7 THEN 'train' WHEN {unit} < 0.7 + 0.15 THEN 'validation' ELSE 'test' END"


def _keyword_rows() -> list[tuple]:
    return [
        (section, label.name, normalize_keyword(k), label.denominator)
        for section, labels in default_taxonomy().items() for label in labels for k in label.keywords
    ]


SQL_KEYWORDS = f"kw(section, label, keyword, den) AS (VALUES {sql_values(_keyword_rows())})"


def _doubled(pattern: str) -> str:
    """Phrase pattern over text whose separators are doubled, so that neighbours can share none."""
    return rf"(?i)(?:^|[^{WC}])(?:{pattern.replace(' ', '  ')})(?:$|[^{WC}])"


INSTRUCTION = "step by step|format as|do not|make sure|include|avoid|use a|write in"
ROLE = "act as|you are|pretend to be|roleplay as"
RECURSION = "previous|above|again|continue|revise|rewrite|follow up|as before|same as"


def sql_bounded(expression: str) -> str:
    return f"greatest(0.0, least(1.0, {expression}))"


# canon -> complexity: text metrics per (conversation_id, turn_index).
SQL_COMPLEXITY = rf"""doubled AS (
  SELECT *, regexp_replace(prompt_text, '([^{WC}])', '\1\1', 'g') AS dbl FROM canon),
metrics AS (
  SELECT * EXCLUDE (dbl),
         CAST(greatest(len(regexp_extract_all(prompt_text, '[.!?]+')), 1) AS BIGINT) AS sentence_count,
         round_even(CASE WHEN prompt_text = '' THEN 0 ELSE len(list_distinct(string_split(lower(prompt_text), ' ')))
                    / greatest(1, prompt_word_count) END * 1000, 0) / 1000 AS lexical_diversity,
         least(1.0, len(regexp_extract_all(dbl, '{_doubled(INSTRUCTION)}')) / 4) AS instruction_specificity_score,
         CAST(CAST(regexp_matches(dbl, '{_doubled(ROLE)}') AS INTEGER) AS DOUBLE) AS role_prompting_score,
         least(1.0, len(regexp_extract_all(dbl, '{_doubled(RECURSION)}')) / 3) AS recursive_interaction_score
  FROM doubled),
complexity AS (
  SELECT *, round_even(prompt_word_count / sentence_count * 1000, 0) / 1000 AS avg_words_per_sentence,
         {sql_bounded('''least(1.0, prompt_length / 1500) * 0.25 + least(1.0, prompt_word_count / 250) * 0.25
           + lexical_diversity * 0.15 + instruction_specificity_score * 0.15 + role_prompting_score * 0.1
           + recursive_interaction_score * 0.1''')} AS prompt_sophistication_score
  FROM metrics)"""

# complexity + keywords -> classified.
SQL_CLASSIFIED = f"""{SQL_KEYWORDS},
lexed AS (
  SELECT conversation_id, turn_index, lower(prompt_text) AS low,
         ' ' || regexp_replace(lower(prompt_text), '[^{WC}]+', ' ', 'g') || ' ' AS padded FROM complexity),
scored AS (
  SELECT conversation_id, turn_index, section, label,
         CASE WHEN h = 0 THEN 0.0 ELSE least(1.0, h / den) END AS s
  FROM (SELECT conversation_id, turn_index, section, label, den,
               count_if(CASE WHEN contains(keyword, ' ') THEN contains(low, keyword)
                             WHEN keyword = 'co-write' THEN regexp_matches(low, '(^|[^{WC}])co-write($|[^{WC}])')
                             ELSE contains(padded, ' ' || keyword || ' ') END) AS h
        FROM lexed CROSS JOIN kw GROUP BY ALL) AS counted_hits),
picked AS (
  SELECT conversation_id, turn_index, section, label, s,
         row_number() OVER (PARTITION BY conversation_id, turn_index, section ORDER BY s DESC, label DESC) AS rk
  FROM scored),
wide AS (
  SELECT conversation_id, turn_index,
    max(CASE WHEN section = 'interaction_modes' AND rk = 1 THEN CASE WHEN s > 0 THEN label ELSE 'assistant_mode' END END) AS interaction_mode,
    max(CASE WHEN section = 'interaction_modes' AND rk = 1 THEN s END) AS interaction_mode_score,
    max(CASE WHEN section = 'cognitive_outsourcing' AND rk = 1 THEN CASE WHEN s > 0 THEN label ELSE 'none' END END) AS cognitive_outsourcing_type,
    max(CASE WHEN section = 'cognitive_outsourcing' AND rk = 1 THEN s END) AS cognitive_outsourcing_score,
    max(CASE WHEN section = 'emotional_signals' AND rk = 1 THEN CASE WHEN s > 0 THEN label ELSE 'none' END END) AS emotion_primary,
    max(CASE WHEN section = 'emotional_signals' AND rk = 1 THEN s END) AS emotion_score,
    max(CASE WHEN section = 'interaction_modes' AND label = 'companion_mode' THEN s END) AS m_companion,
    max(CASE WHEN section = 'interaction_modes' AND label = 'therapist_surrogate_mode' THEN s END) AS m_therapist,
    max(CASE WHEN section = 'emotional_signals' AND label = 'loneliness' THEN s END) AS e_lonely,
    max(CASE WHEN section = 'emotional_signals' AND label = 'affection' THEN s END) AS e_affection,
    max(CASE WHEN section = 'emotional_signals' AND label = 'vulnerability' THEN s END) AS e_vulnerable,
    max(CASE WHEN section = 'emotional_signals' AND label = 'dependency' THEN s END) AS e_dependency,
    max(CASE WHEN section = 'emotional_signals' AND label = 'fear' THEN s END) AS e_fear,
    max(CASE WHEN section = 'emotional_signals' AND label = 'sadness' THEN s END) AS e_sad,
    max(CASE WHEN section = 'composite_signals' AND label = 'companionship' THEN s END) AS c_companion,
    max(CASE WHEN section = 'composite_signals' AND label = 'vulnerability' THEN s END) AS c_vulnerable,
    max(CASE WHEN section = 'composite_signals' AND label = 'dependency' THEN s END) AS c_dependency,
    max(CASE WHEN section = 'composite_signals' AND label = 'reassurance_seeking' THEN s END) AS reassurance_seeking_score,
    max(CASE WHEN section = 'composite_signals' AND label = 'anthropomorphism' THEN s END) AS anthropomorphism_score,
    max(CASE WHEN section = 'composite_signals' AND label = 'self_disclosure' THEN s END) AS c_disclosure
  FROM picked GROUP BY ALL),
composed AS (
  SELECT *, greatest(c_companion, m_companion, e_lonely, e_affection) AS companionship_score,
         greatest(c_vulnerable, m_therapist, e_vulnerable, (e_fear + e_sad) / 2) AS vulnerability_score
  FROM wide),
behaviour AS (
  SELECT *, greatest(c_dependency, e_dependency, (companionship_score + vulnerability_score) / 2) AS dependency_score,
         greatest(c_disclosure, vulnerability_score) AS self_disclosure_score
  FROM composed),
classified AS (
  SELECT c.* EXCLUDE (dependency_score, disclosure_score, interaction_type),
         b.interaction_mode, b.interaction_mode_score, b.cognitive_outsourcing_type, b.cognitive_outsourcing_score,
         b.emotion_primary, b.emotion_score, b.companionship_score, b.vulnerability_score, b.dependency_score,
         b.reassurance_seeking_score, b.anthropomorphism_score, b.self_disclosure_score,
         b.companionship_score >= 0.35 AS is_companionship, b.vulnerability_score >= 0.35 AS is_vulnerable,
         b.dependency_score >= 0.35 AS is_dependency_signal,
         b.cognitive_outsourcing_score >= 0.35 AS is_cognitive_outsourcing,
         b.reassurance_seeking_score >= 0.35 AS is_reassurance_seeking,
         b.anthropomorphism_score >= 0.35 AS is_anthropomorphic, b.self_disclosure_score >= 0.35 AS is_self_disclosure,
         {sql_bounded('''c.recursive_interaction_score * 0.35 + b.self_disclosure_score * 0.35
           + c.prompt_sophistication_score * 0.3''')} AS conversational_depth_score
  FROM complexity c JOIN behaviour b USING (conversation_id, turn_index))"""


def with_prompts(body: str) -> str:
    """SQL over ``classified`` built from the seeded prompts."""
    return f"WITH {SQL_SEEDED_PROMPTS},\n{SQL_CANON},\n{SQL_COMPLEXITY},\n{SQL_CLASSIFIED}\n{body}"


def with_documents(body: str) -> str:
    """SQL over ``classified`` built from the seeded documents."""
    return f"WITH {SQL_SEEDED_DOCUMENTS},\n{SQL_CANON},\n{SQL_COMPLEXITY},\n{SQL_CLASSIFIED}\n{body}"


def with_canon(body: str) -> str:
    """SQL over ``canon`` and ``processed`` built from the documents' own text."""
    return f"WITH {SQL_RAW_DOCUMENTS},\n{SQL_CANON},\n{SQL_PROCESSED}\n{body}"


def with_metrics(body: str) -> str:
    """SQL over ``complexity`` built from the documents' own text."""
    return f"WITH {SQL_RAW_DOCUMENTS},\n{SQL_CANON},\n{SQL_COMPLEXITY}\n{body}"
