"""Queries over labels, scores, diagnostics and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import diagnostics, evaluation
from colloquy.operators.classify import RULE_COLUMNS, add_complexity_metrics
from colloquy.operators.models import add_behavior_labels, add_emotion_labels
from colloquy.operators.taxonomy import (
    add_matched_keywords, default_taxonomy, lexical_form, taxonomy_table,
)
from colloquy.operators.text_classifier import fit_text_classifier
from colloquy.schema import FLAG_COLUMNS
from colloquy.settings import ClassifySettings, ModelSettings
from suite import inputs
from suite.inputs import table, with_documents, with_metrics, with_prompts
from suite.registry import register

SCORES = tuple(c for c in RULE_COLUMNS if c.endswith("_score"))
METRICS = (
    "sentence_count", "avg_words_per_sentence", "lexical_diversity", "instruction_specificity_score",
    "role_prompting_score", "recursive_interaction_score", "prompt_sophistication_score",
)
COLUMNS = ("record_id", "conversation_id", "turn_index", "year_month", *RULE_COLUMNS, *METRICS, "conversational_depth_score")
DOUBLES = (*SCORES, *METRICS[1:], "conversational_depth_score")


@register("classify_prompts", with_prompts(f"SELECT {', '.join(COLUMNS)} FROM classified"), DOUBLES)
def _(spark, folder):
    return inputs.classified_prompts(spark, folder).select(*COLUMNS)


@register("classify_documents", with_documents(f"SELECT {', '.join(COLUMNS)} FROM classified"), DOUBLES)
def _(spark, folder):
    return inputs.classified_documents(spark, folder).select(*COLUMNS)


@register(
    "keyword_hits",
    f"""WITH {inputs.SQL_SEEDED_PROMPTS},\n{inputs.SQL_CANON},\n{inputs.SQL_COMPLEXITY},\n{inputs.SQL_CLASSIFIED}
        SELECT kw.section, kw.label, kw.keyword, count(*) AS num_prompts
        FROM lexed JOIN kw ON CASE WHEN contains(keyword, ' ') THEN contains(low, keyword)
             WHEN keyword = 'co-write' THEN regexp_matches(low, '(^|[^{inputs.WC}])co-write($|[^{inputs.WC}])')
             ELSE contains(padded, ' ' || keyword || ' ') END
        GROUP BY ALL""",
)
def _(spark, folder):
    """How many prompts hold each taxonomy keyword: matches are counted first, then named."""
    spec = default_taxonomy()
    prompts = inputs.seeded_prompts(spark, folder).select(lexical_form(F.col("prompt")).alias("_t"))
    found = add_matched_keywords(prompts, "_t", spec).select(F.explode("_matched").alias("keyword"))
    counts = found.groupBy("keyword").agg(F.count(F.lit(1)).alias("num_prompts"))
    return taxonomy_table(spark, spec).join(counts, "keyword").select("section", "label", "keyword", "num_prompts")


@register("complexity_metrics", with_metrics(f"SELECT turn_index AS doc_id, {', '.join(METRICS)} FROM complexity"), METRICS[1:])
def _(spark, folder):
    docs = inputs.raw_documents(spark, folder).select(
        F.col("turn_index").alias("doc_id"),
        F.trim(F.regexp_replace("prompt", r"[\x09-\x0d\x1c-\x20\x85\p{Z}]+", " ")).alias("prompt_text"),
    )
    return add_complexity_metrics(docs).select("doc_id", *METRICS)


SUMMARY_SQL = " UNION ALL ".join(
    [f"SELECT '{c}' AS metric, {c} AS label, CAST(count(*) AS DOUBLE) AS \"value\" FROM classified GROUP BY {c}"
     for c in ("interaction_mode", "cognitive_outsourcing_type", "emotion_primary")]
)


def _rates_sql(flags) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS metric, 'rate' AS label, avg(CAST({f} AS INTEGER)) AS \"value\" FROM classified" for f in flags
    )


@register("classification_summary", with_prompts(f"{SUMMARY_SQL} UNION ALL {_rates_sql(FLAG_COLUMNS)}"), ("value",))
def _(spark, folder):
    return diagnostics.summarize_classification(inputs.classified_prompts(spark, folder))


@register("unlabeled_evaluation", with_documents(f"{SUMMARY_SQL} UNION ALL {_rates_sql(FLAG_COLUMNS[:4])}"), ("value",))
def _(spark, folder):
    return diagnostics.unlabeled_evaluation(inputs.classified_documents(spark, folder))


@register(
    "taxonomy_coverage",
    with_prompts(" UNION ALL ".join(
        f"SELECT '{name}' AS dimension, count(*) AS num_records, CAST(count_if({score} > 0) AS BIGINT) AS covered_records, "
        f"avg(CAST({score} > 0 AS INTEGER)) AS coverage_rate, avg({score}) AS mean_score FROM classified"
        for name, score in diagnostics.COVERAGE
    )),
    ("coverage_rate", "mean_score"),
)
def _(spark, folder):
    return diagnostics.taxonomy_coverage(inputs.classified_prompts(spark, folder))


FLAG_UNION = " UNION ALL ".join(f"SELECT rid, n, '{f}' AS flag FROM numbered WHERE {f}" for f in FLAG_COLUMNS)


@register(
    "behavioral_overlap",
    with_prompts(f"""
    , numbered AS (SELECT *, row_number() OVER () AS rid, count(*) OVER () AS n FROM classified),
    flags AS ({FLAG_UNION}),
    names(flag) AS (VALUES {", ".join(f"('{f}')" for f in FLAG_COLUMNS)}),
    pairs AS (SELECT a.flag AS l, b.flag AS r, count(*) AS c FROM flags a JOIN flags b USING (rid) GROUP BY ALL)
    SELECT x.flag AS "left", y.flag AS "right", coalesce(c, 0) AS overlap_count,
           coalesce(c, 0) / (SELECT count(*) FROM classified) AS overlap_rate
    FROM names x CROSS JOIN names y LEFT JOIN pairs ON l = x.flag AND r = y.flag""".replace("\n    , numbered", ", numbered", 1)),
    ("overlap_rate",),
)
def _(spark, folder):
    return diagnostics.behavioral_overlap(inputs.classified_prompts(spark, folder))


def _unstable_sql() -> str:
    parts = []
    for dimension, columns in diagnostics.SCORE_SETS:
        for i, c in enumerate(columns):
            parts.append(f"SELECT conversation_id, turn_index, record_id, '{dimension}' AS dimension, {i} AS pos, '{c}' AS signal, {c} AS s FROM classified")
    return f""", listed AS ({" UNION ALL ".join(parts)}),
    places AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, turn_index, dimension ORDER BY s DESC, pos) AS rk FROM listed),
    best AS (SELECT record_id, conversation_id, turn_index, dimension,
             max(CASE WHEN rk = 1 THEN signal END) AS top_signal, max(CASE WHEN rk = 2 THEN signal END) AS second_signal,
             max(CASE WHEN rk = 1 THEN s END) AS top_score, max(CASE WHEN rk = 2 THEN s END) AS second_score
             FROM places WHERE rk <= 2 GROUP BY ALL)
    SELECT record_id, dimension, top_signal, second_signal, top_score, second_score, top_score - second_score AS margin
    FROM best WHERE top_score > 0 AND top_score - second_score <= 0.08"""


@register("unstable_regions", with_prompts(_unstable_sql()), ("top_score", "second_score", "margin"))
def _(spark, folder):
    return diagnostics.unstable_regions(inputs.classified_prompts(spark, folder))


@register(
    "emotional_trends",
    with_prompts("""SELECT year_month, count(record_id) AS num_records, avg(CAST(is_vulnerable AS INTEGER)) AS vulnerability_rate,
      avg(CAST(is_dependency_signal AS INTEGER)) AS dependency_rate, avg(CAST(is_companionship AS INTEGER)) AS companionship_rate,
      avg(emotion_score) AS mean_emotion_score FROM classified WHERE year_month IS NOT NULL GROUP BY 1"""),
    ("vulnerability_rate", "dependency_rate", "companionship_rate", "mean_emotion_score"),
)
def _(spark, folder):
    return diagnostics.emotional_trend(inputs.classified_prompts(spark, folder))


@register(
    "outsourcing_trends",
    with_prompts("""SELECT year_month, cognitive_outsourcing_type, count(*) AS num_records FROM classified
      WHERE year_month IS NOT NULL GROUP BY ALL"""),
)
def _(spark, folder):
    return diagnostics.outsourcing_trend(inputs.classified_prompts(spark, folder))


@register(
    "dependency_trends",
    with_prompts("""SELECT year_month, count(record_id) AS num_records, avg(CAST(is_dependency_signal AS INTEGER)) AS dependency_rate,
      avg(CAST(is_anthropomorphic AS INTEGER)) AS anthropomorphism_rate, avg(CAST(is_reassurance_seeking AS INTEGER)) AS reassurance_rate,
      avg(dependency_score) AS mean_dependency_score FROM classified WHERE year_month IS NOT NULL GROUP BY 1"""),
    ("dependency_rate", "anthropomorphism_rate", "reassurance_rate", "mean_dependency_score"),
)
def _(spark, folder):
    return diagnostics.dependency_trend(inputs.classified_prompts(spark, folder))


@register(
    "complexity_trends",
    with_documents("""SELECT year_month, count(record_id) AS num_records, avg(prompt_sophistication_score) AS mean_prompt_sophistication,
      avg(conversational_depth_score) AS mean_conversational_depth, avg(recursive_interaction_score) AS mean_recursive_interaction,
      avg(self_disclosure_score) AS mean_self_disclosure FROM classified WHERE year_month IS NOT NULL GROUP BY 1"""),
    ("mean_prompt_sophistication", "mean_conversational_depth", "mean_recursive_interaction", "mean_self_disclosure"),
)
def _(spark, folder):
    return diagnostics.complexity_trend(inputs.classified_documents(spark, folder))


# Evaluation: a simple length rule and a source rule predict the labels of `labels`.
TARGETS = {"quality": "quality", "toxic": "toxic"}
PREDICTED_SQL = """pred AS (
  SELECT doc_id, CAST(n_chars >= 1000 AS INTEGER) AS p_quality, CASE WHEN lang <> 'es' THEN CAST(n_chars % 7 = 0 AS INTEGER) END AS p_toxic FROM documents),
pairs AS (
  SELECT 'quality' AS target, CAST(quality AS VARCHAR) AS t, CAST(p_quality AS VARCHAR) AS p FROM pred JOIN labels USING (doc_id)
  UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), CAST(p_toxic AS VARCHAR) FROM pred JOIN labels USING (doc_id)),
known AS (SELECT * FROM pairs WHERE t IS NOT NULL AND p IS NOT NULL),
universe AS (SELECT DISTINCT target, l FROM (SELECT target, t AS l FROM known UNION ALL SELECT target, p FROM known) AS u),
report AS (
  SELECT target, l, count_if(t = l) AS support, count_if(p = l) AS predicted, count_if(t = l AND p = l) AS correct
  FROM universe JOIN known USING (target) GROUP BY ALL),
scores AS (
  SELECT target, l AS label, CASE WHEN predicted = 0 THEN 0 ELSE correct / predicted END AS "precision",
         CASE WHEN support = 0 THEN 0 ELSE correct / support END AS recall,
         CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * correct / (predicted + support) END AS f1,
         CAST(support AS BIGINT) AS support, CAST(correct AS BIGINT) AS correct FROM report)"""


def _counts(spark, folder):
    docs = table(spark, folder, "documents")
    predictions = docs.select(
        "doc_id", (F.col("n_chars") >= 1000).cast("int").alias("quality"),
        F.when(F.col("lang") != "es", (F.col("n_chars") % 7 == 0).cast("int")).alias("toxic"),
    )
    return predictions, table(spark, folder, "labels")


@register(
    "evaluation_confusion",
    f"""WITH {PREDICTED_SQL}
        SELECT a.target, a.l AS true_label, b.l AS predicted_label, count(k.t) AS n
        FROM universe a JOIN universe b USING (target)
        LEFT JOIN known k ON k.target = a.target AND k.t = a.l AND k.p = b.l GROUP BY ALL""",
)
def _(spark, folder):
    return evaluation.confusion_matrix(evaluation.match_labels(*_counts(spark, folder), "doc_id", TARGETS))


@register("evaluation_report", f"WITH {PREDICTED_SQL} SELECT * FROM scores", ("precision", "recall", "f1"))
def _(spark, folder):
    return evaluation.label_report(evaluation.match_labels(*_counts(spark, folder), "doc_id", TARGETS))


@register(
    "evaluation_metrics",
    f"""WITH {PREDICTED_SQL}
        SELECT target, CAST(sum(support) AS BIGINT) AS num_rows, sum(correct) / sum(support) AS accuracy,
               avg("precision") AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
               sum("precision" * support) / sum(support) AS weighted_precision,
               sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1
        FROM scores GROUP BY target""",
    ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1"),
)
def _(spark, folder):
    return evaluation.evaluation_metrics(evaluation.match_labels(*_counts(spark, folder), "doc_id", TARGETS))


@register(
    "evaluation_rows",
    """SELECT (SELECT count(*) FROM documents) AS num_prediction_rows, (SELECT count(*) FROM labels) AS num_label_rows,
              (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS num_matched_rows""",
)
def _(spark, folder):
    return evaluation.match_sizes(*_counts(spark, folder), "doc_id")


def length_predictor():
    """Stand-in emotion model: three labels scored from the text length."""
    def predict(texts):
        found = []
        for value in texts:
            share = min(1.0, len(value) / 2000)
            found.append([("calm", 1 - share), ("intense", share), ("mixed", 0.4)])
        return found

    return predict


@register(
    "model_emotion",
    """SELECT doc_id, CASE WHEN calm >= intense AND calm >= 0.4 THEN 'calm' WHEN intense >= 0.4 THEN 'intense' ELSE 'mixed' END AS transformer_emotion_label,
              greatest(calm, intense, 0.4) AS transformer_emotion_score, 'length-rule' AS transformer_emotion_model
       FROM (SELECT doc_id, least(1.0, length(text) / 2000) AS intense, 1 - least(1.0, length(text) / 2000) AS calm FROM documents) AS d""",
    ("transformer_emotion_score",),
)
def _(spark, folder):
    """The plug-in point for emotion models, with a stand-in predictor."""
    settings = ClassifySettings(
        text_column="text", id_column="doc_id", emotion_model=ModelSettings(True, "length-rule", 16)
    )
    rows = add_emotion_labels(table(spark, folder, "documents").select("doc_id", "text"), settings, length_predictor)
    return rows.drop("text")


@register("model_quality")
def _(spark, folder):
    """A classifier fitted on three quarters of the labelled documents, plugged in as the model, over all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    label = F.concat_ws("/", F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))
    labelled = table(spark, folder, "labels").filter("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", label.alias("label"))
    model = fit_text_classifier(docs.filter(~held_out).join(labelled, "doc_id"), "text")
    settings = ClassifySettings(text_column="text", id_column="doc_id", emotion_model=ModelSettings(True, "hashed-terms", 64))
    rows = add_emotion_labels(docs, settings, model.factory)
    return rows.select("doc_id", held_out.alias("held_out"), "transformer_emotion_label", "transformer_emotion_score")


def overlap_predictor(candidates):
    """Stand-in zero-shot model: the candidate at the text length modulo the number of candidates.

    Its score is taken from the words the candidate is shown with: (length + last word's length) / 200.
    """
    def predict(texts):
        found = []
        for value in texts:
            shown = candidates[len(value) % len(candidates)]
            found.append([(shown, (len(shown) + len(shown.split(" ")[-1])) / 200)])
        return found

    return predict


@register(
    "model_behavior",
    """WITH modes(i, l, d) AS (VALUES (0, 'tool_mode', 'User treats AI as software or a utility for task execution.'),
         (1, 'assistant_mode', 'User asks for guidance, explanation, tutoring, or practical help.'),
         (2, 'collaborator_mode', 'User treats AI as a co-creator, brainstorming partner, or writing collaborator.'),
         (3, 'companion_mode', 'User treats AI as a social presence, listener, or source of reassurance.'),
         (4, 'therapist_surrogate_mode', 'User seeks emotionally vulnerable or therapy-like support from AI.')),
       tasks(i, l) AS (VALUES (0, 'writing'), (1, 'coding'), (2, 'studying'), (3, 'decision_making'), (4, 'relationship_advice'),
                              (5, 'creative_ideation'), (6, 'life_planning'), (7, 'memory'), (8, 'emotional_regulation')),
       shown AS (SELECT i, l, replace(l, '_', ' ') || ': ' || d AS s FROM modes),
       named AS (SELECT i, l, replace(l, '_', ' ') || ': ' || replace(l, '_', ' ') AS s FROM tasks)
       SELECT doc_id, m.l AS transformer_interaction_mode, (length(m.s) + length(string_split(m.s, ' ')[-1])) / 200 AS transformer_interaction_score,
              t.l AS transformer_cognitive_outsourcing_type,
              (length(t.s) + length(string_split(t.s, ' ')[-1])) / 200 AS transformer_cognitive_outsourcing_score,
              'length-rule' AS transformer_behavior_model
       FROM documents JOIN shown m ON m.i = length(text) % 5 JOIN named t ON t.i = length(text) % 9""",
    ("transformer_interaction_score", "transformer_cognitive_outsourcing_score"),
)
def _(spark, folder):
    """The plug-in point for zero-shot models, with a stand-in predictor."""
    settings = ClassifySettings(
        text_column="text", id_column="doc_id", behavior_model=ModelSettings(True, "length-rule", 8)
    )
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return add_behavior_labels(docs, default_taxonomy(), settings, overlap_predictor).drop("text")
