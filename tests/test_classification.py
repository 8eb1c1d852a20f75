"""Labels, scores, diagnostics, evaluation, model plug-ins."""

import json

import pytest
from pyspark.sql import functions as F

from colloquy.operators import diagnostics, evaluation
from colloquy.operators.classify import add_complexity_metrics, add_rule_columns, classify_prompts
from colloquy.operators.taxonomy import add_matched_keywords, build_taxonomy, default_taxonomy, load_taxonomy, plan_keywords
from colloquy.plans.classification import run_classification
from colloquy.settings import ClassifySettings, ModelSettings

# prompt -> interaction, score, outsourcing, score, emotion, score, composites
EXPECTED = {
    "Write a Python function and debug this error.": ("tool_mode", .7746, "coding", 1.0, "none", 0, (0, 0, 0, 0, 0, 0)),
    "I feel lonely and alone. I am struggling. Can you talk to me and comfort me?":
        ("companion_mode", .8660, "emotional_regulation", .3780, "loneliness", .8165, (.8660, .3536, .6098, .3780, 0, .3780)),
    "I am having anxiety and panic after trauma. I cannot cope.":
        ("therapist_surrogate_mode", .8321, "emotional_regulation", .7559, "fear", .7559, (0, .8321, .4160, 0, 0, .8321)),
    "Help me decide whether to quit my job.": ("assistant_mode", 0, "decision_making", .3780, "none", 0, (0, 0, 0, 0, 0, 0)),
    "Brainstorm story ideas with me.": ("collaborator_mode", .5774, "creative_ideation", 1.0, "none", 0, (0, 0, 0, 0, 0, 0)),
    "Write an email for me.": ("assistant_mode", 0, "writing", .6667, "none", 0, (0, 0, 0, 0, 0, 0)),
    "I feel lonely. Please keep me company.": ("companion_mode", .5774, "none", 0, "loneliness", .4082, (.5774, 0, .2887, 0, 0, 0)),
    "Explain this homework problem step by step.":
        ("assistant_mode", .5774, "studying", .3536, "confusion", .4082, (0, 0, 0, 0, 0, 0)),
    "I trust you. You are my friend and you understand me. Please reassure me.":
        ("companion_mode", .2887, "emotional_regulation", .3780, "none", 0, (.2887, 0, .1443, .3780, 1.0, 0)),
}


def test_expected_scores(spark):
    df = add_rule_columns(spark.createDataFrame([(p,) for p in EXPECTED], "prompt_text string"))
    for r in df.collect():
        mode, ms, task, ts, emotion, es, composites = EXPECTED[r.prompt_text]
        assert (r.interaction_mode, r.cognitive_outsourcing_type, r.emotion_primary) == (mode, task, emotion)
        got = (r.interaction_mode_score, r.cognitive_outsourcing_score, r.emotion_score, r.companionship_score, r.vulnerability_score,
               r.dependency_score, r.reassurance_seeking_score, r.anthropomorphism_score, r.self_disclosure_score)
        assert got == pytest.approx((ms, ts, es, *composites), abs=1e-4)
        assert r.is_companionship == (r.companionship_score >= 0.35)


def test_keyword_matching_rules(spark):
    taxonomy = default_taxonomy()
    texts = {
        "i missed it, should it": {"i miss", "should i"}, "codes code_x écode codé": {"code"}, "co-write it": {"co-write", "write"},
        "xco-write": {"write"}, "what would you do now": {"what would you do"}, "that what would you doing": {"what would you do"},
        "don't leave": {"don't leave"}, "": set(), "sql,api!": {"sql", "api"},
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in add_matched_keywords(df, "t", taxonomy).collect():
        assert texts[row.t] == set(row._matched), row.t


def test_ties_take_the_largest_label(spark):
    row = add_rule_columns(spark.createDataFrame([("python exam",)], "prompt_text string")).first()
    assert row.cognitive_outsourcing_type == "studying"
    tie = add_rule_columns(spark.createDataFrame([("habit exam",)], "prompt_text string")).first()
    assert tie.cognitive_outsourcing_type == "studying"


def test_taxonomy_validation(tmp_path):
    assert sum(len(labels) for labels in default_taxonomy().values()) == 29
    assert set(plan_keywords(default_taxonomy()).patterns) == {"co-write"}
    for broken in ({}, [], {"interaction_modes": {}}):
        with pytest.raises(ValueError):
            build_taxonomy(broken)
    sections = ("interaction_modes", "cognitive_outsourcing", "emotional_signals", "composite_signals")
    good = {s: {"x": {"keywords": ["k"], "description": "d"}} for s in sections}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(good))
    assert load_taxonomy(str(path))["interaction_modes"][0].candidate_text == "x: d"
    with pytest.raises(ValueError):
        build_taxonomy({**good, "composite_signals": {"x": {"keywords": []}}})


def test_complexity(spark):
    df = spark.createDataFrame([("Act as a tutor. Step by step, do not stop! Again.", 0.5), (None, None)], "prompt_text string, self_disclosure_score double")
    row, empty = add_complexity_metrics(df).collect()
    assert row.sentence_count == 3 and row.avg_words_per_sentence == 3.667 and row.role_prompting_score == 1.0
    assert row.instruction_specificity_score == 0.5 and row.recursive_interaction_score == pytest.approx(1 / 3)
    words, chars = 11, len("Act as a tutor. Step by step, do not stop! Again.")
    expected = chars / 1500 * .25 + words / 250 * .25 + 1.0 * .15 + .5 * .15 + .1 + .1 / 3
    assert row.prompt_sophistication_score == pytest.approx(expected)
    assert row.conversational_depth_score == pytest.approx(.35 / 3 + .35 * .5 + .3 * expected)
    assert empty.sentence_count == 1 and empty.lexical_diversity == 0.0


def _pipeline_frame(spark):
    prompts = ["Write an email for me.", "I feel lonely. Please keep me company.", "Explain this homework problem step by step."]
    rows = [(f"r{i}", f"c{i % 2}", i, f"2024-0{i + 1}", p) for i, p in enumerate(prompts)]
    return spark.createDataFrame(rows, "record_id string, conversation_id string, turn_index int, year_month string, prompt_text string")


def test_run_writes_reports(spark, tmp_path):
    source, labels = str(tmp_path / "in.parquet"), str(tmp_path / "labels.parquet")
    frame = _pipeline_frame(spark)
    frame.write.parquet(source)
    frame.select("record_id", F.lit("assistant_mode").alias("interaction_mode")).write.parquet(labels)
    record = run_classification(spark, source, str(tmp_path / "out.parquet"), str(tmp_path / "reports"), labels_path=labels,
                                settings=ClassifySettings(normalized_text=True)).first()
    assert record.num_records == 3 and record.records_per_second > 0
    out = spark.read.parquet(str(tmp_path / "out.parquet"))
    assert out.filter("is_companionship").count() == 1
    assert out.filter("interaction_type = interaction_mode and disclosure_score = vulnerability_score").count() == 3
    report = spark.read.parquet(str(tmp_path / "reports" / "evaluation.parquet")).first()
    assert report.num_rows == 3 and report.accuracy == pytest.approx(2 / 3)
    assert "unstable_regions" in json.loads(record.details)["reports"]


def test_diagnostics_of_empty_and_small_tables(spark):
    classified = add_complexity_metrics(add_rule_columns(_pipeline_frame(spark)))
    empty = classified.limit(0)
    assert {r.coverage_rate for r in diagnostics.taxonomy_coverage(empty).collect()} == {0.0}
    overlap = diagnostics.behavioral_overlap(classified).collect()
    assert len(overlap) == 49 and all(r.overlap_count == 1 for r in overlap if r.left == r.right == "is_companionship")
    summary = {(r.metric, r.label): r.value for r in diagnostics.summarize_classification(classified).collect()}
    assert summary[("is_companionship", "rate")] == pytest.approx(1 / 3)
    assert summary[("interaction_mode", "assistant_mode")] == 2.0
    unstable = diagnostics.unstable_regions(classified).collect()
    assert all(r.margin <= 0.08 and r.top_score > 0 for r in unstable)


def test_evaluation_with_missing_and_unseen_labels(spark):
    predictions = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c"), (5, "a")], "id int, y string")
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "d"), (9, "a")], "id int, y string")
    counts = evaluation.match_labels(predictions, labels, "id", {"y": "y"})
    assert len(evaluation.confusion_matrix(counts).collect()) == 16
    row = evaluation.evaluation_metrics(counts).first()
    assert row.num_rows == 3 and row.accuracy == pytest.approx(1 / 3)
    assert row.macro_f1 == pytest.approx((2 / 3) / 4) and row.weighted_f1 == pytest.approx(2 / 3 * (2 / 3))
    sizes = evaluation.match_sizes(predictions, labels, "id").first()
    assert tuple(sizes) == (5, 5, 4)


def test_model_columns(spark):
    frame = _pipeline_frame(spark)
    off = classify_prompts(frame)
    assert off.filter("transformer_emotion_label is not null or transformer_behavior_model is not null").count() == 0

    def emotions():
        return lambda texts: [[("joy", 0.1), ("fear", 0.9)] for _ in texts]

    def zero_shot(candidates):
        return lambda texts: [[(c, float(i)) for i, c in enumerate(candidates)] for _ in texts]

    settings = ClassifySettings(emotion_model=ModelSettings(True, "e", 2, max_records=2), behavior_model=ModelSettings(True, "b", 2))
    rows = classify_prompts(frame, settings=settings, emotion_predictor=emotions, behavior_predictor=zero_shot).orderBy("record_id").collect()
    assert [r.transformer_emotion_label for r in rows] == ["fear", "fear", None]
    assert {r.transformer_emotion_model for r in rows} == {"e"}
    assert {r.transformer_interaction_mode for r in rows} == {"therapist_surrogate_mode"}
    assert {r.transformer_cognitive_outsourcing_type for r in rows} == {"emotional_regulation"}
    with pytest.raises(ValueError):
        classify_prompts(frame, settings=settings)
