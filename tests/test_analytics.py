"""Trends, tests of trend, transitions, archetypes, network, events."""

import math

import pytest
from pyspark.sql import functions as F

from colloquy.operators import archetypes, events, network, temporal, trendtests
from colloquy.plans.analytics import run_analytics
from colloquy.settings import AnalyticsSettings, EventWindow

SCHEMA = """record_id string, conversation_id string, turn_index long, timestamp timestamp, year_month string,
prompt_word_count long, interaction_mode string, emotion_primary string, cognitive_outsourcing_type string,
is_companionship boolean, is_vulnerable boolean, is_dependency_signal boolean, is_cognitive_outsourcing boolean,
is_reassurance_seeking boolean, is_anthropomorphic boolean, is_self_disclosure boolean, dependency_score double,
companionship_score double, vulnerability_score double, anthropomorphism_score double, reassurance_seeking_score double,
prompt_sophistication_score double, conversational_depth_score double"""


@pytest.fixture(scope="module")
def classified(spark):
    rows = []
    for i in range(6):
        month = i // 2 + 1
        rows.append((f"r{i}", f"c{i // 2}", i % 2, None, f"2024-0{month}", 10 + i, "tool_mode" if i % 2 else "companion_mode",
                     "none" if i % 2 else "joy", "coding" if i % 2 else "none", i % 2 == 0, False, i == 4, i % 2 == 1, False, False, False,
                     i / 10, i / 20, 0.1, 0.0, 0.0, 0.2 + i / 50, 0.3))
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("timestamp", F.to_timestamp(F.concat("year_month", F.lit("-10 12:00:00")))).cache()


def test_trends_roll_over_rows(classified):
    trends = temporal.behavior_trends(classified).orderBy("year_month").collect()
    assert [r.num_records for r in trends] == [2, 2, 2]
    assert trends[0].mean_dependency_score_delta is None
    assert trends[2].mean_dependency_score == pytest.approx(0.45)
    assert trends[2].mean_dependency_score_rolling_3 == pytest.approx(0.25)
    assert trends[1].is_companionship_rate == 0.5
    with pytest.raises(ValueError):
        temporal.behavior_trends(classified, "no_such_column")


def test_trend_statistics(spark, classified):
    stats = {r.metric: r for r in trendtests.trend_statistics(temporal.behavior_trends(classified)).collect()}
    assert stats["mean_dependency_score"].slope_per_period == pytest.approx(0.2)
    flat = stats["is_companionship_rate"]
    assert (flat.slope_per_period, flat.r_value, flat.p_value, flat.std_error, flat.num_periods) == (0, 0, 1, 0, 3)
    assert "num_records" not in stats and not any("_delta" in m or "_rolling_" in m for m in stats)
    short = temporal.behavior_trends(classified.filter("year_month < '2024-03'"))
    assert trendtests.trend_statistics(short).count() == 0


@pytest.mark.parametrize("n", [3, 4, 5, 8, 15])
def test_student_p_values(spark, n):
    ys = [math.sin(i * 1.7) + i * 0.15 for i in range(n)]
    df = spark.createDataFrame([(f"{i:03d}", y) for i, y in enumerate(ys)], "p string, y double")
    row = trendtests.linear_trends(df, "p", ["y"]).first()
    xs = list(range(n))
    mx, my = sum(xs) / n, sum(ys) / n
    sxx, syy = sum((x - mx) ** 2 for x in xs), sum((y - my) ** 2 for y in ys)
    sxy = sum((x - mx) * (y - my) for x, y in zip(xs, ys))
    r = sxy / math.sqrt(sxx * syy)
    assert row.slope_per_period == pytest.approx(sxy / sxx) and row.r_value == pytest.approx(r)
    assert row.std_error == pytest.approx(math.sqrt((1 - r * r) * syy / sxx / (n - 2)))
    nu, t = n - 2, abs(r) * math.sqrt((n - 2) / (1 - r * r))
    # Integrate Student's density from 0 to t by Simpson's rule in the angle.
    theta, steps = math.atan(t / math.sqrt(nu)), 4000
    weights = [1 if k in (0, steps) else 4 if k % 2 else 2 for k in range(steps + 1)]
    area = sum(w * math.cos(theta * k / steps) ** (nu - 1) for k, w in enumerate(weights)) * theta / steps / 3
    density = math.gamma((nu + 1) / 2) / (math.sqrt(math.pi) * math.gamma(nu / 2))
    assert row.p_value == pytest.approx(1 - 2 * density * area, abs=1e-9)


def test_mann_kendall(spark):
    ys = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(f"{i}", y) for i, y in enumerate(ys)], "p string, y double")
    row = trendtests.mann_kendall(df, "p", "y").first()
    s = sum((b > a) - (b < a) for i, a in enumerate(ys) for b in ys[i + 1:])
    z = (s - 1) / math.sqrt(8 * 7 * 21 / 18)
    assert (row.s, row.trend) == (s, "increasing") and row.z == pytest.approx(z)
    assert row.p_value == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-12)


@pytest.mark.parametrize("table", [{("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 30, ("b", "y"): 5},
                                   {("a", "x"): 5, ("a", "y"): 7, ("b", "x"): 9, ("c", "y"): 4, ("c", "z"): 8}])
def test_chi_square(spark, table):
    df = spark.createDataFrame([(r, c) for (r, c), n in table.items() for _ in range(n)], "r string, c string")
    row = trendtests.chi_square_independence(df, "r", "c").first()
    rs, cs = sorted({r for r, _ in table}), sorted({c for _, c in table})
    total = sum(table.values())
    dof, chi = (len(rs) - 1) * (len(cs) - 1), 0.0
    for r in rs:
        for c in cs:
            e = sum(n for (a, _), n in table.items() if a == r) * sum(n for (_, b), n in table.items() if b == c) / total
            d = abs(table.get((r, c), 0) - e)
            chi += (max(0.0, d - 0.5) if dof == 1 else d) ** 2 / e
    tail = math.erfc(math.sqrt(chi / 2)) if dof == 1 else math.exp(-chi / 2) * sum((chi / 2) ** i / math.factorial(i) for i in range(dof // 2))
    assert row.dof == dof and row.chi_square == pytest.approx(chi) and row.p_value == pytest.approx(tail, abs=1e-9)


def test_transitions(spark, classified):
    rows = temporal.transition_matrix(classified, "interaction_mode").collect()
    assert [(r.from_state, r.to_state, r["count"], r.probability) for r in rows] == [("companion_mode", "tool_mode", 3, 1.0)]
    assert temporal.transition_matrix(classified.limit(0), "interaction_mode").count() == 0
    single = temporal.transition_matrix(classified.filter("turn_index = 0"), "emotion_primary")
    assert single.columns == ["from_state", "to_state", "count", "probability"] and single.count() == 0
    with pytest.raises(ValueError):
        temporal.transition_matrix(classified, "missing_state")


def test_archetypes(classified):
    features = archetypes.conversation_features(classified)
    assert features.count() == 3
    assigned = archetypes.discover_archetypes(classified, AnalyticsSettings(n_archetypes=2)).cache()
    assert assigned.count() == 3 and assigned.select("archetype").distinct().count() == 2
    summary = archetypes.summarize_archetypes(assigned)
    assert sum(r.num_conversations for r in summary.collect()) == 3
    few = archetypes.discover_archetypes(classified.filter("conversation_id = 'c0'"))
    assert [r.archetype for r in few.collect()] == [None]
    assert archetypes.summarize_archetypes(few).count() == 0


def test_archetype_names_first_wins_ties(spark):
    df = spark.createDataFrame([(0, 0.5, 0.0, 1.0, 0.0), (1, 0.0, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 0.0, 0.9)],
                               "archetype int, is_vulnerable double, companionship_score double, is_cognitive_outsourcing double, dependency_score double")
    names = {r.archetype: r.archetype_name for r in archetypes.name_archetypes(df).collect()}
    assert names == {0: "Cognitive Outsourcers", 1: "Cognitive Outsourcers", 2: "Casual/Utility Users"}


def test_network(spark, classified):
    nodes, edges = network.behavior_network(classified)
    listed = {(r.source, r.target): r.weight for r in edges.collect()}
    assert listed[("emotion_primary:joy", "interaction_mode:companion_mode")] == 3
    assert all(a < b for a, b in listed)
    by_node = {r.node: (r["count"], r.degree_centrality) for r in nodes.collect()}
    assert by_node["is_dependency_signal"][0] == 1 and "emotion_primary:none" not in by_node
    degree = sum("is_companionship" in pair for pair in listed)
    assert by_node["is_companionship"][1] == pytest.approx(degree / (len(by_node) - 1))
    lone = spark.createDataFrame([("x",), (None,), ("none",)], "interaction_mode string")
    nodes, edges = network.behavior_network(lone)
    assert [tuple(r) for r in nodes.collect()] == [("interaction_mode:x", 1, 1.0)] and edges.count() == 0


def test_event_windows_bounds(spark):
    times = ["2023-02-11 23:59:59", "2023-02-12 00:00:00", "2023-03-13 00:00:00", "2023-03-13 00:00:01", "2023-03-14 00:00:00",
             "2023-04-13 00:00:00", "2023-04-13 00:00:01"]
    df = spark.createDataFrame([(t, float(i)) for i, t in enumerate(times)], "t string, dependency_score double")
    df = df.select(F.to_timestamp("t").alias("timestamp"), "dependency_score")
    rows = {(r.event, r.metric): r for r in events.event_windows(df, [EventWindow("a", "2023-03-14"), EventWindow("b", "2020-01-01")]).collect()}
    assert rows[("a", "num_records")].before_value == 2 and rows[("a", "num_records")].after_value == 2
    assert rows[("a", "dependency_score")].difference == pytest.approx(4.5 - 1.5)
    assert rows[("b", "dependency_score")].before_value == 0.0 and len(rows) == 4
    assert events.in_range(df, [EventWindow("a", "2023-03-14")]).count() == 5 and events.in_range(df, []).count() == 0


def test_run_writes_every_table(spark, classified, tmp_path):
    path = str(tmp_path / "classified.parquet")
    classified.write.parquet(path)
    record = run_analytics(spark, path, str(tmp_path / "out"), AnalyticsSettings(n_archetypes=2)).first()
    assert record.num_records == 6
    assert spark.read.parquet(str(tmp_path / "out" / "event_windows.parquet")).count() == 16
    assert spark.read.parquet(str(tmp_path / "out" / "behavior_trends.parquet")).count() == 3
