"""Queries over trends, transitions, events, networks and archetypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import archetypes, events, network, temporal, trendtests
from colloquy.schema import FLAG_COLUMNS
from suite import inputs
from suite.inputs import quote, table, with_prompts
from suite.registry import register

RATES = tuple(f"{c}_rate" for c in FLAG_COLUMNS)
MEANS = tuple(f"mean_{c}" for c in temporal.SCORE_COLUMNS)
TREND_NUMBERS = ("num_records", *RATES, *MEANS)


def rolling_sql(source: str, period: str, columns: tuple[str, ...], window: int = 3) -> str:
    extra = ", ".join(
        f"avg({c}) OVER (ORDER BY {period} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS {c}_rolling_{window}, "
        f"CAST({c} - lag({c}) OVER (ORDER BY {period}) AS DOUBLE) AS {c}_delta"
        for c in columns
    )
    return f"SELECT *, {extra} FROM {source}"


def rolling_doubles(columns: tuple[str, ...], window: int = 3) -> tuple[str, ...]:
    derived = [f"{c}_{suffix}" for c in columns for suffix in (f"rolling_{window}", "delta")]
    return (*[c for c in columns if c != "num_records"], *derived)


TRENDS_CTE = f"""trends AS (
  SELECT year_month, count(record_id) AS num_records,
         {", ".join(f"avg(CAST({c} AS INTEGER)) AS {c}_rate" for c in FLAG_COLUMNS)},
         {", ".join(f"avg({c}) AS mean_{c}" for c in temporal.SCORE_COLUMNS)}
  FROM classified WHERE year_month IS NOT NULL GROUP BY year_month)"""


def regression_sql(long: str, groups: tuple[str, ...] = ()) -> str:
    """Least squares with Student-t p-values from a ``points(groups, metric, x, y)`` query."""
    keys = ", ".join((*groups, "metric"))
    return f"""points AS ({long}),
    sums AS (SELECT {keys}, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
                    regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, min(y) = max(y) AS flat,
                    arg_min(y, x) AS first_value, arg_max(y, x) AS last_value
             FROM points WHERE y IS NOT NULL GROUP BY {keys} HAVING count(*) >= 3),
    fit AS (SELECT *, n - 2 AS dof, CASE WHEN flat THEN 0 ELSE greatest(-1, least(1, sxy / sqrt(sxx * syy))) END AS r FROM sums),
    angle AS (SELECT *, CASE WHEN r * r >= 1 THEN pi() / 2 ELSE atan(abs(r) / sqrt(1 - r * r)) END AS theta FROM fit),
    series AS (SELECT *, CASE WHEN dof % 2 = 1 THEN 1 ELSE 0 END AS odd,
                 1 + coalesce(list_sum(list_transform(generate_series(CASE WHEN dof % 2 = 1 THEN 3 ELSE 2 END, dof - 2, 2),
                   lambda j: list_product(list_transform(generate_series(CASE WHEN dof % 2 = 1 THEN 3 ELSE 2 END, j, 2),
                     lambda i: cos(theta) * cos(theta) * (i - 1) / i)))), 0) AS total FROM angle),
    tested AS (SELECT *, CASE WHEN flat THEN 1 WHEN r * r >= 1 THEN 0
                 WHEN dof = 1 THEN 1 - 2 / pi() * theta
                 WHEN odd = 1 THEN 1 - 2 / pi() * (theta + sin(theta) * cos(theta) * total)
                 ELSE 1 - sin(theta) * total END AS p FROM series)"""


FIT_COLUMNS = """metric, CASE WHEN flat THEN 0 ELSE slope END AS slope_per_period, intercept, r AS r_value,
    greatest(0, p) AS p_value, CASE WHEN flat THEN 0 ELSE sqrt((1 - r * r) * syy / sxx / dof) END AS std_error,
    n AS num_periods"""
FIT_DOUBLES = ("slope_per_period", "intercept", "r_value", "p_value", "std_error")


def unpivot_sql(source: str, period: str, columns: tuple[str, ...], strata: str = "") -> str:
    partition = f"PARTITION BY {strata} " if strata else ""
    lead = f"{strata}, " if strata else ""
    numbered = f"(SELECT *, row_number() OVER ({partition}ORDER BY {period}) - 1 AS x FROM {source})"
    return " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS metric, CAST(x AS DOUBLE) AS x, CAST({c} AS DOUBLE) AS y FROM {numbered} AS t{i}"
        for i, c in enumerate(columns)
    )


@register(
    "behavior_trends",
    with_prompts(f", {TRENDS_CTE} {rolling_sql('trends', 'year_month', TREND_NUMBERS)}"),
    rolling_doubles(TREND_NUMBERS),
)
def _(spark, folder):
    return temporal.behavior_trends(inputs.classified_prompts(spark, folder))


@register(
    "trend_statistics",
    with_prompts(f", {TRENDS_CTE}, {regression_sql(unpivot_sql('trends', 'year_month', (*RATES, *MEANS)))} SELECT {FIT_COLUMNS} FROM tested"),
    FIT_DOUBLES,
)
def _(spark, folder):
    trends = temporal.behavior_trends(inputs.classified_prompts(spark, folder))
    return trendtests.trend_statistics(trends)


def transitions_sql(source: str, state: str, key: str, order: str) -> str:
    return f"""steps AS (SELECT {state} AS from_state, lead({state}) OVER (PARTITION BY {key} ORDER BY {order}) AS to_state
                         FROM {source} WHERE {state} IS NOT NULL AND {key} IS NOT NULL),
    counted_steps AS (SELECT from_state, to_state, count(*) AS n FROM steps WHERE to_state IS NOT NULL GROUP BY ALL)
    SELECT from_state, to_state, n AS "count", n / sum(n) OVER (PARTITION BY from_state) AS probability FROM counted_steps"""


@register(
    "transitions_mode",
    with_prompts(", " + transitions_sql("classified", "interaction_mode", "conversation_id", "turn_index, record_id")),
    ("probability",),
)
def _(spark, folder):
    return temporal.transition_matrix(inputs.classified_prompts(spark, folder), "interaction_mode", write_first=True)


@register(
    "transitions_emotion",
    with_prompts(", " + transitions_sql("classified", "emotion_primary", "conversation_id", "turn_index, record_id")),
    ("probability",),
)
def _(spark, folder):
    matrix = temporal.transition_matrix(inputs.classified_prompts(spark, folder), "emotion_primary", write_first=True)
    return temporal.sort_transitions(matrix)


@register(
    "event_transitions",
    "WITH " + transitions_sql("events", "event_type", "user_id", "ts, event_id"),
    ("probability",),
)
def _(spark, folder):
    return temporal.transition_matrix(table(spark, folder, "events"), "event_type", "user_id", "ts", "event_id")


@register(
    "order_transitions",
    "WITH " + transitions_sql("orders", "o_orderpriority", "o_custkey", "o_orderdate, o_orderkey"),
    ("probability",),
)
def _(spark, folder):
    return temporal.transition_matrix(
        table(spark, folder, "orders"), "o_orderpriority", "o_custkey", "o_orderdate", "o_orderkey"
    )


DAILY = "daily AS (SELECT strftime(ts, '%Y-%m-%d') AS \"day\", count(event_id) AS num_records, avg(\"value\") AS mean_value FROM events GROUP BY 1)"


@register(
    "event_daily_trend",
    f"WITH {DAILY} {rolling_sql('daily', 'day', ('num_records', 'mean_value'), 7)}",
    rolling_doubles(("num_records", "mean_value"), 7),
)
def _(spark, folder):
    daily = table(spark, folder, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("event_id").alias("num_records"), F.avg("value").alias("mean_value")
    )
    return temporal.add_rolling_and_delta(daily, "day", ["num_records", "mean_value"], 7)


MONTHLY_LINES = """monthly AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS year_month, count(*) AS num_records, avg(l_extendedprice) AS mean_price,
         avg(CAST(l_returnflag = 'R' AS INTEGER)) AS return_rate, avg(l_discount) AS mean_discount
  FROM lineitem GROUP BY 1)"""


def _monthly_lines(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("year_month")).agg(
        F.count(F.lit(1)).alias("num_records"), F.avg("l_extendedprice").alias("mean_price"),
        F.avg((F.col("l_returnflag") == "R").cast("int")).alias("return_rate"),
        F.avg("l_discount").alias("mean_discount"),
    )


LINE_NUMBERS = ("num_records", "mean_price", "return_rate", "mean_discount")


@register(
    "shipment_monthly_trend",
    f"WITH {MONTHLY_LINES} {rolling_sql('monthly', 'year_month', LINE_NUMBERS)}",
    rolling_doubles(LINE_NUMBERS),
    digits=5,
)
def _(spark, folder):
    return temporal.add_rolling_and_delta(_monthly_lines(spark, folder), "year_month", list(LINE_NUMBERS), 3)


@register(
    "shipment_trend_statistics",
    f"WITH {MONTHLY_LINES}, {regression_sql(unpivot_sql('monthly', 'year_month', LINE_NUMBERS[1:]))} SELECT {FIT_COLUMNS} FROM tested",
    FIT_DOUBLES,
    digits=5,
)
def _(spark, folder):
    return trendtests.trend_statistics(_monthly_lines(spark, folder))


def _event_sql() -> str:
    parts = []
    for name, day in (("gpt4_release", "2023-03-14"), ("chatgpt_ios_release", "2023-05-18")):
        d = f"TIMESTAMP '{day}'"
        before = f"\"timestamp\" BETWEEN {d} - INTERVAL 30 DAY AND {d} - INTERVAL 1 DAY"
        after = f"\"timestamp\" BETWEEN {d} AND {d} + INTERVAL 30 DAY"
        for metric in ("num_records", *events.EVENT_METRICS):
            if metric == "num_records":
                b, a = f"count_if({before})", f"count_if({after})"
            else:
                value = f"CAST({metric} AS DOUBLE)"
                b, a = (f"coalesce(avg({value}) FILTER ({w}), 0)" for w in (before, after))
            parts.append(
                f"SELECT '{name}' AS event, '{day}' AS event_date, '{metric}' AS metric, CAST({b} AS DOUBLE) AS before_value, "
                f"CAST({a} AS DOUBLE) AS after_value, CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE) AS difference FROM classified"
            )
    return " UNION ALL ".join(parts)


@register("event_windows", with_prompts(_event_sql()), ("before_value", "after_value", "difference"))
def _(spark, folder):
    raw = events.in_range(inputs.seeded_prompts(spark, folder))
    return events.event_windows(inputs.classified(raw))


FEATURES = archetypes.FEATURE_COLUMNS
FEATURE_SQL = ", ".join(f"avg(CAST({c} AS {'INTEGER' if c in FLAG_COLUMNS else 'DOUBLE'})) AS {c}" for c in FEATURES)
FEATURES_CTE = f"""features AS (SELECT conversation_id, {FEATURE_SQL}, count(*) AS num_turns,
    avg(prompt_word_count) AS mean_prompt_word_count FROM classified GROUP BY conversation_id)"""


@register(
    "conversation_features",
    with_prompts(f", {FEATURES_CTE} SELECT * FROM features"),
    (*FEATURES, "mean_prompt_word_count"),
)
def _(spark, folder):
    return archetypes.conversation_features(inputs.classified_prompts(spark, folder))


@register("archetypes")
def _(spark, folder):
    """Every conversation with enough turns, its features and its archetype."""
    return archetypes.discover_archetypes(inputs.classified_prompts(spark, folder))


@register("archetype_summary")
def _(spark, folder):
    """Size, mean features and name of every archetype."""
    return archetypes.summarize_archetypes(archetypes.discover_archetypes(inputs.classified_prompts(spark, folder)))


NAMES_SQL = """CASE
  WHEN e >= o AND e >= d AND e >= c AND e >= u THEN 'Emotional Support Seekers'
  WHEN o >= d AND o >= c AND o >= u THEN 'Cognitive Outsourcers'
  WHEN d >= c AND d >= u THEN 'Dependency-Oriented Users'
  WHEN c >= u THEN 'Conversational Collaborators' ELSE 'Casual/Utility Users' END"""


@register(
    "archetype_names",
    with_prompts(f""", {FEATURES_CTE},
    grouped AS (SELECT CAST(num_turns AS INTEGER) AS archetype, count(*) AS num_conversations,
      {", ".join(f"avg({c}) AS {c}" for c in (*FEATURES, "num_turns", "mean_prompt_word_count"))} FROM features GROUP BY 1),
    traits AS (SELECT *, is_vulnerable + companionship_score AS e, is_cognitive_outsourcing AS o,
      dependency_score + is_dependency_signal AS d, prompt_sophistication_score + conversational_depth_score AS c,
      1 - is_vulnerable AS u FROM grouped)
    SELECT * EXCLUDE (e, o, d, c, u), {NAMES_SQL} AS archetype_name FROM traits"""),
    (*FEATURES, "num_turns", "mean_prompt_word_count"),
)
def _(spark, folder):
    """Summary and naming over a grouping both engines can form: the number of turns."""
    features = archetypes.conversation_features(inputs.classified_prompts(spark, folder))
    return archetypes.summarize_archetypes(features.withColumn("archetype", F.col("num_turns").cast("int")))


SIGNALS_SQL = " UNION ALL ".join(
    [f"SELECT conversation_id, turn_index, '{c}:' || {c} AS signal FROM classified WHERE {c} <> 'none'"
     for c in ("interaction_mode", "emotion_primary", "cognitive_outsourcing_type")]
    + [f"SELECT conversation_id, turn_index, {quote(c)} AS signal FROM classified WHERE {c}" for c in FLAG_COLUMNS]
)
EDGES_CTE = f"""signals AS ({SIGNALS_SQL}),
    links AS (SELECT a.signal AS "source", b.signal AS target, count(*) AS weight
              FROM signals a JOIN signals b USING (conversation_id, turn_index) WHERE a.signal < b.signal GROUP BY ALL)"""


@register(
    "network_nodes",
    with_prompts(f""", {EDGES_CTE},
    ends AS (SELECT "source" AS node FROM links UNION ALL SELECT target FROM links),
    degree AS (SELECT node, count(*) AS deg FROM ends GROUP BY node),
    nodes AS (SELECT signal AS node, count(*) AS "count" FROM signals GROUP BY signal)
    SELECT nodes.node, "count", CASE WHEN (SELECT count(*) FROM nodes) = 1 THEN 1.0
           ELSE coalesce(deg, 0) / ((SELECT count(*) FROM nodes) - 1) END AS degree_centrality
    FROM nodes LEFT JOIN degree USING (node)"""),
    ("degree_centrality",),
)
def _(spark, folder):
    return network.behavior_network(inputs.classified_prompts(spark, folder))[0]


@register("network_edges", with_prompts(f", {EDGES_CTE} SELECT * FROM links"))
def _(spark, folder):
    return network.behavior_network(inputs.classified_prompts(spark, folder))[1]


@register(
    "network_top_edges",
    with_prompts(f", {EDGES_CTE} SELECT * FROM links ORDER BY weight DESC, \"source\", target LIMIT 30"),
)
def _(spark, folder):
    return network.top_edges(network.behavior_network(inputs.classified_prompts(spark, folder))[1])
