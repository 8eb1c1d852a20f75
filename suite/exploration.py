"""Exploratory queries: volumes, lengths, missing values, words, shares, tests, sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text
from colloquy.functions.text import (
    clean_text, content_tokens, length_category, period_bin, word_count,
)
from colloquy.operators import exploratory, sketches, trendtests
from suite.analytics import FIT_COLUMNS, FIT_DOUBLES, regression_sql, unpivot_sql
from suite.inputs import WS, table, text_table
from suite.registry import register

STOPWORDS = ("the", "and", "that", "der", "die", "und", "les", "des", "une", "que")
SQL_STOPWORDS = ", ".join(f"'{w}'" for w in STOPWORDS)

CLEAN = r"""trim(regexp_replace(regexp_replace(lower(coalesce(text, '')),
  'http[^\x09-\x0d\x1c-\x20\x{85}\p{Z}]+|www[^\x09-\x0d\x1c-\x20\x{85}\p{Z}]+', '', 'g'), '[^a-z]+', ' ', 'g'))"""
TOKENS = f"""cleaned AS (SELECT doc_id, lang, {CLEAN} AS c FROM documents),
  lists AS (SELECT doc_id, lang, c, list_filter(string_split(c, ' '), lambda w: length(w) > 2 AND w NOT IN ({SQL_STOPWORDS})) AS ws FROM cleaned)"""
DOC_WORDS = f"""dw AS (SELECT doc_id, lang, source, '2023-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') AS year_month,
  CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS BIGINT) AS words
  FROM (SELECT *, trim(regexp_replace(text, '{WS}', ' ', 'g')) AS t FROM documents) AS d)"""
LENGTH_SQL = """CASE WHEN words <= 10 THEN 'Very Short (≤10)' WHEN words <= 30 THEN 'Short (11-30)'
  WHEN words <= 100 THEN 'Medium (31-100)' ELSE 'Long (>100)' END"""
SIZE_SQL = """CASE WHEN num_prompts <= 1 THEN 'Single-turn' WHEN num_prompts <= 3 THEN 'Short (2-3 turns)'
  WHEN num_prompts <= 10 THEN 'Medium (4-10 turns)' ELSE 'Long (>10 turns)' END"""


def _documents(spark, folder):
    """Documents with word counts and a month by id."""
    month = F.concat(F.lit("2023-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"))
    return text_table(spark, folder, "documents").select(
        "doc_id", "lang", "source", "text", month.alias("year_month"),
        word_count(text.normalize_whitespace(F.col("text"))).alias("words"),
    )


@register("clean_text", f"WITH {TOKENS} SELECT doc_id, c AS cleaned, CAST(len(ws) AS INTEGER) AS content_words FROM lists")
def _(spark, folder):
    docs = text_table(spark, folder, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned"))
    return docs.withColumn("content_words", F.size(content_tokens(F.col("cleaned"), STOPWORDS)))


@register("top_words", f"WITH {TOKENS} SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM lists) AS t GROUP BY word ORDER BY n DESC, word LIMIT 30")
def _(spark, folder):
    return exploratory.top_words(exploratory.word_frequencies(text_table(spark, folder, "documents"), "text", STOPWORDS))


@register(
    "word_totals",
    f"WITH {TOKENS} SELECT count(DISTINCT word) AS unique_words, count(*) AS total_words FROM (SELECT unnest(ws) AS word FROM lists) AS t",
)
def _(spark, folder):
    return exploratory.word_totals(exploratory.word_frequencies(text_table(spark, folder, "documents"), "text", STOPWORDS))


def _ngram_sql(n: int) -> str:
    joined = " || ' ' || ".join(f"ws[i + {k}]" for k in range(n))
    return f"""WITH {TOKENS}, grams AS (SELECT {joined} AS ngram FROM (SELECT ws, unnest(generate_series(1, len(ws) - {n - 1})) AS i FROM lists) AS t)
      SELECT ngram, count(*) AS n FROM grams GROUP BY ngram ORDER BY n DESC, ngram LIMIT 20"""


@register("top_bigrams", _ngram_sql(2))
def _(spark, folder):
    return exploratory.top_ngrams(text_table(spark, folder, "documents"), "text", 2, stopwords=STOPWORDS)


@register("top_trigrams", _ngram_sql(3))
def _(spark, folder):
    return exploratory.top_ngrams(text_table(spark, folder, "documents"), "text", 3, stopwords=STOPWORDS)


VOLUME = """volume AS (SELECT strftime(l_shipdate, '%Y-%m') AS year_month, count(*) AS num_records, avg(l_quantity) AS mean_value,
  quantile_cont(l_quantity, 0.5) AS median_value, stddev_samp(l_quantity) AS std_value FROM lineitem GROUP BY 1)"""


def _volume(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("year_month", F.date_format("l_shipdate", "yyyy-MM"))
    return exploratory.monthly_volume(lines, "year_month", "l_quantity")


@register(
    "monthly_volume",
    f"""WITH {VOLUME} SELECT *, CAST(sum(num_records) OVER (ORDER BY year_month) AS BIGINT) AS cumulative_records,
        (num_records / lag(num_records) OVER (ORDER BY year_month) - 1) * 100 AS growth_pct FROM volume""",
    ("mean_value", "median_value", "std_value", "growth_pct"),
    digits=7,
)
def _(spark, folder):
    return _volume(spark, folder)


@register(
    "volume_summary",
    f"""WITH {VOLUME} SELECT (SELECT year_month FROM volume ORDER BY num_records DESC, year_month LIMIT 1) AS busiest_period,
        max(num_records) AS busiest_records, (SELECT year_month FROM volume ORDER BY num_records, year_month LIMIT 1) AS quietest_period,
        min(num_records) AS quietest_records, avg(num_records) AS mean_records,
        stddev_samp(num_records) / avg(num_records) * 100 AS variation_pct FROM volume""",
    ("mean_records", "variation_pct"),
    digits=7,
)
def _(spark, folder):
    return exploratory.volume_summary(_volume(spark, folder), "year_month")


@register(
    "length_statistics",
    f"""WITH {DOC_WORDS} SELECT count(*) AS num_records, avg(words) AS mean, stddev_samp(words) AS std, min(words) AS min, max(words) AS max,
        {", ".join(f"quantile_cont(words, {p}) AS p{round(p * 100)}" for p in exploratory.PERCENTILES)},
        skewness(words) AS skewness, kurtosis(words) AS kurtosis FROM dw""",
    ("mean", "std", *[f"p{round(p * 100)}" for p in exploratory.PERCENTILES], "skewness", "kurtosis"),
    digits=6,
)
def _(spark, folder):
    return exploratory.length_statistics(_documents(spark, folder), "words")


@register(
    "length_cdf",
    f"""WITH {DOC_WORDS}, h AS (SELECT words AS "value", count(*) AS n FROM dw GROUP BY words)
        SELECT "value", n, sum(n) OVER (ORDER BY "value") / (SELECT count(*) FROM dw) AS cumulative_probability FROM h""",
    ("cumulative_probability",),
)
def _(spark, folder):
    return exploratory.empirical_cdf(_documents(spark, folder), "words")


@register(
    "length_categories",
    f"WITH {DOC_WORDS} SELECT {LENGTH_SQL} AS length_category, count(*) AS num_records, avg(words) AS mean_words FROM dw GROUP BY 1",
    ("mean_words",),
)
def _(spark, folder):
    docs = _documents(spark, folder).withColumn("length_category", length_category(F.col("words")))
    return docs.groupBy("length_category").agg(F.count(F.lit(1)).alias("num_records"), F.avg("words").alias("mean_words"))


@register(
    "missing_values",
    """WITH joined AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
       """ + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, (count(*) - count({c})) / count(*) * 100 AS missing_pct,
            100 - (count(*) - count({c})) / count(*) * 100 AS complete_pct FROM joined""" for c in ("doc_id", "lang", "quality", "toxic")
    ),
    ("missing_pct", "complete_pct"),
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return exploratory.missing_values(docs.join(table(spark, folder, "labels"), "doc_id", "left"))


STATS = f"""stats AS (SELECT o_custkey AS conversation_id, count(o_orderstatus) AS num_prompts, avg(o_totalprice) AS avg_prompt_length,
    sum(o_totalprice) AS total_words, min(o_orderdate) AS start_time FROM orders GROUP BY 1),
  sized AS (SELECT *, {SIZE_SQL} AS conv_category FROM stats)"""


def _order_statistics(spark, folder):
    return exploratory.conversation_statistics(
        table(spark, folder, "orders"), "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus"
    ).withColumnRenamed("o_custkey", "conversation_id")


@register(
    "conversation_statistics",
    f"""WITH dwc AS (SELECT CAST(conv_id AS VARCHAR) AS conversation_id, turn, text,
          CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS BIGINT) AS words
          FROM (SELECT *, trim(regexp_replace(text, '{WS}', ' ', 'g')) AS t FROM conversations WHERE role = 'user') AS c),
        stats AS (SELECT conversation_id, count(text) AS num_prompts, avg(words) AS avg_prompt_length, CAST(sum(words) AS BIGINT) AS total_words,
          min(turn) AS start_time FROM dwc GROUP BY 1)
        SELECT *, {SIZE_SQL} AS conv_category FROM stats""",
    ("avg_prompt_length",),
)
def _(spark, folder):
    users = table(spark, folder, "conversations").filter(F.col("role") == "user").select(
        F.col("conv_id").cast("string").alias("conversation_id"), "turn", "text",
        word_count(text.normalize_whitespace(F.col("text"))).alias("words"),
    )
    return exploratory.conversation_statistics(users, "conversation_id", "words", "turn", "text")


@register(
    "prompts_by_conversation_size",
    f"""WITH {STATS} SELECT conv_category, count(*) AS num_records, avg(floor(o_totalprice / 1000)) AS mean_value,
        quantile_cont(floor(o_totalprice / 1000), 0.5) AS median_value FROM orders JOIN sized ON conversation_id = o_custkey GROUP BY 1""",
    ("mean_value", "median_value"),
    digits=7,
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("conversation_id"), F.floor(F.col("o_totalprice") / 1000).alias("length")
    )
    joined = exploratory.with_conversation_category(orders, _order_statistics(spark, folder))
    return exploratory.length_by_category(joined, "conv_category", "length")


@register(
    "length_turn_fit",
    f"WITH {STATS} SELECT regr_slope(avg_prompt_length, num_prompts) AS slope, regr_intercept(avg_prompt_length, num_prompts) AS intercept FROM sized",
    ("slope", "intercept"),
    digits=4,
)
def _(spark, folder):
    return exploratory.length_turn_fit(_order_statistics(spark, folder))


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
SHARES = "shares AS (SELECT strftime(ts, '%Y-%m-%d') AS \"day\", " + ", ".join(
    f"count_if(event_type = '{c}') / count(*) * 100 AS \"{c}\"" for c in EVENT_TYPES
) + " FROM events GROUP BY 1)"


def _shares(spark, folder):
    events = table(spark, folder, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return exploratory.category_shares(
        events, "day", "event_type", list(EVENT_TYPES), {"click_view": ["click", "view"]}
    )


@register(
    "category_shares",
    f"WITH {SHARES} SELECT *, \"click\" + \"view\" AS click_view FROM shares",
    (*EVENT_TYPES, "click_view"),
)
def _(spark, folder):
    return _shares(spark, folder)


@register(
    "category_share_table",
    """SELECT strftime(ts, '%Y-%m-%d') AS "day", event_type, count(*) AS num_records,
              count(*) / sum(count(*)) OVER (PARTITION BY strftime(ts, '%Y-%m-%d')) * 100 AS share_pct FROM events GROUP BY 1, 2""",
    ("share_pct",),
)
def _(spark, folder):
    events = table(spark, folder, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return exploratory.category_share_table(events, "day", "event_type")


@register(
    "category_share_trends",
    f"""WITH {SHARES}, {regression_sql(unpivot_sql('shares', '"day"', ('click', 'view')))}
        SELECT {FIT_COLUMNS}, first_value, last_value, r * r AS r_squared, last_value - first_value AS total_change,
               (last_value / first_value - 1) * 100 AS relative_change_pct FROM tested""",
    (*FIT_DOUBLES, "first_value", "last_value", "r_squared", "total_change", "relative_change_pct"),
    digits=7,
)
def _(spark, folder):
    fitted = trendtests.linear_trends(_shares(spark, folder), "day", ["click", "view"])
    return trendtests.with_change(fitted)


@register(
    "trend_by_length",
    f"""WITH {DOC_WORDS}, monthly AS (SELECT {LENGTH_SQL} AS length_category, year_month, avg(CAST(lang = 'en' AS INTEGER)) * 100 AS english_share FROM dw GROUP BY ALL),
        {regression_sql(unpivot_sql('monthly', 'year_month', ('english_share',), 'length_category'), ('length_category',))}
        SELECT length_category, {FIT_COLUMNS}, first_value, last_value FROM tested""",
    (*FIT_DOUBLES, "first_value", "last_value"),
    digits=7,
)
def _(spark, folder):
    docs = _documents(spark, folder).withColumn("length_category", length_category(F.col("words")))
    monthly = docs.groupBy("length_category", "year_month").agg(
        (F.avg((F.col("lang") == "en").cast("int")) * 100).alias("english_share")
    )
    return trendtests.linear_trends(monthly, "year_month", ["english_share"], ["length_category"])


@register(
    "mann_kendall",
    f"""WITH {VOLUME}, y AS (SELECT row_number() OVER (ORDER BY year_month) AS i, mean_value AS v FROM volume),
        s AS (SELECT sum(sign(b.v - a.v)) AS s, (SELECT count(*) FROM y) AS n FROM y a JOIN y b ON b.i > a.i),
        scored AS (SELECT *, CASE WHEN s > 0 THEN (s - 1) WHEN s < 0 THEN (s + 1) ELSE 0 END / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) AS z FROM s),
        grid AS (SELECT unnest(generate_series(0, 2000)) AS k),
        area AS (SELECT z, abs(z) / 2000 / 3 * sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
                 * exp(-0.5 * (abs(z) * k / 2000) ** 2) / sqrt(2 * pi())) AS half FROM scored, grid GROUP BY z)
        SELECT CASE WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing' ELSE 'no trend' END AS trend, n AS num_periods,
               CAST(s AS DOUBLE) AS s, scored.z AS z, 1 - 2 * half AS p_value FROM scored JOIN area ON scored.z = area.z""",
    ("s", "z", "p_value"),
    digits=8,
)
def _(spark, folder):
    return trendtests.mann_kendall(_volume(spark, folder), "year_month", "mean_value")


@register(
    "chi_square",
    """WITH o AS (SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS o FROM orders GROUP BY ALL),
       rt AS (SELECT r, sum(o) AS rt FROM o GROUP BY r), ct AS (SELECT c, sum(o) AS ct FROM o GROUP BY c),
       e AS (SELECT r, c, rt * ct / (SELECT sum(o) FROM o) AS e FROM rt CROSS JOIN ct),
       x AS (SELECT sum((coalesce(o, 0) - e) ** 2 / e) AS x, (SELECT (count(*) - 1) FROM rt) * (SELECT (count(*) - 1) FROM ct) AS dof
             FROM e LEFT JOIN o USING (r, c))
       SELECT x AS chi_square, dof, (SELECT count(*) FROM orders) AS num_records,
              exp(-x / 2) * list_sum(list_transform(generate_series(0, dof // 2 - 1), lambda i: (x / 2) ** i / gamma(i + 1))) AS p_value FROM x""",
    ("chi_square", "p_value"),
)
def _(spark, folder):
    return trendtests.chi_square_independence(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority")


@register(
    "period_bins",
    """SELECT CASE WHEN ym <= '1995-06' THEN 'Early' WHEN ym >= '1997-01' THEN 'Late' ELSE 'Middle' END AS period, o_orderpriority, count(*) AS num_records
       FROM (SELECT strftime(o_orderdate, '%Y-%m') AS ym, o_orderpriority FROM orders) AS o GROUP BY ALL""",
)
def _(spark, folder):
    month = F.date_format("o_orderdate", "yyyy-MM")
    binned = table(spark, folder, "orders").select(period_bin(month, "1995-06", "1997-01").alias("period"), "o_orderpriority")
    return binned.groupBy("period", "o_orderpriority").agg(F.count(F.lit(1)).alias("num_records"))


@register(
    "iqr_outliers",
    f"""WITH {DOC_WORDS}, q AS (SELECT quantile_cont(words, 0.25) AS q1, quantile_cont(words, 0.75) AS q3 FROM dw)
        SELECT doc_id, words FROM dw, q WHERE words < q1 - 3 * (q3 - q1) OR words > q3 + 3 * (q3 - q1)""",
)
def _(spark, folder):
    return exploratory.iqr_outliers(_documents(spark, folder), "words").select("doc_id", "words")


@register(
    "clean_prompts",
    f"""WITH {DOC_WORDS}, cut AS (SELECT * FROM dw WHERE words >= 2),
        capped AS (SELECT d.*, t.text FROM cut d JOIN documents t USING (doc_id) WHERE words <= (SELECT quantile_cont(words, 0.99) FROM cut)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY lang, text, year_month ORDER BY doc_id) AS rn FROM capped)
        SELECT doc_id, lang, year_month, words FROM placed WHERE rn = 1""",
)
def _(spark, folder):
    kept = exploratory.clean_prompts(
        _documents(spark, folder), "words", ("text", "year_month"), ("lang", "text", "year_month"), order=("doc_id",)
    )
    return kept.select("doc_id", "lang", "year_month", "words")


@register(
    "date_range",
    """SELECT o_orderstatus, count(*) AS num_records FROM orders
       WHERE o_orderdate BETWEEN TIMESTAMP '1995-04-01' AND TIMESTAMP '1996-05-31' GROUP BY 1""",
)
def _(spark, folder):
    kept = exploratory.date_range(table(spark, folder, "orders"), "o_orderdate", "1995-04-01", "1996-05-31")
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("num_records"))


# The lexicon is derived from the data: the words that close a line, their valence by the parity of their length.
LEXICON_SQL = f"""ends AS (SELECT word, count(*) AS n FROM (SELECT string_split(c, ' ')[-1] AS word FROM cleaned WHERE c <> '') AS t GROUP BY word),
  lexicon AS (SELECT word AS term, CASE WHEN length(word) % 2 = 0 THEN 1.0 ELSE -1.5 END AS valence FROM ends)"""
SENTIMENT_SQL = f"""{TOKENS}, {LEXICON_SQL},
  tok AS (SELECT doc_id, unnest(string_split(c, ' ')) AS term FROM cleaned WHERE c <> ''),
  sums AS (SELECT d.doc_id, d.lang, count(t.term) AS n, count_if(valence > 0) AS pos, count_if(valence < 0) AS neg, coalesce(sum(valence), 0) AS s
           FROM documents d LEFT JOIN tok t USING (doc_id) LEFT JOIN lexicon USING (term) GROUP BY ALL),
  sentiment AS (SELECT doc_id, lang, CASE WHEN n = 0 THEN 0 ELSE pos / n END AS sentiment_positive, CASE WHEN n = 0 THEN 0 ELSE neg / n END AS sentiment_negative,
           CASE WHEN n = 0 THEN 1 ELSE (n - pos - neg) / n END AS sentiment_neutral, s / sqrt(s * s + 15) AS sentiment_compound FROM sums)"""
SENTIMENT_DOUBLES = ("sentiment_positive", "sentiment_negative", "sentiment_neutral", "sentiment_compound")


def _sentiment(spark, folder):
    docs = text_table(spark, folder, "documents").select("doc_id", "lang", "text")
    last = F.element_at(F.split(clean_text(F.col("text")), " "), -1)
    lexicon = docs.select(last.alias("term")).filter("term <> ''").distinct().withColumn(
        "valence", F.when(F.char_length("term") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.5))
    )
    scores = exploratory.lexicon_sentiment(docs, lexicon, "text", "doc_id")
    return docs.select("doc_id", "lang").join(scores, "doc_id")


@register("sentiment", f"WITH {SENTIMENT_SQL} SELECT * FROM sentiment", SENTIMENT_DOUBLES)
def _(spark, folder):
    return _sentiment(spark, folder)


@register(
    "sentiment_by_language",
    f"""WITH {SENTIMENT_SQL} SELECT lang, count(*) AS num_records, avg(sentiment_compound) AS mean_compound, stddev_samp(sentiment_compound) AS std_compound,
        avg(abs(sentiment_compound)) AS mean_intensity, avg(CAST(sentiment_compound > 0 AS INTEGER)) * 100 AS positive_pct,
        avg(CAST(sentiment_compound < 0 AS INTEGER)) * 100 AS negative_pct, avg(sentiment_positive) AS mean_positive,
        avg(sentiment_neutral) AS mean_neutral, avg(sentiment_negative) AS mean_negative FROM sentiment GROUP BY lang""",
    ("mean_compound", "std_compound", "mean_intensity", "positive_pct", "negative_pct", "mean_positive", "mean_neutral", "mean_negative"),
)
def _(spark, folder):
    return exploratory.sentiment_by(_sentiment(spark, folder), "lang")


@register(
    "sketched_quantiles",
    """SELECT event_type, count(value) AS num_records, unnest([0.25, 0.5, 0.75, 0.9, 0.99]::DOUBLE[]) AS q, TRUE AS within_bound
       FROM events WHERE value IS NOT NULL GROUP BY event_type""",
)
def _(spark, folder):
    """Quantiles of a value by type, from sketches by type and day; their ranks are measured over all events."""
    events = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    daily = sketches.quantile_sketches(events, ["event_type", "day"], "value")
    found = sketches.sketch_quantiles(sketches.merge_sketches(daily, ["event_type"]), ["event_type"], (0.25, 0.5, 0.75, 0.9, 0.99))
    measured = sketches.rank_errors(events, ["event_type"], "value", found)
    return measured.select("event_type", "num_records", "q", (F.col("rank_error") <= sketches.rank_bound()).alias("within_bound"))
