"""Exploratory reports: volumes, length statistics, missing values, words, shares, sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions.planning import explode_once, select_once
from colloquy.functions.stats import safe_ratio
from colloquy.functions.text import clean_text, content_tokens, conversation_category, ngrams, words
from colloquy.operators.canonical import keep_first, quantile
from colloquy.operators.diagnostics import unfold

PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def date_range(df: DataFrame, timestamp: str, start: str, end: str) -> DataFrame:
    """Rows between two instants, both inclusive."""
    return df.filter(F.col(timestamp).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def iqr_outliers(df: DataFrame, column: str, k: float = 3.0) -> DataFrame:
    """Rows outside ``[Q1 − k·IQR, Q3 + k·IQR]``; quartiles come from the histogram of the column."""
    histogram = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    quartiles = histogram.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)), F.col("_n"))).scalar()
    low, high = F.get(F.col("_q"), F.lit(0)), F.get(F.col("_q"), F.lit(1))
    reach = (high - low) * k
    return df.withColumn("_q", quartiles).filter(
        (F.col(column) < low - reach) | (F.col(column) > high + reach)
    ).drop("_q")


def clean_prompts(
    df: DataFrame, word_column: str = "prompt_word_count", critical: tuple[str, ...] = ("prompt", "datetime", "year_month"),
    keys: tuple[str, ...] = ("conversation_id", "prompt", "datetime"), min_words: int = 2, q: float = 0.99,
    order: tuple[str, ...] = ("turn_index",),
) -> DataFrame:
    """Drop short prompts, those above the length quantile, incomplete rows and repeats."""
    long_enough = df.filter(F.col(word_column) >= min_words)
    limit = quantile(long_enough, word_column, q).scalar()
    capped = long_enough.filter(F.col(word_column) <= limit).dropna(subset=list(critical))
    return keep_first(capped, list(keys), [c for c in order if c in df.columns])


def monthly_volume(df: DataFrame, period: str, value: str) -> DataFrame:
    """Rows per period with mean, median, deviation of ``value``; running total and growth (%).

    Periods are first cut to (period, value) counts, so the exact median needs no period's rows.
    ``value`` is a whole-number column such as a word count, with far fewer values than rows.
    """
    pairs = df.filter(F.col(period).isNotNull()).groupBy(period, value).agg(F.count(F.lit(1)).alias("_n"))
    v, n = F.col(value).cast("double"), F.col("_n")
    known = F.when(F.col(value).isNotNull(), n).otherwise(F.lit(0))
    base = pairs.groupBy(period).agg(
        F.sum(n).alias("num_records"),
        safe_ratio(F.sum(v * n), F.sum(known)).alias("mean_value"),
        F.percentile(value, F.lit(0.5), n).alias("median_value"),
        F.sum(known).cast("double").alias("_k"),
        F.sum(v * n).alias("_s1"),
        F.sum(v * v * n).alias("_s2"),
    )
    spread = F.greatest(F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("_k"), F.lit(0.0))
    ordered = W.orderBy(period)
    previous = F.lag("num_records").over(ordered)
    return base.select(
        period, "num_records", "mean_value", "median_value",
        F.when(F.col("_k") > 1, F.sqrt(spread / F.nullif(F.col("_k") - 1, F.lit(0.0)))).alias("std_value"),
        F.sum("num_records").over(ordered.rowsBetween(W.unboundedPreceding, 0)).alias("cumulative_records"),
        ((F.try_divide(F.col("num_records"), previous) - 1) * 100).alias("growth_pct"),
    )


def volume_summary(volume: DataFrame, period: str) -> DataFrame:
    """Busiest and quietest period (first wins ties), mean volume and coefficient of variation (%)."""
    ranked = F.struct(F.col("num_records").alias("n"), F.col(period).alias("p"))
    highest = F.min(F.struct((-F.col("num_records")).alias("n"), F.col(period).alias("p")))["p"]
    return volume.agg(
        highest.alias("busiest_period"), F.max("num_records").alias("busiest_records"),
        F.min(ranked)["p"].alias("quietest_period"), F.min("num_records").alias("quietest_records"),
        F.avg("num_records").alias("mean_records"),
        (F.try_divide(F.stddev_samp("num_records"), F.avg("num_records")) * 100).alias("variation_pct"),
    )


def length_statistics(df: DataFrame, column: str, percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """Count, mean, deviation, range, percentiles and bias-corrected skewness and kurtosis.

    Works on the histogram of the column; central moments are taken around the mean.
    """
    histogram = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    weight, value = F.col("_n").cast("double"), F.col(column).cast("double")
    mean = histogram.agg(F.sum(value * weight) / F.sum(weight)).scalar()
    centred = histogram.withColumn("_d", value - mean)
    totals = centred.agg(
        F.sum("_n").alias("num_records"),
        (F.sum(value * weight) / F.sum(weight)).alias("mean"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        F.percentile(column, F.array(*[F.lit(p) for p in percentiles]), F.col("_n")).alias("_p"),
        *[F.sum(weight * F.pow("_d", F.lit(float(i)))).alias(f"_m{i}") for i in (2, 3, 4)],
    )
    n = F.col("num_records").cast("double")
    m2 = F.col("_m2") / n
    g1 = F.try_divide(F.col("_m3") / n, F.pow(m2, F.lit(1.5)))
    g2 = F.try_divide(F.col("_m4") / n, m2 * m2) - 3
    skewness = F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2)
    kurtosis = F.try_divide((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3))
    return totals.select(
        "num_records", "mean", F.sqrt(F.try_divide(F.col("_m2"), n - 1)).alias("std"), "min", "max",
        *[F.get("_p", F.lit(i)).alias(f"p{round(p * 100)}") for i, p in enumerate(percentiles)],
        skewness.alias("skewness"), kurtosis.alias("kurtosis"),
    )


def empirical_cdf(df: DataFrame, column: str) -> DataFrame:
    """``value, n, cumulative_probability`` per distinct value of a whole-number column.

    The running sum is over distinct values (for word counts at most the longest text), not rows.
    """
    histogram = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = histogram.agg(F.sum("n")).scalar()
    upto = F.sum("n").over(W.orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    return histogram.select("value", "n", (upto / total).alias("cumulative_probability"))


def missing_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls per column with missing and complete percentages, in one pass."""
    names = columns or df.columns
    totals = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(names)],
    )
    rows = []
    for i, name in enumerate(names):
        share = safe_ratio(F.col(f"_m{i}"), F.col("_n")) * 100
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"), F.col(f"_m{i}").alias("missing_count"),
                share.alias("missing_pct"), (F.lit(100.0) - share).alias("complete_pct"),
            )
        )
    return unfold(rows, totals)


def conversation_statistics(
    df: DataFrame, conversation: str = "conversation_id", word_column: str = "prompt_word_count",
    timestamp: str = "timestamp", text_column: str = "prompt_text",
) -> DataFrame:
    """Prompts, words, start time and size category per conversation."""
    grouped = df.filter(F.col(conversation).isNotNull()).groupBy(conversation).agg(
        F.count(text_column).alias("num_prompts"), F.avg(word_column).alias("avg_prompt_length"),
        F.sum(word_column).alias("total_words"), F.min(timestamp).alias("start_time"),
    )
    return grouped.withColumn("conv_category", conversation_category(F.col("num_prompts")))


def with_conversation_category(
    prompts: DataFrame, statistics: DataFrame, conversation: str = "conversation_id"
) -> DataFrame:
    """Give every prompt the size category of its conversation (AQE splits a skewed conversation)."""
    return prompts.join(statistics.select(conversation, "conv_category"), conversation)


def length_by_category(df: DataFrame, category: str, value: str) -> DataFrame:
    """Rows, mean and exact median of a whole-number column per category, from (category, value) counts."""
    pairs = df.groupBy(category, value).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy(category).agg(
        F.sum("_n").alias("num_records"),
        safe_ratio(F.sum(F.col(value) * F.col("_n")), F.sum("_n")).alias("mean_value"),
        F.percentile(value, F.lit(0.5), F.col("_n")).alias("median_value"),
    )


def length_turn_fit(statistics: DataFrame) -> DataFrame:
    """Least-squares line of mean prompt length over number of prompts."""
    return statistics.agg(
        F.regr_slope("avg_prompt_length", "num_prompts").alias("slope"),
        F.regr_intercept("avg_prompt_length", "num_prompts").alias("intercept"),
    )


def category_shares(
    df: DataFrame, period: str, category: str, categories: list[str], combined: dict[str, list[str]] | None = None
) -> DataFrame:
    """Share (%) of the given categories per period, wide, with optional sums of several categories.

    Other categories count in the total only; :func:`category_share_table` lists them all.
    """
    counts = df.filter(F.col(period).isNotNull() & F.col(category).isNotNull()).groupBy(period).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(category) == c).alias(f"_c{i}") for i, c in enumerate(categories)],
    )
    shares = {c: safe_ratio(F.col(f"_c{i}"), F.col("_n")) * 100 for i, c in enumerate(categories)}
    for name, parts in (combined or {}).items():
        total = F.lit(0.0)
        for part in parts:
            total = total + shares[part]
        shares[name] = total
    return counts.select(period, *[share.alias(name) for name, share in shares.items()])


def category_share_table(df: DataFrame, period: str, category: str) -> DataFrame:
    """``period, category, num_records, share_pct`` for every category found in the data."""
    counts = df.filter(F.col(period).isNotNull() & F.col(category).isNotNull()).groupBy(period, category).agg(
        F.count(F.lit(1)).alias("num_records")
    )
    totals = counts.groupBy(period).agg(F.sum("num_records").alias("_all"))
    return counts.join(totals, period).select(
        period, category, "num_records", (F.col("num_records") / F.col("_all") * 100).alias("share_pct")
    )


def word_frequencies(df: DataFrame, text_column: str, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """``word, n`` over the cleaned content tokens of all texts."""
    tokens = content_tokens(clean_text(F.col(text_column)), stopwords)
    return explode_once(df, [], tokens, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def word_totals(frequencies: DataFrame) -> DataFrame:
    return frequencies.agg(
        F.count(F.lit(1)).alias("unique_words"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_words")
    )


def top_words(frequencies: DataFrame, n: int = 30) -> DataFrame:
    return frequencies.orderBy(F.desc("n"), "word").limit(n)


def top_ngrams(
    df: DataFrame, text_column: str, size: int, n: int = 20, stopwords: tuple[str, ...] = ()
) -> DataFrame:
    """Most frequent runs of ``size`` content tokens over all texts."""
    tokens = select_once(df, [], {"_t": content_tokens(clean_text(F.col(text_column)), stopwords)})
    grams = explode_once(tokens, [], ngrams(F.col("_t"), size), "ngram")
    counts = grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "ngram").limit(n)


def lexicon_sentiment(
    df: DataFrame, lexicon: DataFrame, text_column: str, id_column: str, alpha: float = 15.0, salts: int = 16
) -> DataFrame:
    """Token-level sentiment from a ``term, valence`` table: shares and a bounded compound score.

    Texts without tokens are neutral. Tokens are folded to counted terms inside each text, so that a
    text brings a common term to the join once, however often it holds it; a term is salted by its
    text, and the lexicon repeated for each salt, so that no term is one task's. The number of tokens
    comes along with one row per text, the empty term.
    """
    cleaned = select_once(df, [id_column], {"_clean": clean_text(F.col(text_column))})
    tokens = F.coalesce(words(F.col("_clean")), F.array().cast("array<string>"))
    ordered = select_once(cleaned, [id_column], {"_ordered": F.array_sort(tokens)})
    at = F.transform("_ordered", lambda t, i: F.struct(t.alias("term"), i.alias("i")))
    ends = F.filter(at, lambda e: ~F.coalesce(F.get(F.col("_ordered"), e["i"] + 1) == e["term"], F.lit(False)))
    held = select_once(ordered, [id_column], {"_ends": ends, "_size": F.size("_ordered")})
    runs = F.transform("_ends", lambda e, k: F.struct(
        e["term"].alias("term"), (e["i"] - F.coalesce(F.get(F.col("_ends"), k - 1)["i"], F.lit(-1))).alias("n")
    ))
    counted = F.concat(runs, F.array(F.struct(F.lit("").alias("term"), F.col("_size").alias("n"))))
    terms = explode_once(held, [id_column], counted, "_t").select(
        id_column, "_t.term", "_t.n", F.pmod(F.xxhash64(id_column), F.lit(salts)).alias("_salt")
    )
    repeated = lexicon.filter("term != ''").select("term", "valence", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    valued = terms.join(repeated.withColumn("_salt", F.col("_salt").cast("long")), ["term", "_salt"], "left")
    valence, n = F.coalesce("valence", F.lit(0.0)), F.col("n")
    sums = valued.groupBy(id_column).agg(
        F.sum(F.when(F.col("term") == "", n).otherwise(0)).alias("_n"),
        F.sum(F.when(valence > 0, n).otherwise(0)).alias("_pos"),
        F.sum(F.when(valence < 0, n).otherwise(0)).alias("_neg"),
        F.sum(valence * n).alias("_s"),
    )
    total = F.col("_s")
    return sums.select(
        id_column,
        safe_ratio(F.col("_pos"), F.col("_n")).alias("sentiment_positive"),
        safe_ratio(F.col("_neg"), F.col("_n")).alias("sentiment_negative"),
        F.when(F.col("_n") == 0, F.lit(1.0)).otherwise(
            safe_ratio(F.col("_n") - F.col("_pos") - F.col("_neg"), F.col("_n"))
        ).alias("sentiment_neutral"),
        (total / F.sqrt(total * total + alpha)).alias("sentiment_compound"),
    )


def sentiment_by(df: DataFrame, group: str) -> DataFrame:
    """Mean, deviation, intensity and positive / negative shares (%) per group."""
    compound = F.col("sentiment_compound")
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("num_records"),
        F.avg(compound).alias("mean_compound"),
        F.stddev_samp(compound).alias("std_compound"),
        F.avg(F.abs(compound)).alias("mean_intensity"),
        (F.avg((compound > 0).cast("int")) * 100).alias("positive_pct"),
        (F.avg((compound < 0).cast("int")) * 100).alias("negative_pct"),
        F.avg("sentiment_positive").alias("mean_positive"),
        F.avg("sentiment_neutral").alias("mean_neutral"),
        F.avg("sentiment_negative").alias("mean_negative"),
    )
