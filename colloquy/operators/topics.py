"""Topic assignment, topic terms, topic statistics, TF-IDF and LDA."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.planning import explode_once, select_once
from colloquy.functions.stats import safe_ratio
from colloquy.functions.text import WORD, without_links
from colloquy.operators.clusters import reduce_dimensions
from colloquy.operators.density import NOISE, density_clusters
from colloquy.operators.lda import TopicModel, fit_topic_models
from colloquy.operators.sequences import top_n_per_group
from colloquy.session import shared_folder, written_table


def english_stopwords() -> tuple[str, ...]:
    """Spark's own English stopword list (needs a running session)."""
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def topic_tokens(text: Column, stopwords: tuple[str, ...]) -> Column:
    """Lower-cased tokens of two or more word characters, stopwords removed."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD}{{2,}})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found


def term_counts(df: DataFrame, text_column: str, topic: str, stopwords: tuple[str, ...]) -> DataFrame:
    """``topic, term, n, docs``: occurrences and documents per topic and term, in one shuffle.

    Occurrences and distinct terms of a document are exploded together as (1, 0) and (0, 1), so both
    counts are plain sums that combine map-side, also for a topic that holds most documents.
    """
    tokens = select_once(df, [topic], {"_t": topic_tokens(F.col(text_column), stopwords)})
    occurrences = F.transform("_t", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("d")))
    distinct = F.transform(
        F.array_distinct("_t"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("d"))
    )
    rows = explode_once(tokens, [topic], F.concat(occurrences, distinct), "_e")
    return rows.groupBy(topic, F.col("_e.term").alias("term")).agg(
        F.sum("_e.n").alias("n"), F.sum("_e.d").alias("docs")
    )


def topic_sizes(df: DataFrame, topic: str = "topic") -> DataFrame:
    return df.groupBy(topic).agg(F.count(F.lit(1)).alias("num_records"))


def top_terms_by_topic(
    df: DataFrame, text_column: str = "prompt_text", topic: str = "topic", top_n: int = 10,
    stopwords: tuple[str, ...] | None = None, min_df: int = 2,
) -> DataFrame:
    """``topic, num_records, top_terms``; terms must be in ``min_df`` documents (1 in lone ones).

    Topics without a term that qualifies are kept with empty ``top_terms``. Equal counts are ordered
    by term.
    """
    words = english_stopwords() if stopwords is None else stopwords
    assigned = df.filter(F.col(topic).isNotNull() & (F.col(topic) != NOISE))
    sizes = topic_sizes(assigned, topic)
    counts = term_counts(assigned, text_column, topic, words).join(sizes, topic)
    needed = F.when(F.col("num_records") >= 2, F.lit(min_df)).otherwise(F.lit(1))
    qualified = counts.filter(F.col("docs") >= needed).select(topic, "term", "n")
    best = top_n_per_group(qualified, [topic], [F.desc("n"), F.col("term")], top_n, ["term"])
    joined = best.groupBy(topic).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_rank", "term"))), lambda e: e["term"]), ", "
        ).alias("top_terms")
    )
    return sizes.join(joined, topic, "left").select(
        topic, "num_records", F.coalesce("top_terms", F.lit("")).alias("top_terms")
    )


def topic_diversity(terms: DataFrame) -> DataFrame:
    """Distinct over all listed terms, as one row; 0 without terms."""
    listed = F.filter(F.transform(F.split("top_terms", ","), lambda t: F.trim(t)), lambda t: t != "")
    return terms.select(F.explode(listed).alias("_t")).agg(
        safe_ratio(F.count_distinct("_t"), F.count("_t")).alias("topic_diversity")
    )


def topic_statistics(df: DataFrame, terms: DataFrame, topic: str = "topic") -> DataFrame:
    """One row: documents, topics without the outlier topic, outlier share, term diversity."""
    sizes = topic_sizes(df, topic)
    real = F.when(F.col(topic) != NOISE, F.col(topic))
    noise = F.sum(F.when(F.col(topic) == NOISE, F.col("num_records")).otherwise(F.lit(0)))
    return sizes.agg(
        F.coalesce(F.sum("num_records"), F.lit(0)).alias("num_documents"),
        F.count(real).alias("num_topics"),
        safe_ratio(noise, F.sum("num_records")).alias("noise_fraction"),
    ).withColumn("topic_diversity", topic_diversity(terms).scalar())


def topic_evolution(df: DataFrame, period: str = "year_month", topic: str = "topic") -> DataFrame:
    return df.groupBy(period, topic).agg(F.count(F.lit(1)).alias("count"))


def assign_topics(
    vectors: DataFrame, vector_column: str = "embedding", min_topic_size: int = 50, min_samples: int = 10,
    components: int | None = 5, seed: int = 42,
) -> DataFrame:
    """Topics from embeddings: clusters of varying density, everything else in topic -1.

    Distances are taken between ``components`` principal components; None takes the vectors as they are.
    """
    if components is None:
        return density_clusters(vectors, vector_column, "topic", min_topic_size, min_samples, seed=seed)
    # The components take several passes, and vectors may still have to be computed from texts.
    stored = written_table(vectors.select(vector_column), "topic-vectors")
    reduced = reduce_dimensions(vectors, components, vector_column, "_reduced", fit_on=stored)
    return density_clusters(reduced, "_reduced", "topic", min_topic_size, min_samples, seed=seed).drop("_reduced")


def class_tfidf(
    df: DataFrame, text_column: str = "prompt_text", topic: str = "topic", top_n: int = 10,
    stopwords: tuple[str, ...] | None = None,
) -> DataFrame:
    """``topic, term, n, weight, rank`` by class-based TF-IDF: tf · log(1 + A / f)."""
    words = english_stopwords() if stopwords is None else stopwords
    counts = term_counts(df.filter(F.col(topic).isNotNull()), text_column, topic, words)
    per_topic = counts.groupBy(topic).agg(F.sum("n").alias("_total"))
    average = per_topic.agg(F.avg("_total")).scalar()
    weighted = (
        counts.withColumn("_f", F.sum("n").over(W.partitionBy("term")))
        .join(per_topic, topic)
        .withColumn("weight", F.col("n") / F.col("_total") * F.log1p(average / F.col("_f")))
        .select(topic, "term", "n", "weight")
    )
    ranked = top_n_per_group(weighted, [topic], [F.desc("weight"), F.col("term")], top_n, ["term"])
    return ranked.withColumnRenamed("_rank", "rank")


def _found(rows: np.ndarray, terms: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms and counts of the pairs that occur, in order; terms are below ``size``."""
    pairs, counts = np.unique(rows * size + terms, return_counts=True)
    return *np.divmod(pairs, size), counts


def _words_of(joined: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each word and all words of texts whose words are joined by spaces."""
    lists = pc.split_pattern(joined, " ")
    rows, words = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists))), lists.flatten()
    there = pc.not_equal(words, "")
    return rows[np.asarray(there)], words.filter(there)


def _next_to(rows: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers (first · ``size`` + second) of neighbouring words that both have a code, not -1."""
    both = np.flatnonzero((rows[1:] == rows[:-1]) & (codes[1:] >= 0) & (codes[:-1] >= 0))
    return rows[both], codes[both] * size + codes[both + 1]


def _codes(words: pa.Array, known: pa.Array) -> np.ndarray:
    return np.asarray(pc.index_in(words, value_set=known).fill_null(-1)).astype(np.int64)


def _occurrences(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers with the sum of their counts and how often they are listed, i.e. in how many rows."""
    distinct, places = np.unique(numbers, return_inverse=True)
    return distinct, np.bincount(places, counts, len(distinct)).astype(np.int64), np.bincount(places, minlength=len(distinct))


def _term_vocabulary(tokens: DataFrame, size: int | None, least: float, most: float) -> list[tuple[str, int]]:
    """The ``size`` most frequent words and pairs of neighbouring words with their number of rows, ties by term.

    A pair occurs no more often, nor in more rows, than either of its words, so pairs are counted of words alone
    that themselves reach the count of the last word that would be taken.
    """
    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words = _words_of(batch.column(0))
            coded = words.dictionary_encode()
            _, codes, counts = _found(rows, np.asarray(coded.indices).astype(np.int64), len(coded.dictionary) or 1)
            codes, n, d = _occurrences(codes, counts)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(codes)), pa.array(n), pa.array(d)], ["term", "n", "d"])

    counted = tokens.select("_uni").mapInArrow(singles, "term string, n long, d long")
    counted = written_table(counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "lda-words")
    fitting, order = F.col("d").between(least, most), (F.desc("n"), "term")
    first = counted.filter(fitting).orderBy(*order)
    first = [tuple(r) for r in (first.limit(size) if size else first).collect()]
    lowest = first[-1][1] if size and len(first) >= size else 0
    able = counted.filter((F.col("n") >= lowest) & (F.col("d") >= least)).select("term").orderBy("term")
    words = pa.array([r["term"] for r in able.collect()], pa.string())
    base = len(words)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = _words_of(batch.column(0))
            rows, numbers = _next_to(rows, _codes(found, words), base)
            distinct, own = np.unique(numbers, return_inverse=True)
            _, places, counts = _found(rows, own, len(distinct) or 1)
            places, n, d = _occurrences(places, counts)
            yield pa.RecordBatch.from_arrays([pa.array(distinct[places]), pa.array(n), pa.array(d)], ["pair", "n", "d"])

    counted = tokens.select("_uni").mapInArrow(pairs, "pair long, n long, d long")
    together = counted.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    # The words are in order, so pairs are in the order of their numbers.
    second = together.filter(fitting & (F.col("n") >= lowest)).orderBy(F.desc("n"), "pair")
    second = (second.limit(size) if size else second).collect()
    named = [(f"{words[r['pair'] // base]} {words[r['pair'] % base]}", r["n"], r["d"]) for r in second]
    ordered = sorted([*first, *named], key=lambda r: (-r[1], r[0]))
    return [(term, d) for term, _, d in (ordered[:size] if size else ordered)]


def tfidf_features(
    df: DataFrame, text_column: str = "prompt_text", vocabulary: int | None = 1000, max_df: float = 0.8,
    min_df: float = 10, stopwords: tuple[str, ...] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Unigram and bigram TF-IDF vectors in ``features`` and the vocabulary.

    ``vocabulary`` is the model's size, the most frequent terms, ties by term; None keeps every term that
    ``min_df`` and ``max_df`` leave. Both are shares of the rows below 1, numbers of rows otherwise (a
    ``max_df`` of 1 is a number, too). Weights are those of MLlib's IDF. Tokens and vectors are found once and written.
    """
    stops = pa.array(english_stopwords() if stopwords is None else stopwords, pa.string())

    letters = np.full(256, ord(" "), dtype=np.uint8)
    letters[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)

    @F.arrow_udf("string")
    def tokens_of(lowered: pa.Array) -> pa.Array:
        # The tokens of content_tokens(clean_text()): whatever is not a letter becomes spaces, byte by byte.
        lowered = lowered.cast(pa.string())
        _, offsets, data = lowered.buffers()
        spaced = pa.py_buffer(letters[np.frombuffer(data or b"", dtype=np.uint8)])
        rows, words = _words_of(pa.StringArray.from_buffers(len(lowered), offsets, spaced, offset=lowered.offset))
        kept = np.asarray(pc.greater(pc.binary_length(words), 2)) & ~np.asarray(pc.is_in(words, value_set=stops))
        ends = np.concatenate(([0], np.cumsum(np.bincount(rows[kept], minlength=len(lowered)))))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(kept))), " ")

    tokens = written_table(df.withColumn("_uni", tokens_of(without_links(F.col(text_column)))), "lda-tokens")
    n = tokens.count()
    least, most = (d if d >= 1 else d * n for d in (min_df, max_df))
    chosen = _term_vocabulary(tokens, vocabulary, least, most)
    terms = [term for term, _ in chosen]
    weights = np.array([math.log((n + 1.0) / (d + 1.0)) for _, d in chosen])
    parts = [term.split(" ") for term in terms]
    known = pa.array(sorted({w for p in parts for w in p}), pa.string())
    place = {w: k for k, w in enumerate(known.to_pylist())}
    # Numbers of words, then of pairs, in order, and the terms they stand for.
    numbers = np.array([place[p[0]] if len(p) == 1 else len(place) * (1 + place[p[0]]) + place[p[1]] for p in parts], dtype=np.int64)
    order = np.argsort(numbers)
    ordered = numbers[order]

    @F.arrow_udf("struct<type: tinyint, size: int, indices: array<int>, values: array<double>>")
    def vector(joined: pa.Array) -> pa.Array:
        rows, words = _words_of(joined)
        codes = _codes(words, known)
        pair_rows, pairs = _next_to(rows, codes, len(place))
        rows, codes = np.concatenate((rows, pair_rows)), np.concatenate((codes, pairs + len(place)))
        at = np.searchsorted(ordered, codes)
        there = at < len(ordered)
        there[there] = ordered[at[there]] == codes[there]
        rows, found, counts = _found(rows[there], order[at[there]], len(terms) or 1)
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(joined))))), pa.int32())
        return pa.StructArray.from_arrays([
            pa.array(np.zeros(len(joined)), pa.int8()), pa.array(np.full(len(joined), len(terms)), pa.int32()),
            pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(counts * weights[found])),
        ], ["type", "size", "indices", "values"])

    path = f"{shared_folder(df.sparkSession)}/lda-features-{uuid.uuid4().hex}"
    tokens.withColumn("features", vector("_uni")).drop("_uni").write.parquet(path)
    schema = T.StructType([f for f in df.schema if f.name != "features"]).add("features", VectorUDT())
    return df.sparkSession.read.schema(schema).parquet(path), terms


def lda_sweep(
    features: DataFrame, ks: tuple[int, ...] = (5, 8, 10, 12, 15), max_iter: int = 50, seed: int = 42
) -> tuple[DataFrame, TopicModel]:
    """Fit LDA per ``k``, all rows in every pass; returns ``k, log_likelihood, log_perplexity, is_best`` and the best model."""
    size = F.unwrap_udt("features")
    terms = features.select(F.coalesce(size["size"], F.size(size["values"])).alias("n")).agg(F.max("n")).first()[0] or 0
    fitted = fit_topic_models(features, terms, ks, max_iter, seed)
    best = min(range(len(ks)), key=lambda place: fitted[place][2])
    table = features.sparkSession.createDataFrame(
        [(k, ll, lp, place == best) for place, (k, (_, ll, lp)) in enumerate(zip(ks, fitted))],
        "k int, log_likelihood double, log_perplexity double, is_best boolean",
    )
    return table, fitted[best][0]


def lda_topic_words(model: TopicModel, vocabulary: list[str], n: int = 15) -> DataFrame:
    """``topic, rank, term, weight`` of the model's strongest terms."""
    rows = [(topic, rank, vocabulary[term], weight) for topic, rank, term, weight in model.top_terms(n)]
    return SparkSession.active().createDataFrame(rows, "topic int, rank int, term string, weight double")


def dominant_topic(
    model: TopicModel, features: DataFrame, categories: dict[int, str] | None = None, other: str = "Ambiguous"
) -> DataFrame:
    """Add ``dominant_topic, topic_probability, prompt_category`` (topic → category is a parameter).

    A text without any vocabulary term has equal shares, so it falls to the first topic.
    """
    shares = model.transform(features, output="_p")
    best = F.array_max("_p")
    named = shares.withColumns(
        {
            "topic_probability": F.when(best == 0, 1.0 / F.size("_p")).otherwise(best),
            "dominant_topic": (F.array_position("_p", best) - 1).cast("int"),
        }
    ).drop("_p")
    if not categories:
        return named.withColumn("prompt_category", F.lit(other))
    lookup = F.create_map(*[F.lit(part) for pair in categories.items() for part in pair])
    return named.withColumn(
        "prompt_category", F.coalesce(F.try_element_at(lookup, F.col("dominant_topic")), F.lit(other))
    )
