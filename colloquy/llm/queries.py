"""Queries that apply each operator to its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.bpe import digests, encode
from colloquy.llm.collocations import collocations
from colloquy.llm.common import documents
from colloquy.llm.exact import exact_duplicates
from colloquy.llm.langid import held_out, predict, train
from colloquy.llm.licenses import find_licenses
from colloquy.llm.licenses import sql as license_sql
from colloquy.llm.mixing import mixture
from colloquy.llm.pii import find_personal_data, personal_data_report
from colloquy.llm.quality import quality
from colloquy.llm.secrets import find_secrets, secret_report
from colloquy.llm.simhash import near_duplicates
from colloquy.llm.suffixes import remove_repeats, repeat_report
from colloquy.llm.tokenfile import read_documents, token_folder, write_tokens
from colloquy.llm.whitening import whiten

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


@query("op3_quality")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality(documents(spark, folder)).drop("clean_text")


@query("op4_exact", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(documents(spark, folder))


@query("op1_simhash")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder))


@query("op10_mixture")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(documents(spark, folder)).drop("pieces", "whole_copies")


@query("op7_tokenfile")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    place = token_folder(docs)
    return read_documents(write_tokens(docs, TOKENIZER, place), place)


@query("op9_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return digests(encode(documents(spark, folder), TOKENIZER, decoded_column="decoded"))


@query("op2_language")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.filter("NOT held_out"))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


@query("op5_secrets")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return secret_report(find_secrets(documents(spark, folder)))


@query("op8_pii")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data_report(find_personal_data(documents(spark, folder)))


@query("op6_licenses", license_sql())
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = find_licenses(documents(spark, folder))
    return found.select("doc_id", "n_sentences", *[F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licenses")])


@query("op11_collocations", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
phrases AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT lang, 3, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM phrases GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS p FROM counts WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM candidates c CROSS JOIN (SELECT unnest([1, 2]) AS cut) AS x
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(p[1:cut], ' ') AND l.k = cut
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(p[cut + 1:], ' ') AND r.k = c.k - cut
  WHERE cut < c.k),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) AS place FROM cuts) AS c WHERE place = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, unnest([p[1] || ' ' || p[2], p[2] || ' ' || p[3]]) AS phrase FROM candidates WHERE k = 3) AS t GROUP BY ALL),
ranked AS (
  SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, w.phrase) AS rank, w.phrase, w.a, l, r, score
  FROM weakest w LEFT JOIN longer o ON w.k = 2 AND o.lang = w.lang AND o.phrase = w.phrase
  WHERE o.a IS NULL OR 100 * o.a < 50 * w.a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(documents(spark, folder))


@query("op12_suffixes")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return repeat_report(remove_repeats(documents(spark, folder)))


@query("op13_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
