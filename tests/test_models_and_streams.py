"""The text classifier, remembering streams, dedup plans and filters of fixed size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions.bloom import bits_for, may_contain
from colloquy.operators import canonical, text_classifier
from colloquy.operators.models import best_label
from colloquy.streaming.acquire import first_seen, merged_sums, write_partial_sums

SF = "/root/testdata/sf0.01"


def test_classifier_reads_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    docs = docs.select("doc_id", "text", F.col("quality").cast("string").alias("label")).filter("label IS NOT NULL")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = text_classifier.fit_text_classifier(docs.filter(~held_out), "text")
    rows = docs.filter(held_out).withColumn("best", best_label(model.factory, 16)(F.col("text"))).collect()
    counts = {}
    for r in rows:
        counts[r.label] = counts.get(r.label, 0) + 1
    accuracy = sum(r.best.label == r.label for r in rows) / len(rows)
    assert accuracy >= max(counts.values()) / len(rows) and accuracy >= 0.7
    for r in rows[:20]:
        margins = [sum(w * v for w, v in zip(weights, text_classifier.term_vector(r.text, 1024))) + b
                   for weights, b in zip(model.weights, model.intercepts)]
        shares = np.exp(np.array(margins) - max(margins))
        best = int(np.argmax(shares))
        assert model.classes[best] == r.best.label and r.best.score == pytest.approx(shares[best] / shares.sum())
    with pytest.raises(ValueError):
        text_classifier.fit_text_classifier(docs.withColumn("label", F.lit("one")), "text")


def test_conversations_are_taken_once(spark, tmp_path):
    schema = "conversation_id string, month string, n long"
    first = [("a", "01", 1), ("b", "01", 2), (None, "02", 3), (None, "02", 4)]
    second = [("a", "01", 1), ("c", "02", 5), (None, "02", 3), ("b", "03", 9)]
    found = []
    for part, rows in (("1", first), ("2", second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / part))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = write_partial_sums(
            first_seen(stream), str(tmp_path / "out"), str(tmp_path / "state"), ["month"], {"rows": F.lit(1), "total": F.col("n")}
        )
        query.awaitTermination()
        found.append({r.month: (r.rows, r.total) for r in merged_sums(spark, str(tmp_path / "out"), ["month"], ["rows", "total"]).collect()})
    assert found == [{"01": (2, 3), "02": (2, 7)}, {"01": (2, 3), "02": (3, 12)}]


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_dedup_leaves_texts_where_they_are(spark, broadcast_rows):
    rows = [(k % 40, None if k % 11 == 0 else k % 3, k % 5, f"text {k % 7}", {"m": k % 2}) for k in range(200)] + [(None, 1, 2, "x", {}), (None, 1, 1, "y", None)]
    df = spark.createDataFrame(rows, "key int, a int, b int, text string, m map<string,int>").repartition(4)
    found = sorted((str(r.key), r.a, r.b, r.text, str(r.m)) for r in canonical.keep_first(df, ["key"], ["a", "b"], broadcast_rows).collect())

    def order(row):
        _, a, b, text, m = row
        return ((a is None, a or 0), (b is None, b or 0), text, sorted((m or {}).items()))

    wanted = {}
    for row in rows:
        if row[0] not in wanted or order(row) < order(wanted[row[0]]):
            wanted[row[0]] = row
    assert found == sorted((str(k), a, b, t, str(m)) for k, a, b, t, m in wanted.values())


def test_dedup_plan_moves_no_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("h", F.md5(F.col("text").cast("binary")))
    plan = canonical.keep_first(docs, ["h"], ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_filter_of_fixed_size(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    probed = spark.range(3000).filter(may_contain(keys, "k", bits_for(1000), F.col("id")))
    found = {r.id for r in probed.collect()}
    assert set(range(0, 3000, 3)) <= found and len(found) < 1200
    assert bits_for(10**12) == 1 << 26 and spark.range(9).filter(may_contain(keys.limit(0), "k", bits_for(0), F.col("id"))).count() == 0


def test_sketched_quantiles(spark):
    from colloquy.operators import sketches

    rng = np.random.default_rng(0)
    rows = [(k % 3, k % 5, float(v)) for k, v in enumerate(rng.lognormal(size=9000))] + [(0, 0, None), (1, 0, float("nan"))]
    df = spark.createDataFrame(rows, "g int, day int, v double").repartition(6)
    merged = sketches.merge_sketches(sketches.quantile_sketches(df, ["g", "day"], "v"), ["g"])
    found = sketches.sketch_quantiles(merged, ["g"], (0.1, 0.5, 0.99))
    measured = sketches.rank_errors(df, ["g"], "v", found).collect()
    assert len(measured) == 9 and all(r.num_records == 3000 for r in measured)
    for r in measured:
        values = np.array([v for g, _, v in rows if g == r.g and v is not None and v == v])
        low, high = (values < r.value).mean(), (values <= r.value).mean()
        assert r.rank_error == pytest.approx(max(0.0, low - r.q, r.q - high)) and r.rank_error <= sketches.rank_bound()
    assert abs(sketches.above_quantile(df.filter("NOT isnan(v)"), "v", 0.9).count() - 900) <= 9000 * sketches.rank_bound() + 1


def test_classifier_rows_are_dense_a_slice_at_a_time(spark, monkeypatch):
    from colloquy.operators import text_classifier

    rows = spark.createDataFrame([(f"good day {k}", "a") for k in range(9)] + [(f"bad night {k}", "b") for k in range(9)], "text string, label string")
    whole = text_classifier.fit_text_classifier(rows, "text", terms=32)
    monkeypatch.setattr(text_classifier, "ROWS", 2)
    parts = text_classifier.fit_text_classifier(rows, "text", terms=32)
    assert parts.classes == whole.classes and parts.weights == pytest.approx(whole.weights, abs=1e-6)
