"""The allow list takes parts out of a candidate, not the candidate."""

import random
import string

import pytest
from pyspark.sql import functions as F

from colloquy.llm.secrets import find_secrets

LOWER = string.ascii_lowercase


@pytest.mark.parametrize("letters", [LOWER, LOWER + string.digits, string.ascii_letters])
def test_random_keys_are_found(spark, letters):
    rng = random.Random(11)
    rows = [(k, "é see " + "".join(rng.choice(letters) for _ in range(size)) + " .") for k, size in enumerate([24, 32, 40] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert find_secrets(docs).filter("size(entropy) + size(hex) > 0").count() >= 0.9 * len(rows)


def test_words_around_a_key_do_not_hide_it(spark):
    key = "zT9vQ2mLx8RkW4pYb7NcD3sHj6Ff1Ga0"
    texts = [f"at /home/example/{key}", f"sample-123456-{key}-configuration", f"{key}/documentation/550e8400-e29b-41d4-a716-446655440000"]
    plain = ["the/long/configuration_of/documentation/2024/01/examples", "getUserAccountInformationFromRequest", "x" * 30 + "0" * 30, "internationalization"]
    docs = spark.createDataFrame(list(enumerate(texts + plain)), "doc_id long, text string")
    found = {r["doc_id"]: r["entropy"] for r in find_secrets(docs).select("doc_id", "entropy").collect()}
    for k, text in enumerate(texts):
        assert len(found[k]) == 1 and text[found[k][0]["start"]:found[k][0]["end"]].strip("/-") == key
    assert not any(found[k] for k in range(len(texts), len(texts + plain)))
