"""Exact duplicates by distributed radix partitioning on successive bytes, most significant first.

A group of documents that agree so far is split by its next digit, a slice of bytes. A group of one is
finished, and so is a group whose texts have ended. Digits grow sixteenfold from round to round, so
the number of rounds is logarithmic in the longest text; no digest stands for a text. The byte length
is compared along with the first digit; texts that share both are moved, and those few that a filter of
fixed size (8 MB) takes for such.

Every round counts its groups with partial sums, so a group that holds a third of all rows is folded
before the shuffle. Members find their new group by a join of written tables, whose hot keys adaptive
execution splits. The rest of a text is written once per round to the shared folder, for groups of two
or more only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.bloom import bits_for, may_contain
from colloquy.llm.common import whole_text
from colloquy.session import use_utc, written_table

FIRST_DIGIT = 32
GROWTH = 16


def _split(members: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Groups of two or more: their keys, the largest id (their new name) and their size."""
    groups = members.groupBy(*keys).agg(F.max("_id").alias("_next"), F.count(F.lit(1)).alias("_size"))
    return written_table(groups.filter("_size > 1"), name)


def exact_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """Members of groups of equal texts: ``_id``, ``keep_id`` (the largest id) and ``group_size``.

    The text's ``_length`` and first ``_digit`` come along, to tell apart texts of an id given twice.
    Documents without a copy are not returned. A missing text is an empty one; a row without an id is
    left out. Rows that repeat an id with its text are one document given twice: both count in
    ``group_size`` and the id is returned once.
    """
    use_utc(df.sparkSession)
    texts = df.select(
        F.col(f"`{id_column}`").alias("_id"), F.encode(whole_text(text_column), "UTF-8").alias("_rest")
    ).filter("_id IS NOT NULL")
    heads = texts.select(
        "_id", F.octet_length("_rest").alias("_length"), F.substring("_rest", 1, first_digit).alias("_digit")
    )
    keys = ["_length", "_digit"]
    groups = _split(heads, keys, "radix-groups")
    members = written_table(
        heads.join(groups, keys).select("_id", *keys, "_next", "_size", (F.col("_length") <= first_digit).alias("_ended")),
        "radix-members",
    )
    ended = [members.filter("_ended").drop("_ended")]
    running = members.filter("NOT _ended").select("_id", *keys, F.col("_next").alias("_group")).distinct()
    # Texts that share neither stay where they are, but for the few that a filter of fixed size lets pass. A merge
    # join at every size: one shuffle of the rest.
    whole = texts.withColumns({"_length": F.octet_length("_rest"), "_digit": F.substring("_rest", 1, first_digit)})
    name = F.xxhash64("_id", *keys)
    whole = whole.filter(may_contain(running.select(name.alias("_hash")), "_hash", bits_for(running.count()), name))
    rest = F.expr(f"substring(_rest, {first_digit} + 1)").alias("_rest")
    active = written_table(
        whole.join(running.hint("merge"), ["_id", *keys]).select(*[F.col(k).alias(f"_head{k}") for k in keys], "_id", "_group", rest),
        "radix-texts",
    )
    heads_kept = [f"_head{k}" for k in keys]
    width = first_digit * growth
    while not active.isEmpty():
        cut = active.withColumn("_digit", F.expr(f"substring(_rest, 1, {width})"))
        groups = _split(cut, ["_group", "_digit"], "radix-groups")
        members = written_table(
            cut.join(groups, ["_group", "_digit"]).select(
                "_id", *heads_kept, "_next", "_size", (F.octet_length("_rest") <= width).alias("_ended"),
                F.expr(f"substring(_rest, {width} + 1)").alias("_rest"),
            ),
            "radix-texts",
        )
        ended.append(
            members.filter("_ended").select(
                "_id", *[F.col(f"_head{k}").alias(k) for k in keys], "_next", "_size"
            )
        )
        active = members.filter("NOT _ended").select(*heads_kept, "_id", F.col("_next").alias("_group"), "_rest")
        width *= growth
    found = ended[0]
    for part in ended[1:]:
        found = found.unionByName(part)
    return found.select(
        "_id", *keys, F.col("_next").alias("keep_id"), F.col("_size").alias("group_size")
    ).distinct()


def exact_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **digits: int) -> DataFrame:
    """One row per row: id, ``keep_id``, ``group_size``, ``kept`` and the text's SHA-256.

    Of equal texts the largest id stays. A row without an id has no copies: ``keep_id`` is missing and
    it is kept. Rows that repeat an id and its text have the same result. Ids are meant to be unique;
    where an id comes with several texts, each is held against its own copies.
    """
    groups = exact_groups(df, id_column, text_column, **digits)
    data = F.encode(whole_text(text_column), "UTF-8")
    rows = df.select(
        F.col(f"`{id_column}`").alias("_id"), F.octet_length(data).alias("_length"),
        F.substring(data, 1, digits.get("first_digit", FIRST_DIGIT)).alias("_digit"), F.sha2(data, 256).alias("text_sha256"),
    )
    keep = F.coalesce(F.col("keep_id"), F.col("_id"))
    return rows.join(groups, ["_id", "_length", "_digit"], "left").select(
        F.col("_id").alias(id_column), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(keep == F.col("_id"), F.lit(True)).alias("kept"), "text_sha256",
    )
