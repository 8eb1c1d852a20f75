"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Targets: sources in code point order weigh 1, 2, 3, repeating, and share all words by weight; none may
exceed ``max_repeats`` times its size, and what is over is shared again by weight. Blocks: the target
of each source is divided into blocks of ``block_words`` words; blocks go to the sources, and a
source's blocks to its shards, one by one to the highest quotient ``weight / (2 k + 1)``. Shards: a
source's documents are dealt to shards by a seeded hash, so a hot source is cut into as many pieces as
its size asks for. Selection: a shard's documents stand in seeded order, are cut into blocks, and a
seeded permutation of the block numbers says which blocks are taken once more than the others.

Only ids, sources and sizes are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import WORD, let, word_count
from colloquy.session import use_utc, written_table

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK_WORDS = 64
SHARD_WORDS = 4_000_000
# A prime above any number of blocks in a shard: its multiples permute the block numbers.
STRIDE = 2_147_483_647


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``_source, source_size`` plus ``target``. One row per source.

    Sources stop at their limit in the order of limit over weight. The level is the words left per
    weight left; the first source whose limit is above the level, and all after it, get their weight's
    share of what is left.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    by_limit = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("_rank"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name)).select(
        "_source", "source_size", "_rank", (F.col("source_size") * max_repeats).alias("_limit"),
        F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("_rank") - 1, F.lit(len(weights)))).alias("_weight"),
    )
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    levels = ranked.select("*", (left / F.sum("_weight").over(after)).alias("_level"))
    level = F.min(F.when(F.col("_limit") >= F.col("_level") * F.col("_weight"), F.struct(F.col("_limit") / F.col("_weight"), F.col("_rank"), F.col("_level")))).over(everything)
    return levels.select("*", level["_level"].alias("_water")).select(
        "_source", "source_size", F.least(F.col("_limit").cast("double"), F.col("_water") * F.col("_weight")).alias("target")
    )


def apportion(shares: DataFrame, seats: Column, weight: Column, over: list[str], order: list[str], name: str) -> DataFrame:
    """Seats by Sainte-Laguë: the highest quotients ``weight / (2 k + 1)`` win; ties go by ``order``.

    ``seats`` is the same for all rows of a group of ``over``. With n rows, H seats and weights that
    sum to W, the last quotient that wins is known to lie where W over H - n / 2 and H + n / 2 seats
    put it. A row's quotients above that range are granted, those below are lost, and only the few
    inside it, about n in a group, are ranked.
    """
    group = Window.partitionBy(*over)
    total, rows, half = F.sum("_w").over(group), F.count(F.lit(1)).over(group), F.lit(0.5)

    def share(places: Column) -> Column:
        return F.when(total > 0, F.floor(F.col("_w") * places / total + half)).otherwise(F.lit(0)).cast("long")

    bounded = shares.select("*", weight.cast("double").alias("_w"), seats.cast("long").alias("_seats")).select(
        "*",
        F.greatest(share(F.col("_seats") - rows / 2) - 1, F.lit(0).cast("long")).alias("_granted"),
        (F.greatest(share(F.col("_seats") + rows / 2), F.lit(0).cast("long")) + 1).alias("_above"),
    )
    bounded = bounded.withColumn("_free", F.when(total > 0, F.col("_seats") - F.sum("_granted").over(group)).otherwise(F.lit(0)))
    keys = list(dict.fromkeys([*over, *order]))
    quotients = bounded.select(
        *keys, "_w", "_free", F.explode(F.sequence(F.col("_granted"), F.col("_above"))).alias("_k")
    ).filter("_w > 0")
    highest = group.orderBy(
        (F.col("_w") / (2 * F.col("_k") + 1)).desc(), *[F.col(c).asc_nulls_last() for c in order], F.col("_k")
    )
    won = (
        quotients.withColumn("_place", F.row_number().over(highest)).filter("_place <= _free")
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    )
    match = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in keys]
    return bounded.alias("_l").join(won.alias("_r"), match, "left").select(
        *[F.col(f"_l.{c}").alias(c) for c in shares.columns],
        (F.col("_l._granted") + F.coalesce(F.col("_r._won"), F.lit(0))).alias(name),
    )


def mixture(df: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
            weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS,
            shard_words: int = SHARD_WORDS, seed: int = 42, seed_column: str | None = None) -> DataFrame:
    """One row per row: id, source, size, source_size, target, taken, whole_copies and pieces.

    ``taken`` is ``whole_copies`` times the size plus the ``pieces``, ranges of words of one more,
    partial copy: an array of (first word from 0, number of words). A missing text has no words; a
    missing source is a source of its own, the last. Rows that repeat an id are documents of their
    own, next to each other in the seeded order. Where the words are too few for a block, targets are
    met to the nearest block. No words at all, or an empty table: every count is zero, or no rows. Texts of any
    length are counted whole and cut to blocks. The result depends on ids, sources, sizes and the seed, not on
    how rows are stored; the seeded order can go by another column, ``seed_column``, than the id. Other
    columns are not read.
    """
    use_utc(df.sparkSession)
    ordered_by = F.col(f"`{seed_column or id_column}`")
    digest = F.md5(F.concat(F.coalesce(ordered_by.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    # Where the order does not go by the id, rows of equal place are told apart by what they hold.
    tie = F.xxhash64(F.col(f"`{text_column}`").cast("string")) if seed_column else F.lit(0).cast("long")
    sized = written_table(
        df.select(
            F.col(f"`{id_column}`").alias("_id"), F.col(f"`{source_column}`").cast("string").alias("_source"),
            word_count(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))).alias("size"), digest.alias("_order"),
            tie.alias("_tie"),
        ),
        "mixture-sizes",
    )
    words = sized.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    dealt = sized.withColumn("_shard", F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % shards)
    cells = written_table(dealt.groupBy("_source", "_shard").agg(F.sum("size").alias("_cell")), "mixture-cells")
    wanted = targets(cells.groupBy("_source").agg(F.sum("_cell").alias("source_size")), weights, max_repeats)
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / block_words)
    by_source = apportion(wanted, blocks, F.col("target"), [], ["_source"], "_blocks")
    joined = cells.alias("_c").join(by_source.alias("_s"), F.col("_c._source").eqNullSafe(F.col("_s._source"))).select(
        "_c._source", "_shard", "_cell", "source_size", "target", "_blocks"
    )
    quotas = written_table(
        apportion(joined, F.col("_blocks"), F.col("_cell"), ["_source"], ["_shard"], "_quota"), "mixture-quotas"
    )
    cell = Window.partitionBy("_source", "_shard").orderBy("_order", "_tie", "_id", "size")
    placed = dealt.withColumn(
        "_start", F.coalesce(F.sum("size").over(cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    )
    rows = placed.alias("_d").join(
        quotas.alias("_q"),
        F.col("_d._source").eqNullSafe(F.col("_q._source")) & (F.col("_d._shard") == F.col("_q._shard")),
    )
    n_blocks = F.ceil(F.col("_cell") / block_words)
    copies = F.when(n_blocks > 0, F.least(F.floor(F.col("_quota") / n_blocks), F.lit(max_repeats))).otherwise(F.lit(0))
    more = F.when(F.col("_copies") < max_repeats, F.col("_quota") - F.col("_copies") * F.col("_n")).otherwise(F.lit(0))
    rows = rows.select(
        "_id", "_d._source", "size", "source_size", "target", "_start", "_d._shard", "_quota",
        "_cell", n_blocks.cast("long").alias("_n"), copies.cast("long").alias("_copies"),
    ).withColumn("_more", more)
    end = F.col("_start") + F.col("size")

    def piece(b: Column) -> Column:
        low = F.greatest(b * block_words, F.col("_start"))
        return F.struct((low - F.col("_start")).alias("first"), (F.least((b + 1) * block_words, end) - low).alias("words"))

    own = F.sequence(F.floor(F.col("_start") / block_words), F.floor((end - 1) / block_words))
    chosen = F.filter(own, lambda b: (b * STRIDE + F.col("_shard") * 7919 + seed) % F.col("_n") < F.col("_more"))
    pieces = F.when((F.col("size") > 0) & (F.col("_more") > 0), F.transform(chosen, piece)).otherwise(
        F.array().cast("array<struct<first:bigint,words:bigint>>")
    )
    extra = F.aggregate(F.col("pieces"), F.lit(0).cast("long"), lambda total, p: total + p["words"])
    return rows.withColumn("pieces", pieces).select(
        F.col("_id").alias(id_column), F.col("_source").alias(source_column), "size", "source_size", "target",
        (F.col("_copies") * F.col("size") + extra).alias("taken"),
        F.when(F.col("size") > 0, F.col("_copies")).otherwise(0).alias("whole_copies"), "pieces",
    )


def mixed_documents(df: DataFrame, decisions: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    length_column: str | None = "n_chars") -> DataFrame:
    """The mix itself: every document as often as it is taken whole, and the words of its pieces.

    A partial copy holds the chosen words with one space between them. Columns are those of ``df``, under any
    names; ``length_column``, if it exists, is measured again. Ids must be unique in ``decisions``: give
    rows a number of their own where ids are missing or repeated.
    """
    narrow = decisions.select(F.col(id_column).alias("_mix_id"), F.col("whole_copies").alias("_copies"), F.col("pieces").alias("_pieces"))
    packed = df.select(F.col(f"`{id_column}`").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc"))
    joined = packed.join(narrow, F.col("_id").eqNullSafe(F.col("_mix_id")))
    text = F.col(f"_doc.`{text_column}`")
    part = let(
        F.regexp_extract_all(text, F.lit(f"({WORD})"), 1),
        lambda w: F.array_join(F.flatten(F.transform(F.col("_pieces"), lambda p: F.slice(w, (p["first"] + 1).cast("int"), p["words"].cast("int")))), " "),
    )
    whole = F.transform(F.array_repeat(F.lit(0), F.col("_copies").cast("int")), lambda _: text)
    texts = F.concat(whole, F.when(F.size("_pieces") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    mixed = joined.select("_doc", F.explode(texts).alias("_mixed"))
    out = []
    for c in df.columns:
        if c == text_column:
            out.append(F.col("_mixed").alias(c))
        elif c == length_column:
            out.append(F.length("_mixed").cast(dict(df.dtypes)[c]).alias(c))
        else:
            out.append(F.col(f"_doc.`{c}`").alias(c))
    return mixed.select(*out)
