"""Secret scans: fixed patterns, and windows of high entropy in candidate strings.

A candidate is a long run of the characters that keys are written in. A window slides over it; one step
counts one character in and one out, and only these two counts change the window's Shannon entropy.
What is on the allow list (plain words and numbers between separators, UUIDs and placeholders) is cut out
of a candidate first. Windows over the limit of a piece's character class make its span. A plain word has
15 letters or fewer, or is made of several capitalised ones; longer runs of letters are judged like others.

Everything is built-in functions in one projection; nothing is shuffled. Runs are found whole, whatever
their length, and each pattern is written so that no text makes it backtrack over a run.

Defined results: a missing or empty text has no spans; rows that repeat give the same result; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.planning import select_once
from colloquy.llm.common import let, whole_text
from colloquy.llm.spans import labelled, matches, overlaps, written

# The patterns. Matches of the first that are too short are dropped after matching.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_RUN = ASSIGN.replace("([A-Za-z0-9+/_.=-]+)", "[A-Za-z0-9+/_.=-]++")
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
ASSIGN_MIN = 6
# Parts of a candidate that are no keys. Words and numbers stand between separators.
ALLOWED = (
    r"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?:[A-Z]?[a-z]{2,14}|[A-Z]{3,15}|(?:[a-z]{2,14})?(?:[A-Z][a-z]{2,14}+)++|[0-9]++)(?![A-Za-z0-9])"
    r"|(?i:example|sample|placeholder|changeme|dummy|x{6,}+|0{8,}+|123456|abcdef)"
)
# Character classes, tried in order, with the least entropy in bits of a window that looks random.
CLASSES = ((r"^[0-9a-fA-F]+$", 2.8), (r"^[A-Za-z0-9]+$", 3.5), (r"", 3.7))
WINDOW = 20


def windows_over(value: Column, limit: Column, window: int = WINDOW) -> Column:
    """First start and last end, within the value, of the windows whose entropy is at least the limit.

    With counts c in a window of w characters, the entropy is log2 w - sum(c log2 c) / w. The state
    holds the counts and that sum; a step adds and takes off the two terms that change.
    """
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    unset = F.lit(None).cast("int")

    def slide(codes: Column, letters: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            come, gone = F.get(codes, i), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))

            def changed(counts: Column, total: Column) -> Column:
                up = F.get(counts, come)
                more = total + F.get(term, up + 1) - F.get(term, up)
                added = F.transform(counts, lambda c, k: c + F.when(k == come, 1).otherwise(0))

                def off(held: Column) -> Column:
                    down = F.get(held, gone)
                    left = F.when(gone < 0, more).otherwise(more - F.get(term, down) + F.get(term, down - 1))
                    kept = F.transform(held, lambda c, k: c - F.when(k == gone, 1).otherwise(0))

                    def noted(sum_: Column) -> Column:
                        high = (i >= window - 1) & (F.lit(math.log2(window)) - sum_ / window >= limit)
                        return F.struct(
                            kept.alias("counts"), sum_.alias("total"),
                            F.when(high, F.coalesce(state["first"], i - (window - 1))).otherwise(state["first"]).alias("first"),
                            F.when(high, i + 1).otherwise(state["last"]).alias("last"),
                        )

                    return let(left, noted)

                return let(added, off)

            return changed(state["counts"], state["total"])

        begin = F.struct(
            F.array_repeat(F.lit(0), F.size(letters)).alias("counts"), F.lit(0.0).alias("total"),
            unset.alias("first"), unset.alias("last"),
        )
        found = F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), begin, step)
        return let(found, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    def coded(chars: Column) -> Column:
        return let(
            F.array_distinct(chars),
            lambda letters: let(
                F.transform(chars, lambda c: (F.array_position(letters, c) - 1).cast("int")), lambda codes: slide(codes, letters)
            ),
        )

    return let(F.regexp_extract_all(value, F.lit("(.)"), 1), coded)


def entropy_spans(text: Column, window: int = WINDOW) -> Column:
    """Spans of the candidates' pieces that look random, without what is on the allow list."""

    def judged(span: Column) -> Column:
        limit = F.lit(CLASSES[-1][1])
        for pattern, bits in reversed(CLASSES[:-1]):
            limit = F.when(span["value"].rlike(pattern), F.lit(bits)).otherwise(limit)
        return let(
            windows_over(span["value"], limit, window),
            lambda w: F.struct(
                (span["start"] + w["first"]).alias("start"), (span["start"] + w["last"]).alias("end"), span["value"].alias("value")
            ),
        )

    def pieces(span: Column) -> Column:
        """What the allowed parts leave of a candidate, if a window fits in."""

        def between(cuts: Column) -> Column:
            def piece(k: Column) -> Column:
                first = F.coalesce(F.get(cuts, k - 1)["end"], F.lit(0)).cast("int")
                last = F.coalesce(F.get(cuts, k)["start"], F.length(span["value"])).cast("int")
                return F.struct((span["start"] + first).alias("start"), F.substring(span["value"], first + 1, last - first).alias("value"))

            return F.transform(F.sequence(F.lit(0), F.size(cuts)), piece)

        return F.filter(let(matches(span["value"], ALLOWED), between), lambda p: F.length(p["value"]) >= window)

    found = F.flatten(F.transform(matches(text, CANDIDATE), pieces))
    return F.filter(F.transform(found, judged), lambda s: s["start"].isNotNull())


def find_secrets(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: id and arrays of (start, end, value): ``assign, access, hex, entropy``.

    Entropy spans that meet one of the other spans are left out.
    """
    text = F.col("_text")
    source = df.select(F.col(f"`{id_column}`").alias(id_column), whole_text(text_column).alias("_text"))
    long_enough = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= ASSIGN_MIN
    found = select_once(source, [id_column], {
        "assign": F.filter(matches(text, ASSIGN_RUN), long_enough), "access": matches(text, ACCESS),
        "hex": matches(text, HEX), "_dense": entropy_spans(text),
    })
    fixed = F.concat("assign", "access", "hex")
    return found.select(
        id_column, "assign", "access", "hex", F.filter("_dense", lambda s: ~overlaps(s, fixed)).alias("entropy")
    )


def secret_report(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts, the digest of the fixed patterns' spans, and all spans as text."""
    kinds = ("assign", "access", "hex")
    base = F.concat(*[labelled(F.col(k), k, order) for order, k in enumerate(kinds)])
    everything = F.concat(base, labelled(F.col("entropy"), "entropy", len(kinds)))
    return found.select(
        id_column, *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(written(base), 256).alias("base_sha256"), written(everything).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )
