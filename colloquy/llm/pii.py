"""Personal data by weak supervision: labelers vote, their reliability is learned, a classifier decides.

Fixed patterns find what is personal data by contract; those spans always stay. Looser patterns propose
candidates: addresses written out in words, numbers grouped like phone or identity numbers. Labelers of
three sorts vote on every span, yes, no or nothing: regular expressions of strict forms, gazetteers
(top-level domains, area codes, reserved numbers) and context (cue words before the span).
Expectation-maximisation estimates, per kind, how often each labeler speaks and is right, from counts of
the vote patterns alone. The posteriors train a logistic span classifier on features that all spans
have; candidates that it accepts are added.

The corpus is scanned once by built-in functions; its candidates are written to the shared folder. What
reaches the driver are counts per vote and feature pattern, at most ``MAX_PATTERNS`` by construction.

Defined results: a missing or empty text has no spans; rows that repeat count as often as they occur and
give the same result; an empty table gives an empty table and an untrained classifier, which adds
nothing; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.planning import select_once
from colloquy.llm.common import let, whole_text
from colloquy.llm.spans import labelled, matches, overlaps, written
from colloquy.session import use_utc, written_table

# The patterns of the contract. Runs are matched whole, so no text makes them backtrack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "id")
# Looser forms that only propose candidates, by kind.
PROPOSALS = (
    ("email", r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z]{2,24}+)++"),
    ("phone", r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
)
# Gazetteers.
TOP_DOMAINS = "com|org|net|edu|gov|io|info|biz|de|fr|es|uk|it|nl|eu|us|ca|au|jp|cn|br|ru|in|ch|at|be|se|no|pl"
RESERVED = r"^(?:0+[. -]|127\.0\.0\.1|255\.255|000|666|9[0-9]{2}-[0-9]{2}-|.*(?:0{6}|1{6}|123456))"
AREA_CODES = r"^\+?1?[\x20(.-]*[2-9][0-8][0-9]"
# Cue words before a span, for and against.
CUES_FOR = r"(?i)(?:e-?mail|mail|contact|write to|tel|phone|call|mobile|fax|card|visa|ip|host|address|ssn|social security)[^\n]{0,12}$"
CUES_AGAINST = r"(?i)(?:version|order|invoice|isbn|page|part no|serial|figure|table|section)[^\n]{0,8}$"
CONTEXT_CHARS = 40
LABELERS = ("strict", "checksum", "domains", "numbers", "cues", "countercues")
# Votes are -1, 0 or 1 for each labeler; features are the kind, three length classes and two flags.
MAX_PATTERNS = len(KINDS) * 3 ** len(LABELERS) * 12


def luhn(value: Column) -> Column:
    """Whether the digits of a value have a right check digit."""

    def total(digits: Column) -> Column:
        def weighed(c: Column, k: Column) -> Column:
            d = c.cast("int")
            return F.when(k % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

        return F.aggregate(F.transform(digits, weighed), F.lit(0), lambda a, x: a + x)

    return total(F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")) % 10 == 0


def fixed_spans(text: Column) -> dict[str, Column]:
    """The spans of the contract's patterns by kind."""
    digits = lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", ""))
    return {
        "email": matches(text, EMAIL),
        "ip": F.filter(matches(text, IP), lambda s: s["value"].rlike(IP_PARTS)),
        "card": F.filter(matches(text, CARD), lambda s: luhn(s["value"])),
        "phone": F.filter(matches(text, PHONE), lambda s: digits(s).between(9, 15)),
    }


def _votes(kind: str, value: Column, before: Column, fixed: bool) -> Column:
    """The labelers' votes and the features of one span."""
    vote = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)
    digits = F.regexp_replace(value, "[^0-9]", "")
    none = F.lit(0)
    ballots = {
        "strict": F.lit(1 if fixed else 0),
        "checksum": vote(luhn(value), ~luhn(value)) if kind == "card" else none,
        "domains": vote(value.rlike(rf"(?i)[.\x20)\]](?:{TOP_DOMAINS})$"), ~value.rlike(r"(?i)[.\x20)\]][a-z]{2,}$"))
        if kind == "email" else none,
        "numbers": none if kind == "email" else vote(
            value.rlike(AREA_CODES) if kind == "phone" else F.lit(False), value.rlike(RESERVED)
        ),
        "cues": vote(before.rlike(CUES_FOR)),
        "countercues": vote(F.lit(False), before.rlike(CUES_AGAINST)),
    }
    length = F.length(value)
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(fixed).alias("fixed"), *[ballots[name].cast("int").alias(name) for name in LABELERS],
        F.when(length < 11, 0).when(length < 16, 1).otherwise(2).alias("length"),
        (F.length(digits) * 2 >= length).cast("int").alias("digits"),
        value.rlike(r"[().\[\]-]").cast("int").alias("marks"),
    )


def candidates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: id, the fixed spans by kind, and ``spans``: every span with votes and features."""
    text = F.col("_text")
    source = df.select(F.col(f"`{id_column}`").alias(id_column), whole_text(text_column).alias("_text"))
    loose = {f"_loose_{k}": matches(text, pattern) for k, (_, pattern) in enumerate(PROPOSALS)}
    found = select_once(source, [id_column, "_text"], fixed_spans(text) | loose)
    every_fixed = F.concat(*[F.col(k) for k in KINDS[:4]])

    def judged(kind: str, spans: Column, fixed: bool) -> Column:
        def one(s: Column) -> Column:
            start = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
            return let(
                F.substring(text, start + 1, s["start"] - start),
                lambda before: F.struct(
                    s["start"].alias("start"), s["end"].alias("end"), _votes(kind, s["value"], before, fixed).alias("seen")
                ),
            )

        return F.transform(spans, one)

    proposed = [
        judged(kind, F.filter(F.col(f"_loose_{k}"), lambda s: ~overlaps(s, every_fixed)), False)
        for k, (kind, _) in enumerate(PROPOSALS)
    ]
    spans = F.concat(*[judged(k, F.col(k), True) for k in KINDS[:4]], *proposed)
    bare = lambda k: F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k)
    return found.select(id_column, *[bare(k) for k in KINDS[:4]], spans.alias("spans"))


@dataclass(frozen=True)
class SpanModel:
    """Labeler reliabilities by kind, and the weights of the span classifier."""

    reliability: dict[str, dict[str, tuple[float, float]]]
    weights: dict[str, float]
    threshold: float = 0.5


def posteriors(rows: Sequence[tuple[tuple[int, ...], float]], rounds: int = 40) -> tuple[list[float], list[tuple[float, float]]]:
    """Expectation-maximisation over vote patterns with counts, labelers independent given the truth.

    Returns the probability of "personal" for each pattern, and for each labeler the rate at which its
    votes are right on personal and on other spans. Starts from the majority of votes.
    """
    width = len(rows[0][0]) if rows else 0
    guess = [1 / (1 + math.exp(-2.0 * sum(votes))) if any(votes) else 0.3 for votes, _ in rows]
    rates: list[tuple[list[float], list[float]]] = []
    for _ in range(rounds):
        mass = [sum(n * g for (_, n), g in zip(rows, guess)), sum(n * (1 - g) for (_, n), g in zip(rows, guess))]
        prior = (mass[0] + 1) / (sum(mass) + 2)
        rates = []
        for k in range(width):
            tables = []
            for side in (0, 1):
                table = [0.1, 0.1, 0.1]
                # A labeler is taken to be right more often than wrong until the data say otherwise.
                table[2 if side == 0 else 0] += 1.0
                for (votes, n), g in zip(rows, guess):
                    table[votes[k] + 1] += n * (g if side == 0 else 1 - g)
                tables.append([x / sum(table) for x in table])
            rates.append((tables[0], tables[1]))
        for r, (votes, _) in enumerate(rows):
            log = math.log(prior / (1 - prior)) + sum(
                math.log(rates[k][0][v + 1] / rates[k][1][v + 1]) for k, v in enumerate(votes)
            )
            guess[r] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
    right = []
    for yes, no in rates:
        right.append((yes[2] / max(yes[0] + yes[2], 1e-9), no[0] / max(no[0] + no[2], 1e-9)))
    return guess, right


def logistic(rows: Iterable[tuple[dict[str, float], float, float]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic classifier from (features, soft label, weight), by gradient steps."""
    held = list(rows)
    total = sum(w for _, _, w in held) or 1.0
    weights: dict[str, float] = {name: 0.0 for features, _, _ in held for name in features}
    for _ in range(rounds):
        slope = {name: decay * value for name, value in weights.items()}
        for features, label, weight in held:
            score = sum(weights[name] * x for name, x in features.items())
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, score)))) - label) * weight / total
            for name, x in features.items():
                slope[name] += error * x
        for name in weights:
            weights[name] -= rate * slope[name]
    return weights


FEATURES = ("strict", "checksum", "domains", "numbers", "cues", "countercues", "digits", "marks")


def train(found: DataFrame) -> SpanModel:
    """Learn reliabilities and the classifier from all spans of a candidates table."""
    seen = found.select(F.explode("spans.seen").alias("s"))
    counted = seen.groupBy("s").agg(F.count(F.lit(1)).alias("n")).select("s.*", "n").collect()
    reliability, examples = {}, []
    for kind in KINDS:
        rows = sorted((r for r in counted if r["kind"] == kind), key=lambda r: tuple(r[name] for name in (*LABELERS, "length", "digits", "marks")))
        if not rows:
            continue
        votes = [(tuple(r[name] for name in LABELERS), float(r["n"])) for r in rows]
        guess, right = posteriors(votes)
        reliability[kind] = dict(zip(LABELERS, right))
        for row, probability in zip(rows, guess):
            features = {name: float(row[name]) for name in FEATURES} | {f"length{row['length']}": 1.0, "bias": 1.0}
            examples.append((features, probability, float(row["n"])))
    return SpanModel(reliability, logistic(examples))


def score(span: Column, model: SpanModel) -> Column:
    """The classifier's probability for one span of a candidates table."""
    total = F.lit(model.weights.get("bias", -30.0))
    for name in FEATURES:
        total = total + span["seen"][name] * F.lit(model.weights.get(name, 0.0))
    for k in range(3):
        total = total + F.when(span["seen"]["length"] == k, model.weights.get(f"length{k}", 0.0)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def find_personal_data(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: id, the fixed spans by kind, and ``added``: accepted spans with their kind."""
    use_utc(df.sparkSession)
    found = written_table(candidates(df, id_column, text_column), "pii-candidates")
    model = train(found)
    accepted = F.filter("spans", lambda s: ~s["seen"]["fixed"] & (score(s, model) >= model.threshold))
    return found.select(
        id_column, *KINDS[:4],
        F.transform(accepted, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["seen"]["kind"].alias("kind"))).alias("added"),
    )


def personal_data_report(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts and the digest of the fixed spans, and all spans as text."""
    base = F.concat(*[labelled(F.col(k), k, order) for order, k in enumerate(KINDS[:4])])
    places = F.array(*[F.lit(k) for k in KINDS])
    added = F.transform("added", lambda s: F.struct(
        s["start"].alias("start"), (F.array_position(places, s["kind"]) - 1).cast("int").alias("order"),
        s["kind"].alias("kind"), s["end"].alias("end"),
    ))
    return found.select(
        id_column, *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(written(base), 256).alias("base_sha256"), written(F.concat(base, added)).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
