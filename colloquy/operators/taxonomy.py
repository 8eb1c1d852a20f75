"""Keyword taxonomies: loading, validation, a table view, and compilation to column expressions."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.planning import select_once
from colloquy.functions.text import SPACE, WORD, WORD_END, WORD_START, text_or_empty
from colloquy.operators.default_taxonomy import DEFAULT_DESCRIPTIONS, DEFAULT_KEYWORDS

SECTIONS = ("interaction_modes", "cognitive_outsourcing", "emotional_signals", "composite_signals")


@dataclass(frozen=True)
class Label:
    name: str
    keywords: tuple[str, ...]
    description: str | None = None

    @property
    def denominator(self) -> float:
        return max(2.0, math.sqrt(len(self.keywords)))

    @property
    def candidate_text(self) -> str:
        """How the label is shown to a zero-shot model."""
        plain = self.name.replace("_", " ")
        return f"{plain}: {self.description or plain}"


Taxonomy = dict[str, tuple[Label, ...]]


def build_taxonomy(mapping: object) -> Taxonomy:
    """Validate ``{section: {label: {keywords: [...], description?}}}`` and freeze it."""
    if not isinstance(mapping, dict):
        raise ValueError("a taxonomy maps sections to labels")
    absent = [section for section in SECTIONS if section not in mapping]
    if absent:
        raise ValueError(f"taxonomy lacks sections: {', '.join(absent)}")
    taxonomy: Taxonomy = {}
    for section in SECTIONS:
        labels = mapping[section]
        if not isinstance(labels, dict) or not labels:
            raise ValueError(f"section {section} has no labels")
        frozen = []
        for name, payload in labels.items():
            if not isinstance(payload, dict):
                raise ValueError(f"label {section}.{name} is no mapping")
            keywords = payload.get("keywords")
            if not isinstance(keywords, (list, tuple)) or not keywords:
                raise ValueError(f"label {section}.{name} has no keywords")
            plain = [normalize_keyword(str(k)) for k in keywords]
            if len(set(plain)) < len(plain):
                raise ValueError(f"label {section}.{name} repeats a keyword")
            frozen.append(Label(name, tuple(map(str, keywords)), payload.get("description")))
        taxonomy[section] = tuple(frozen)
    return taxonomy


def default_taxonomy() -> Taxonomy:
    return build_taxonomy(
        {
            section: {
                name: {"keywords": keywords, "description": DEFAULT_DESCRIPTIONS.get(name)}
                for name, keywords in labels.items()
            }
            for section, labels in DEFAULT_KEYWORDS.items()
        }
    )


def load_taxonomy(path: str) -> Taxonomy:
    """Read a taxonomy from a JSON or YAML file on the driver."""
    with open(path, encoding="utf-8") as handle:
        if PurePosixPath(path).suffix.lower() == ".json":
            return build_taxonomy(json.load(handle))
        try:
            import yaml
        except ImportError as error:
            raise ImportError("reading a YAML taxonomy needs PyYAML; JSON works without it") from error
        return build_taxonomy(yaml.safe_load(handle))


def normalize_keyword(keyword: str) -> str:
    return " ".join(keyword.lower().split())


def taxonomy_table(spark: SparkSession, taxonomy: Taxonomy) -> DataFrame:
    """``section, label, keyword, is_phrase, denominator``, one row per keyword."""
    rows = [
        (section, label.name, normalize_keyword(k), " " in normalize_keyword(k), label.denominator)
        for section, labels in taxonomy.items()
        for label in labels
        for k in label.keywords
    ]
    return spark.createDataFrame(
        rows, "section string, label string, keyword string, is_phrase boolean, denominator double"
    )


def lexical_form(text: Column, normalized: bool = False) -> Column:
    """Lower-cased text with whitespace runs collapsed: what keywords are matched against."""
    if normalized:
        return F.lower(text_or_empty(text))
    return F.trim(F.regexp_replace(F.lower(text_or_empty(text)), f"{SPACE}+", " "))


def _constant(value: object, schema: str) -> Column:
    """A nested constant as one small expression that Spark folds to a literal when planning."""
    return F.from_json(F.lit(json.dumps(value)), schema)


@dataclass(frozen=True)
class KeywordPlan:
    """Keywords of a taxonomy by how they are found.

    ``plain`` keywords are single tokens. ``anchored`` phrases of three or more words can only occur
    where one of their inner words is a token of the text, ``free`` phrases have no such word.
    ``patterns`` (hyphenated keywords) need a regular expression.
    """

    plain: tuple[str, ...]
    anchored: tuple[tuple[str, str], ...]
    free: tuple[str, ...]
    patterns: tuple[str, ...]


def plan_keywords(taxonomy: Taxonomy) -> KeywordPlan:
    every = {normalize_keyword(k) for labels in taxonomy.values() for label in labels for k in label.keywords}
    plain, anchored, free, patterns = [], [], [], []
    for keyword in sorted(every - {""}):
        inner = [w for w in keyword.split(" ")[1:-1] if re.fullmatch(r"\w+", w)]
        if inner:
            anchored.append((max(inner, key=len), keyword))
        elif " " in keyword:
            free.append(keyword)
        elif re.fullmatch(r"\w+", keyword):
            plain.append(keyword)
        else:
            patterns.append(keyword)
    return KeywordPlan(tuple(plain), tuple(anchored), tuple(free), tuple(patterns))


def _quoted(values: set[str] | tuple[str, ...]) -> str:
    return ", ".join("r'" + v + "'" if "'" not in v else '"' + v + '"' for v in sorted(values))


def add_matched_keywords(df: DataFrame, normalized: str, taxonomy: Taxonomy, output: str = "_matched") -> DataFrame:
    """Add the distinct taxonomy keywords that the text in column ``normalized`` holds.

    A keyword with a space is a substring test; a keyword of word characters must be a token. The
    text is cut into tokens once, and one set lookup per token finds plain keywords and the inner
    words that make a phrase worth testing.
    """
    plan = plan_keywords(taxonomy)
    lookup = {*plan.plain, *(word for word, _ in plan.anchored)}
    others = [name for name in df.columns if name not in (normalized, output)]
    tokens = F.regexp_extract_all(F.col(normalized), F.lit(f"({WORD}+)"), F.lit(1))
    tagged = select_once(df, others, [normalized]).withColumn("_tokens", tokens)
    present = f"array_distinct(filter(_tokens, t -> t in ({_quoted(lookup)})))" if lookup else "array()"
    tagged = tagged.withColumn("_present", F.expr(present).cast("array<string>"))
    found = [F.array_intersect("_present", _constant(list(plan.plain), "array<string>"))]
    text = F.col(normalized)
    if plan.anchored:
        spec = _constant([{"w": w, "k": k} for w, k in plan.anchored], "array<struct<w:string,k:string>>")
        held = F.filter(spec, lambda e: F.array_contains(F.col("_present"), e["w"]) & text.contains(e["k"]))
        found.append(F.transform(held, lambda e: e["k"]))
    if plan.free:
        found.append(F.filter(_constant(list(plan.free), "array<string>"), lambda k: text.contains(k)))
    for keyword in plan.patterns:
        hit = text.contains(keyword) & text.rlike(_boundary(keyword))
        found.append(F.when(hit, F.array(F.lit(keyword))).otherwise(F.array().cast("array<string>")))
    return select_once(tagged, [*others, normalized], {output: F.concat(*found)})


def _boundary(keyword: str) -> str:
    """The keyword where both its ends are word boundaries."""
    quoted = "".join(c if re.fullmatch(r"\w", c) else "\\" + c for c in keyword)
    start = WORD_START if re.match(r"\w", keyword) else f"(?<={WORD})"
    end = WORD_END if re.search(r"\w$", keyword) else f"(?={WORD})"
    return f"{start}{quoted}{end}"


def section_scores(matched: Column, labels: tuple[Label, ...]) -> Column:
    """``array<struct<score, label>>`` in label order.

    The section is one constant, so the plan stays small however many keywords it holds.
    """
    entries = [
        {"label": label.name, "denominator": label.denominator,
         "keywords": sorted({normalize_keyword(k) for k in label.keywords} - {""})}
        for label in labels
    ]
    spec = _constant(entries, "array<struct<label:string,denominator:double,keywords:array<string>>>")

    def score(entry: Column) -> Column:
        hits = F.size(F.filter(matched, lambda k: F.array_contains(entry["keywords"], k)))
        return F.struct(
            F.least(F.lit(1.0), hits / entry["denominator"]).alias("score"),
            entry["label"].alias("label"),
        )

    nothing = _constant(
        [{"score": 0.0, "label": label.name} for label in labels], "array<struct<score:double,label:string>>"
    )
    return F.when(F.size(matched) == 0, nothing).otherwise(F.transform(spec, score))
