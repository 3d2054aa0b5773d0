"""Claim language: lexicons of patterns over lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.stems import folded, may_match
from scriptorium.operators.findings import finding
from scriptorium.operators.lines import with_abstract, without_comment

#: Name, severity, pattern.
CLAIM_LANGUAGE = (
    ("proof_language", "critical", r"\bproven\b|\bproves\b|\bproof\s+that\b"),
    ("validated", "critical", r"(?<!not\s)(?<!qualitatively\s)\bvalidated\b"),
    ("impossible", "critical", r"\bimpossible\b"),
    ("machine_precision", "critical", r"\bmachine[\s-]precision\b"),
    ("statistically_indistinguishable", "critical", r"\bstatistically\s+indistinguishable\b"),
    ("confirms_demonstrates", "warning", r"\bconfirms\b|\bdemonstrates\s+that\b"),
    ("priority_claim", "warning", r"\bfirst[\s-]ever\b|\bfirst\s+of\s+its\s+kind\b|\bunprecedented\b"),
    ("definitive_language", "warning", r"\bdefinitively\b|\bconclusively\b|\bunequivocally\b"),
    ("hyperbole", "warning", r"\bground[\s-]?breaking\b|\brevolutionary\b|\bparadigm[\s-]?shift\b"),
    ("always", "warning", r"\balways\b(?!\s+(?:positive|negative|true|false|zero|one))"),
    ("never", "warning", r"\bnever\b(?!\s+(?:negative|positive|zero|exceed))"),
    ("significant_ambiguous", "info", r"\bsignificant\b(?!\s*(?:at|p\s*[<=<]))"),
    ("clearly_obviously", "info", r"\bclearly\b|\bobviously\b|\bundoubtedly\b"),
    ("editorial_adverb", "info", r"\binterestingly\b|\bsurprisingly\b|\bremarkably\b|\bstrikingly\b"),
)
_NOVEL = r"\bnovel\b"
#: What each match of a pattern has, in lower case; patterns that are not named here are looked for in all lines.
STEMS = dict(
    zip(
        [pattern for _, _, pattern in CLAIM_LANGUAGE] + [_NOVEL],
        (
            ("prove", "proof"),
            ("validated",),
            ("impossible",),
            ("machine",),
            ("indistinguishable",),
            ("confirms", "demonstrates"),
            ("first", "unprecedented"),
            ("definitively", "conclusively", "unequivocally"),
            ("breaking", "revolutionary", "paradigm"),
            ("always",),
            ("never",),
            ("significant",),
            ("clearly", "obviously", "undoubtedly"),
            ("interestingly", "surprisingly", "remarkably", "strikingly"),
            ("novel",),
        ),
        strict=True,
    )
)
EXTENSIONS = (".tex", ".md", ".txt", ".rst")


def matches(lines: DataFrame, lexicon: Iterable[tuple[str, str, str]]) -> DataFrame:
    """One row for each match: doc_id, line_no, pattern_name, severity, matched_text, ord (pattern, then place in the line).

    Patterns are literals of one expression, so each is compiled once and the
    lines are read once. Case doesn't matter, letters are Unicode letters.
    """
    return _rows(lines, [_found(k, *entry) for k, entry in enumerate(lexicon)])


def _found(k: int, name: str, severity: str, pattern: str) -> Column:
    row = lambda m, i: F.struct(F.lit(name).alias("pattern_name"), F.lit(severity).alias("severity"), m.alias("matched_text"), (F.lit(1000 * k) + i).alias("ord"))
    found = F.transform(F.regexp_extract_all("cut", F.lit(f"(?iU){pattern}"), F.lit(0)), row)
    none = F.array().cast("array<struct<pattern_name: string, severity: string, matched_text: string, ord: int>>")
    return F.when(may_match(F.col("low"), STEMS[pattern]), found).otherwise(none) if pattern in STEMS else found


def _rows(lines: DataFrame, each: list[Column]) -> DataFrame:
    cut = lines.withColumn("cut", without_comment(F.col("line"), F.col("ext"))).withColumn("low", folded(F.col("cut")))
    return cut.select("doc_id", "line_no", F.trim("line").alias("context"), F.inline(F.flatten(F.array(*each))))


def overclaims(lines: DataFrame, lexicon=CLAIM_LANGUAGE) -> DataFrame:
    """Findings of claim language, and of `novel` in abstracts; lines are read once, and those that have in_abstract already are not shuffled."""
    each = [_found(k, *entry) for k, entry in enumerate(lexicon)]
    novel = F.filter(_found(len(each), "novel_in_abstract", "warning", _NOVEL), lambda _: F.col("in_abstract"))
    both = _rows(lines if "in_abstract" in lines.columns else with_abstract(lines), [*each, novel])
    return finding(both, "overclaim", F.col("pattern_name"), F.col("severity"), matched=F.col("matched_text"), details=F.col("context"))


def supported(docs: DataFrame) -> DataFrame:
    """Manuscripts of a kind that can be checked."""
    return docs.filter(F.lower("ext").isin(*EXTENSIONS))
