"""Bibliographies: entries, and their comparison with a reference catalogue."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.likeness import most_alike, normalized, similarity
from scriptorium.tables import stored

#: Fixed value: how an entry begins.
_START = re.compile(r"@(\w+)\s*\{\s*([^,\s}]+)\s*,")
#: Fixed value: blocks that are no entries.
NO_ENTRIES = ("string", "preamble", "comment")


def _entries(text: str) -> list[dict]:
    """Blocks from @type{key, to the brace that closes them; an unclosed one runs to the end."""
    out, at = [], 0
    while m := _START.search(text or "", at):
        depth, end = 1, m.end()
        while end < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        if m[1].lower() not in NO_ENTRIES:
            out.append({"key": m[2], "entry_type": m[1].lower(), "raw": text[m.start() : end]})
        at = m.end()
    return out


def field(raw: Column, name: str) -> Column:
    """The first value of a field: in braces to the first closing one, in quotes, or bare; empty if missing."""
    pattern = f"(?is){name}\\s*=\\s*(?:\\{{([^}}]*)\\}}|\"([^\"]*)\"|(\\S+))"
    parts = [F.nullif(F.regexp_extract(raw, pattern, g), F.lit("")) for g in (1, 2, 3)]
    return F.trim(F.coalesce(*parts, F.lit("")))


def authors(text: Column) -> Column:
    """The names that ` and ` joins, without braces and commands."""
    clean = lambda a: F.trim(F.regexp_replace(F.regexp_replace(F.trim(a), r"\\[a-zA-Z]+\{([^}]*)\}", "$1"), "[{}]", ""))
    return F.filter(F.transform(F.split(text, r"(?i)\s+and\s+"), clean), lambda a: a != "")


def entries(bibs: DataFrame) -> DataFrame:
    """(bib_id, ord, key, entry_type, title, authors, doi, journal, year, raw) of bibs(bib_id, text)."""

    @F.pandas_udf("array<struct<key string, entry_type string, raw string>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(_entries)

    rows = bibs.select("bib_id", F.posexplode(read("text")).alias("ord", "e")).select("bib_id", "ord", "e.*")
    raw = F.col("raw")
    return rows.select("bib_id", "ord", "key", "entry_type", field(raw, "title").alias("title"), authors(field(raw, "author")).alias("authors"), field(raw, "doi").alias("doi"), field(raw, "journal").alias("journal"), field(raw, "year").alias("year"), "raw")


def clean_doi(doi: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(doi, r"(?i)^https?://doi\.org/", ""), r"(?i)^doi:\s*", ""))


def family(author: Column) -> Column:
    """What stands before a comma, else the last word."""
    return normalized(F.when(author.contains(","), F.split(author, ",")[0]).otherwise(F.element_at(F.split(F.trim(author), r"\s+"), -1)))


#: Fixed value: names more alike than this are one.
SAME_NAME = 0.8


def with_author_overlap(df: DataFrame, bib: str, known: str, name: str) -> DataFrame:
    """Adds the share of authors whose family name contains, lies in or resembles a known one, by the larger number of names; null if a side is empty.

    Python is asked only about names that stand in no known one, and only
    beside those that their characters let them resemble.
    """

    @F.pandas_udf("long")
    def resembling(batch: pd.Series) -> pd.Series:
        return pd.Series([None if names is None else sum(any(SequenceMatcher(None, x["name"], b).ratio() > SAME_NAME for b in x["others"]) for x in names) for names in batch], dtype="Int64")

    given = df.withColumn("_ours", F.filter(F.transform(bib, family), lambda a: a != "")).withColumn("_theirs", F.filter(F.transform(known, normalized), lambda a: a != ""))
    contained = lambda a: F.exists("_theirs", lambda b: a.contains(b) | b.contains(a))
    near = F.transform(F.filter("_ours", lambda a: ~contained(a)), lambda a: F.struct(a.alias("name"), F.filter("_theirs", lambda b: most_alike(a, b) > SAME_NAME).alias("others")))
    judged = given.withColumn("_sure", F.size(F.filter("_ours", contained))).withColumn("_near", F.filter(near, lambda x: F.size(x["others"]) > 0))
    # filters on the share must not move below: the optimizer would then write the whole argument into the function's place
    judged = judged.withColumn("_near", F.when(F.size("_near") > 0, F.col("_near"))).withColumn("_more", resembling.asNondeterministic()("_near"))
    largest = F.when((F.size("_ours") > 0) & (F.size("_theirs") > 0), F.greatest(F.size("_ours"), F.size("_theirs")))
    return judged.withColumn(name, (F.col("_sure") + F.coalesce("_more", F.lit(0))) / largest).drop("_ours", "_theirs", "_sure", "_near", "_more")


def looked_up(found: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Entries with their record of catalogue(doi, status, title, families, journal) and doi_status.

    doi_status is no_doi, doi_not_found, api_error (a record without a status)
    or found. A join replaces the network: distinct DOIs are one dimension.
    """
    theirs = catalogue.select(F.col("doi").alias("clean_doi"), "status", F.col("title").alias("known_title"), "families", F.col("journal").alias("known_journal"), F.lit(True).alias("listed"))
    both = found.withColumn("clean_doi", clean_doi(F.col("doi"))).join(theirs, "clean_doi", "left")
    status = F.when(F.col("clean_doi") == "", "no_doi").when(F.col("listed").isNull(), "doi_not_found").when(F.col("status").isNull(), "api_error").otherwise("found")
    return both.withColumn("doi_status", status)


#: Below the first a mismatch, below the second a partial one.
TITLE, AUTHORS, JOURNAL = (0.6, 0.85), (0.3, 0.6), 0.5


def citations(found: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(bib_id, ord, key, severity, issue, score): all findings on entries."""
    below = lambda *x: (F.col("sim") < x[0]) if len(x) == 1 else (F.col("sim") >= x[0]) & (F.col("sim") < x[1])
    met = stored(looked_up(found, catalogue))
    ok = met.filter("doi_status = 'found'")
    rows = lambda df, issue, severity, score=None: df.select("bib_id", "ord", "key", F.lit(severity).alias("severity"), F.lit(issue).alias("issue"), (F.lit(None) if score is None else F.col(score)).cast("double").alias("score"))
    title = ok.filter("title <> '' and known_title <> ''").withColumn("sim", similarity(normalized(F.col("title")), normalized(F.col("known_title"))))
    people = with_author_overlap(ok, "authors", "families", "sim").filter("sim is not null")
    journal = ok.filter("journal <> '' and known_journal <> ''").withColumn("sim", similarity(normalized(F.col("journal")), normalized(F.col("known_journal"))))
    status = [rows(met.filter(F.col("doi_status") == s), s, severity) for s, severity in (("no_doi", "info"), ("doi_not_found", "critical"), ("api_error", "info"))]
    compared = [
        rows(title.filter(below(TITLE[0])), "title_mismatch", "critical", "sim"),
        rows(title.filter(below(*TITLE)), "title_partial_mismatch", "warning", "sim"),
        rows(people.filter(below(AUTHORS[0])), "author_mismatch", "critical", "sim"),
        rows(people.filter(below(*AUTHORS)), "author_partial_mismatch", "warning", "sim"),
        rows(journal.filter(below(JOURNAL)), "journal_mismatch", "warning", "sim"),
    ]
    first, *rest = status + compared
    for df in rest:
        first = first.unionByName(df)
    return first
