"""Statistical reporting: p-values and what must stand near them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.stems import folded, may_match
from scriptorium.operators.findings import finding, together
from scriptorium.operators.lines import with_context

#: Patterns of statistical reporting. Both p-value patterns apply to each line.
P_VALUES = (r"(?:p|P)[\s-]*(?:value)?\s*([<=>≤≥])\s*(\d*\.?\d+(?:e[+-]?\d+)?)", r"(?:p|P)[\s-]*(?:value)?\s*([<=>≤≥])\s*(\.?\d+(?:e[+-]?\d+)?)")
TESTS = "|".join((r"t[\s-]?test", r"Mann[\s-]Whitney", r"Wilcoxon", r"ANOVA", r"chi[\s-]?square", r"χ\s*2", r"chi2", r"Kruskal[\s-]Wallis", r"Fisher'?s?\s+exact", r"Kolmogorov[\s-]Smirnov", r"K[\s-]S\s+test", r"Shapiro[\s-]Wilk", r"Spearman", r"Pearson", r"linear\s+regression", r"logistic\s+regression", r"Cox\s+regression", r"log[\s-]?rank", r"mixed[\s-]?model", r"bootstrap", r"permutation\s+test", r"Friedman", r"McNemar", r"Tukey", r"Bonferroni", r"Holm", r"Benjamini[\s-]Hochberg", r"FDR", r"Welch", r"Dunnett", r"paired", r"unpaired", r"two[\s-]?sided", r"one[\s-]?sided", r"two[\s-]?tailed", r"one[\s-]?tailed"))
SAMPLE_SIZES = r"[nN]\s*=\s*\d+|(?i:sample\s+size\s+(?:of\s+)?\d+|\d+\s+(?:subjects?|participants?|patients?|samples?|observations?|trials?|mice|rats|animals?))"
POWER = "|".join((r"power\s+analysis", r"statistical\s+power", r"sample\s+size\s+calculation", r"a\s+priori\s+power", r"effect\s+size", r"Cohen'?s?\s+[dfw]", r"G\*?Power"))
EQUIVALENCE = (
    r"(?:no|not?)\s+(?:statistically\s+)?significant\s+difference.*(?:similar|same|equal|equivalent|identical|comparable)",
    r"(?:similar|same|equal|equivalent|identical|comparable).*(?:no|not?)\s+(?:statistically\s+)?significant",
    r"p\s*[>=>≥]\s*0\.0?5.*(?:no\s+difference|same|equal|equivalent)",
    r"(?:failed\s+to\s+reject|did\s+not\s+reject).*(?:therefore|thus|hence|so)\s+(?:the\s+)?(?:groups?\s+)?(?:are|were)\s+(?:the\s+)?same",
)
CORRECTIONS = "|".join((r"Bonferroni", r"Holm", r"Benjamini[\s-]Hochberg", r"FDR\s+correct", r"false\s+discovery\s+rate", r"multiple\s+comparison", r"post[\s-]?hoc\s+correct", r"Tukey'?s?\s+HSD", r"Dunnett", r"Sidak", r"family[\s-]?wise\s+error"))
ROUND = (0.05, 0.01, 0.001)
#: What each match of the patterns above has, in lower case; a p-value has one of the signs.
_SIGNS = ("<", "=", ">", "≤", "≥")
#: The tests that are plain words, and what each match of the others has.
_TEST_WORDS = tuple(p.lower() for p in TESTS.split("|") if p.isascii() and p.isalnum())
_OTHER_TESTS = "|".join(p for p in TESTS.split("|") if p.lower() not in _TEST_WORDS)
_TEST_STEMS = ("test", "mann", "chi", "kruskal", "fisher", "kolmogorov", "shapiro", "regression", "rank", "mixed", "benjamini", "sided", "tailed")
_SIZE_STEMS = ("subject", "participant", "patient", "sample", "observation", "trial", "mice", "rats", "animal")
_POWER_STEMS = ("power", "calculation", "effect", "cohen")
_EQUIVALENCE_STEMS = (("significant",), ("significant",), ("0.",), ("reject",))
_CORRECTION_STEMS = ("bonferroni", "holm", "benjamini", "correct", "discovery", "comparison", "tukey", "dunnett", "sidak", "family")


def _found(column: str = "line") -> Column:
    """The p-values of a line as (operator, value): one for each match of each pattern."""

    def found(pattern: str) -> Column:
        sign, digits = (F.regexp_extract_all(column, F.lit(f"(?U){pattern}"), F.lit(g)) for g in (1, 2))
        return F.transform(F.arrays_zip(sign.alias("s"), digits.alias("d")), lambda x: F.struct(x["s"].alias("operator"), x["d"].cast("double").alias("value")))

    none = F.array().cast("array<struct<operator: string, value: double>>")
    return F.when(may_match(F.col(column), _SIGNS), F.concat(*[found(p) for p in P_VALUES])).otherwise(none)


def p_values(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, operator, value, context): one row for each match of each pattern; line columns stay."""
    return lines.select("*", F.inline(_found()))


_MARKS = ("p_values", "has_sample_size", "has_test")


def with_p_values(lines: DataFrame) -> DataFrame:
    """Adds p_values, an array, and to lines that have some has_sample_size and has_test: whether the lines within five say so. Only around p-values is the context read."""
    some = with_context(lines.withColumn("p_values", _found()), F.size("p_values") > 0)
    context, low = F.col("context"), F.col("_low")
    # without characters beyond ASCII the letters of a pattern need no Unicode, and its plain words no pattern
    size = (low.contains("=") & low.rlike(r"n\s*=\s*\d")) | (may_match(low, _SIZE_STEMS) & context.rlike(SAMPLE_SIZES))
    test = may_match(low, _TEST_WORDS) | (may_match(low, _TEST_STEMS) & low.rlike(_OTHER_TESTS.lower()))
    judged = lambda p, plain: F.when(low.isNull(), context.rlike(p)).otherwise(plain)
    flags = some.withColumn("_low", folded(context)).withColumn("has_sample_size", judged(f"(?U){SAMPLE_SIZES}", size)).withColumn("has_test", judged(f"(?iU){TESTS}", test))
    return flags.drop("context", "_low")


def near_p_values(lines: DataFrame) -> DataFrame:
    """p_values with has_sample_size and has_test; lines that with_p_values has marked are not shuffled."""
    marked = lines if "p_values" in lines.columns else with_p_values(lines)
    return marked.select(*[c for c in marked.columns if c not in _MARKS], "has_sample_size", "has_test", F.inline("p_values"))


def _misread(low: Column) -> Column:
    """The numbers of the patterns by which a line reads a missing difference as sameness; low: folded(line)."""
    return F.array_compact(F.array(*[F.when(may_match(low, stems) & F.col("line").rlike(f"(?iU){p}"), k) for k, (p, stems) in enumerate(zip(EQUIVALENCE, _EQUIVALENCE_STEMS, strict=True))]))


def equivalence_misuse(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, pattern): lines that read a missing difference as sameness, once for each pattern."""
    return lines.select("doc_id", "line_no", F.trim("line").alias("context"), F.explode(_misread(folded(F.col("line")))).alias("pattern"))


def _documents(lines: DataFrame) -> DataFrame:
    """by_document, and misread: the lines that equivalence_misuse finds, as many times."""
    low, found = F.col("_low"), F.col("p_values") if "p_values" in lines.columns else _found()
    says = lambda p, stems: may_match(low, stems) & F.col("line").rlike(f"(?iU){p}")
    each = lines.withColumn("_low", folded(F.col("line"))).select("doc_id", "line_no", F.trim("line").alias("context"), F.size(found).alias("n"), says(CORRECTIONS, _CORRECTION_STEMS).alias("c"), says(POWER, _POWER_STEMS).alias("w"), _misread(low).alias("m"))
    hits = F.flatten(F.collect_list(F.when(F.size("m") > 0, F.array_repeat(F.struct("line_no", "context"), F.size("m"))))).alias("misread")
    return each.groupBy("doc_id").agg(F.sum("n").alias("n_p_values"), F.min(F.when(F.col("n") > 0, F.col("line_no"))).alias("first_line"), F.bool_or("c").alias("has_correction"), F.bool_or("w").alias("has_power"), hits)


def by_document(lines: DataFrame) -> DataFrame:
    """(doc_id, n_p_values, first_line, has_correction, has_power)."""
    return _documents(lines).drop("misread")


def statistics(lines: DataFrame) -> DataFrame:
    """All findings on statistical reporting. Without a p-value the only finding is that there is none.

    Two passes: over what stands near p-values, and over whole documents.
    """
    none = F.lit("")

    def row(issue: str, severity: str, line: Column, details: Column = none) -> Column:
        return F.struct(line.cast("int").alias("line_no"), F.lit(severity).alias("severity"), F.lit(issue).alias("issue"), details.alias("details"))

    def rows(df: DataFrame, found: Column) -> DataFrame:
        return finding(df.select("doc_id", F.inline(found)), "statistics", F.col("issue"), F.col("severity"), details=F.col("details"))

    at, text = F.col("line_no"), F.trim("line")
    near = F.array(
        F.when(~F.col("has_sample_size"), row("no_sample_size", "warning", at, text)),
        F.when(~F.col("has_test"), row("no_test_named", "warning", at, text)),
        F.when(F.col("value").isin(*ROUND) & (F.col("operator") == "="), row("round_p_value", "info", at, text)),
    )
    some = F.col("n_p_values") > 0
    whole = F.array(
        F.when(~some, row("no_p_values", "info", F.lit(0))),
        F.when((F.col("n_p_values") > 3) & ~F.col("has_correction"), row("no_multiple_comparison_correction", "warning", F.col("first_line"))),
        F.when(some & ~F.col("has_power"), row("no_power_analysis", "info", F.lit(0))),
    )
    misread = F.transform(F.when(some, F.col("misread")).otherwise(F.slice("misread", 1, 0)), lambda x: row("nonsig_as_equivalence", "critical", x["line_no"], x["context"]))
    return together([rows(near_p_values(lines), F.array_compact(near)), rows(_documents(lines), F.concat(F.array_compact(whole), misread))])
