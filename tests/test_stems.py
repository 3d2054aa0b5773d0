"""What spares lines a regular expression loses no match, and lines are marked once."""

from pyspark.sql import functions as F

from scriptorium.operators import language, lines, numbers
from scriptorium.operators import statistics as stats
from scriptorium.plans import catalogue
from scriptorium.sources import rendered

_SAID = """proven|proves|proof  that|was validated|impossible|machine-precision|statistically indistinguishable|confirms|demonstrates that|first-ever|first of its kind|unprecedented|definitively|conclusively|unequivocally
ground-breaking|revolutionary|paradigm shift|always|never|significant|clearly|obviously|undoubtedly|interestingly|surprisingly|remarkably|strikingly|novel
t-test p = 0.2|Mann-Whitney p = 0.2|Wilcoxon p = 0.2|ANOVA p = 0.2|chi-square p = 0.2|χ 2 p = 0.2|chi2 p = 0.2|Kruskal-Wallis p = 0.2|Fisher's exact p = 0.2|Kolmogorov-Smirnov p = 0.2|K-S test p = 0.2|Shapiro-Wilk p = 0.2
Spearman p = 0.2|Pearson p = 0.2|linear regression p = 0.2|logistic regression p = 0.2|Cox regression p = 0.2|log-rank p = 0.2|mixed model p = 0.2|bootstrap p = 0.2|permutation test p = 0.2|Friedman p = 0.2|McNemar p = 0.2
Tukey p = 0.2|Bonferroni p = 0.2|Holm p = 0.2|Benjamini-Hochberg p = 0.2|FDR p = 0.2|Welch p = 0.2|Dunnett p = 0.2|unpaired p = 0.2|two-sided p = 0.2|one-tailed p = 0.2|sample size of 12, p < .05|12 mice, p ≤ 0.01|N = 4 P-value ≥ 1e-3|nothing p = 0.05
power analysis|statistical power|sample size calculation|a priori power|effect size|Cohen's d|G*Power|no significant difference, so the same|equal, not statistically significant|p > 0.05 so no difference|p = 0.5 and equal|did not reject it, therefore the groups are the same
Tukey's HSD|Sidak|family-wise error|false discovery rate|multiple comparisons|post-hoc corrected|FDR corrected|14.5 %|14 percent|3-fold|2.5x, say|n = 12|12 days 3 hrs 4 min 5 weeks 6 months 7 years|1 mg 2 mL 3 kg 4 mmol 5 nmol 6 pmol 7 ng 8 pg 9 mM 1 nM 2 μM 3 uM 4 Hz 5 kHz 6 MHz|1.2.3 4.5|a % proven 5.5|a <!-- proven --> 6.5 proven"""
_FOLDED = (lambda s: s, str.upper, lambda s: s.replace("s", "ſ").replace("k", "\u212a"), lambda s: s.replace("i", "İ").replace("S", "ſ"), lambda s: "é " + s)


def test_stems_lose_nothing(spark, monkeypatch):
    phrases = [f(p) for f in _FOLDED for p in _SAID.replace("\n", "|").split("|")]
    # each phrase alone, with p-values and without
    texts = [(k, ext, f"\\begin{{abstract}}\n{p}\n{more}\n") for k, (p, more, ext) in enumerate((p, m, e) for p in phrases for m, e in (("plain", ".tex"), ("p = 0.3 p < 0.2 p > 1 p = 0.01", ".md")))]
    docs = spark.createDataFrame(texts, "doc_id long, ext string, text string")

    def found():
        each = lines.with_abstract(lines.with_section(lines.lines_of(docs)))
        parts = (language.overclaims(each), stats.statistics(each), numbers.prose_numbers(each), stats.by_document(each), stats.equivalence_misuse(each), stats.near_p_values(each))
        return [sorted(map(repr, df.collect())) for df in parts]

    got = found()
    assert all(len(rows) > 100 for rows in got[:3])
    for module in (language, stats, numbers):
        monkeypatch.setattr(module, "folded", lambda _: F.lit(None).cast("string"))
        monkeypatch.setattr(module, "may_match", lambda *_: F.lit(True))
    assert found() == got


def test_stored_lines_of_a_review_are_not_shuffled(spark, monkeypatch):
    given, overclaims = [], language.overclaims
    monkeypatch.setattr(language, "overclaims", lambda df: given.append(df) or overclaims(df))
    catalogue._findings(spark, "/root/testdata/sf0.001")
    for df in (overclaims(given[0]), stats.near_p_values(given[0])):
        plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()
        assert "Generate" in plan and "Window" not in plan and "Exchange" not in plan


def test_a_number_is_matched_once(spark):
    each = lines.with_section(lines.lines_of(rendered.documents(spark, "/root/testdata/sf0.001")))
    found = numbers.prose_numbers(each)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == len(numbers.PROSE_NUMBERS)
    conflicts = numbers.context_conflicts(spark.createDataFrame([(1, 1.5, "dose of mice", 1), (1, 2.5, "dose of mice", 2)], "doc_id long, normalized double, context string, line_no int"))
    assert conflicts._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1 and conflicts.count() == 1
