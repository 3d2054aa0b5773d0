"""Declared papers: claims, statistics, models and couplings as tables, checked before they are built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.blocks import BLOCK, in_blocks, so_far

#: Phrases of a claim's strength, and words that no claim may have.
PERMITTED = ("indicates", "suggests", "is consistent with", "predicts", "shows", "supports", "provides evidence for", "to our knowledge")
FORBIDDEN = ("demonstrates", "proves", "validates", "confirms", "novel", "paradigm shift", "breakthrough", "first ever", "clearly shows", "undeniably", "definitively")


def forbidden_words(text: Column) -> Column:
    """The forbidden words that a text contains, in any case, also within other words."""
    return F.array_compact(F.array(*[F.when(F.lower(text).contains(w), w) for w in FORBIDDEN]))


def claim_errors(claims: DataFrame) -> DataFrame:
    """(paper_id, claim_no, issue, detail) of claims(paper_id, claim_no, text, evidence, citations, strength, with_value, without_value)."""
    words = F.transform(forbidden_words(F.col("text")), lambda w: F.struct(F.lit("forbidden_word").alias("issue"), w.alias("detail")))
    one = lambda test, issue, detail=None: F.when(test, F.struct(F.lit(issue).alias("issue"), (F.lit("") if detail is None else detail).alias("detail")))
    rules = F.array_compact(
        F.array(
            one(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "no_evidence"),
            one(F.coalesce(F.size("citations"), F.lit(0)) <= 0, "no_citation"),
            one(F.col("strength").isNotNull() & ~F.col("strength").isin(*PERMITTED), "strength_not_permitted", F.col("strength")),
            one(F.col("with_value") == F.col("without_value"), "ablation_without_effect"),
        )
    )
    return claims.select("paper_id", "claim_no", F.inline(F.concat(words, rules)))


def claim_gate(claims: DataFrame) -> DataFrame:
    """(paper_id, n_claims, n_errors, builds): a paper builds if its claims have no error."""
    errors = claim_errors(claims).groupBy("paper_id").agg(F.count("*").alias("n_errors"))
    counted = claims.groupBy("paper_id").agg(F.count("*").alias("n_claims"))
    return counted.join(errors, "paper_id", "left").select("paper_id", "n_claims", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.col("n_errors").isNull().alias("builds"))


def priority_warnings(claims: DataFrame, searches: DataFrame) -> DataFrame:
    """Claims that say `first` in papers of searches(paper_id, n_terms) whose prior-art check had no terms."""
    empty = searches.filter("n_terms = 0").select("paper_id")
    return claims.filter(F.lower("text").contains("first")).join(empty, "paper_id", "left_semi")


def unlabelled_models(models: DataFrame) -> DataFrame:
    """Models of the second tier without a label."""
    return models.filter("tier = 2 and coalesce(label, '') = ''")


def coupled_units(couplings: DataFrame, models: DataFrame) -> DataFrame:
    """(paper_id, source, target, source_unit, target_unit) of couplings between models of different time units."""
    unit = lambda side: models.select("paper_id", F.col("name").alias(side), F.col("time_unit").alias(f"{side}_unit"))
    both = couplings.join(unit("source"), ["paper_id", "source"], "left").join(unit("target"), ["paper_id", "target"], "left")
    known = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    return both.select("paper_id", "source", "target", known("source_unit"), known("target_unit")).filter("source_unit <> target_unit")


def statistics_found(stats: DataFrame, outputs: DataFrame) -> DataFrame:
    """stats(paper_id, name, value, raw) with verified: the script's output has it as text, or a number within 5 %."""
    numbers = F.filter(F.transform(F.regexp_extract_all("stdout", F.lit(r"[\d.]+"), F.lit(0)), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    near = F.exists(numbers, lambda v: F.abs(v - F.col("value")) / F.greatest(F.abs(F.col("value")), F.lit(1e-10)) < 0.05)
    both = stats.join(outputs.select("paper_id", "stdout"), "paper_id", "left")
    return both.withColumn("verified", F.coalesce(F.col("stdout").contains(F.col("raw")) | near, F.lit(False))).drop("stdout")


def audit(models: DataFrame, stats: DataFrame) -> DataFrame:
    """(paper_id, n_models, n_equations, n_tier1, n_tier2, n_calibrated, n_statistics, n_verified)."""
    tier = lambda t: F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("n_equations"))), F.lit(0))
    by_model = models.groupBy("paper_id").agg(F.count("*").alias("n_models"), F.sum("n_equations").alias("n_equations"), tier(1).alias("n_tier1"), tier(2).alias("n_tier2"), F.sum("n_calibrated").alias("n_calibrated"))
    by_stat = stats.groupBy("paper_id").agg(F.count("*").alias("n_statistics"), F.count_if("verified").alias("n_verified"))
    return by_model.join(by_stat, "paper_id", "full").na.fill(0)


#: What needs an open claim or method, and is an error or passed over without.
NEEDS_CLAIM, MAY_LACK_CLAIM = ("evidence", "statistic", "citation", "figure"), ("strength", "ablation_proof", "run_and_verify", "prior_art_check")
NEEDS_METHOD, MAY_LACK_METHOD, OF_MODEL = ("model",), ("coupling", "verify_time_units"), ("param_published", "param_calibrated")


def attached(log: DataFrame, blocks: int | None = None) -> DataFrame:
    """log(paper_id, seq, kind, ...) of declarations with owner, the seq of what each belongs to, and status.

    A claim is open from its declaration to the next claim or method, a method
    to the next method, and a model to the next model or method; a claim leaves
    the method open. status is `open` for claims and methods, `attached`,
    `error` for what is declared where nothing is open for it, and `ignored` for
    kinds that are then passed over. A paper with many declarations lies in
    several blocks, over whose borders what is open is carried.
    """
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    opened = lambda *kinds: F.when(is_(*kinds), F.struct("kind", "seq"))
    rows = so_far(in_blocks(log, ["paper_id"], ["seq"], blocks), ["paper_id"], ["seq"], {"_claim": opened("claim", "method"), "_method": opened("method"), "_model": opened("method", "model")})
    of = lambda mark, kind: F.when(F.col(f"{mark}.kind") == kind, F.col(f"{mark}.seq"))
    method = of("_method", "method")
    model = F.when(method.isNotNull(), of("_model", "model"))
    owner = F.when(is_(*NEEDS_CLAIM, *MAY_LACK_CLAIM), of("_claim", "claim")).when(is_(*NEEDS_METHOD, *MAY_LACK_METHOD), method).when(is_(*OF_MODEL), model)
    status = F.when(is_("claim", "method"), "open").when(F.col("owner").isNotNull(), "attached").when(is_(*NEEDS_CLAIM, *NEEDS_METHOD), "error").otherwise("ignored")
    return rows.withColumn("owner", owner).withColumn("status", status).drop("_claim", "_method", "_model", BLOCK)


def declared_claims(declared: DataFrame) -> DataFrame:
    """(paper_id, seq, n_evidence, n_citations, n_statistics, issues) of attached(): each claim with what it has, and whether evidence or citations are missing."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    counts = declared.filter("status = 'attached'").groupBy("paper_id", F.col("owner").alias("seq")).agg(n("evidence").alias("n_evidence"), n("citation").alias("n_citations"), n("statistic").alias("n_statistics"))
    claims = declared.filter("kind = 'claim'").select("paper_id", "seq").join(counts, ["paper_id", "seq"], "left").na.fill(0, ["n_evidence", "n_citations", "n_statistics"])
    return claims.withColumn("issues", F.concat_ws(",", F.when(F.col("n_evidence") == 0, "no_evidence"), F.when(F.col("n_citations") == 0, "no_citation")))


def declared_models(declared: DataFrame) -> DataFrame:
    """(paper_id, seq, n_published, n_calibrated) of attached(): each model of a method with its parameters."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    counts = declared.filter("status = 'attached'").groupBy("paper_id", F.col("owner").alias("seq")).agg(n("param_published").alias("n_published"), n("param_calibrated").alias("n_calibrated"))
    return declared.filter("kind = 'model' and status = 'attached'").select("paper_id", "seq").join(counts, ["paper_id", "seq"], "left").na.fill(0, ["n_published", "n_calibrated"])


def figure_digest(figures: DataFrame) -> DataFrame:
    """(path, digest) of files read by the binaryFile source."""
    return figures.select("path", F.substring(F.sha2("content", 256), 1, 16).alias("digest"))
