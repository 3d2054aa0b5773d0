"""URL filtering: rules first, gradient-boosted trees for the rest.

Rules name a host suffix and a path prefix; the longest that fits decides.
URLs that a rule decides are the labelled ones. Trees are boosted on lexical
features of a bounded sample of them and judge all other URLs. Features are
SQL expressions; only training and the statistics of host suffixes need more
than one pass over the URLs.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.store import stored

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: The bound of the training sample; trees, depth, and the weight of the overall share in a suffix's.
SAMPLE, TREES, DEPTH, PRIOR = 20_000, 16, 4, 20.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def ruled(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits columns host and path; null if none does."""
    found, verdict = [], []
    for says, rule in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        found.append(F.when(fits, rule))
        verdict.append(F.when(fits, says))
    return F.coalesce(*found), F.coalesce(*verdict)


def _entropy(text: Column) -> Column:
    """Bits a character, from how often each occurs."""
    n = F.length(text)
    often = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0).otherwise(n - F.length(F.replace(text, c, F.lit("")))))
    total = F.aggregate(often, F.lit(0.0), lambda s, k: s + F.when(k > 0, k * F.log2(k.cast("double"))).otherwise(0.0))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def _share(text: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kind}]", "")) / F.greatest(F.length(text), F.lit(1))


def features() -> dict[str, Column]:
    """By name, from columns url, host, path and query."""
    return {
        "url_length": F.length("url"),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "query_length": F.length("query"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
        "labels": F.size(F.split("host", r"\.")),
        "hyphens": F.length(F.regexp_replace("host", "[^-]", "")),
        "digit_share": _share(F.col("url"), "0-9"),
        "host_digit_share": _share(F.col("host"), "0-9"),
        "parameters": F.when(F.col("query") == "", 0).otherwise(F.size(F.split("query", "&"))),
        "entropy": _entropy(F.col("url")),
        "host_entropy": _entropy(F.col("host")),
    }


def judged(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages.

    A null url, and one without `://`, has an empty host and path, fits no rule
    and is judged by the trees. Where the rules leave labels of one kind only,
    or none, URLs without a rule are allowed. Repeated rows are judged alike; a
    null page_id passes through. Columns other than page_id and url are
    ignored; an empty table gives no rows.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = parsed(F.col("url"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), url.alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"), F.array_join(F.slice(F.reverse(F.split("host", r"\.")), 1, 2), ".").alias("suffix"))
    answer = ["page_id", "host", "path", "rule"]

    # one half of the labelled URLs gives the suffix statistics, the other the training rows
    labelled = rows.filter("verdict is not null").withColumn("label", (F.col("verdict") == "block").cast("double"))
    half = F.pmod(F.xxhash64("url", F.lit(1)), F.lit(2))
    stats = stored(labelled.filter(half == 0).groupBy("suffix").agg(F.sum("label").alias("blocked"), F.count("*").alias("seen")))
    share = stats.agg(F.coalesce(F.sum("blocked") / F.sum("seen"), F.lit(0.5))).first()[0]

    def featured(df: DataFrame) -> DataFrame:
        df = df.withColumn("query", F.regexp_extract("url", r"\?([^#]*)", 1)).join(stats, "suffix", "left")
        seen = F.coalesce("seen", F.lit(0))
        return df.select("*", *[f.cast("double").alias(f"f_{name}") for name, f in features().items()], F.log1p(seen).alias("f_suffix_seen"), ((F.coalesce("blocked", F.lit(0.0)) + PRIOR * share) / (seen + PRIOR)).alias("f_suffix_blocked"))

    names = [f"f_{name}" for name in (*features(), "suffix_seen", "suffix_blocked")]
    picked = labelled.filter(half == 1).orderBy(F.xxhash64("url"), "url").limit(sample)
    train = stored(featured(picked).select(*names, "label"))
    n, blocked = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < blocked < n:
        return rows.select(*answer, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    # both kinds weigh the same, so that the verdict rests on the features
    train = train.withColumn("weight", F.when(F.col("label") == 1.0, 0.5 * n / blocked).otherwise(0.5 * n / (n - blocked)))
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, maxBins=32, weightCol="weight").fit(assemble.transform(train.coalesce(4)))
    scored = model.transform(assemble.transform(featured(rows)))
    return scored.select(*answer, F.coalesce("verdict", F.when(F.col("prediction") == 1.0, "block").otherwise("allow")).alias("verdict"))
