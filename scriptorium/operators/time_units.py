"""Time units of model code: declared, implied by rates, and converted between models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.patterns import anywhere

#: Unit names, how units are declared and annotated, how they are converted.
UNITS = {"hours": ("hour", "hours", "hr", "hrs"), "minutes": ("minute", "minutes", "min", "mins"), "days": ("day", "days"), "seconds": ("second", "seconds", "sec", "secs"), "weeks": ("week", "weeks", "wk")}
DECLARED = (
    r"(?i)(?:time\s+(?:in|is|=)\s+|time\s*:\s*|time\s+unit\s*:\s*)(hours?|hrs?|minutes?|mins?|days?|seconds?|secs?|weeks?)",
    r"(?i)units?\s*:.*?time\s+(?:in\s+)?(hours?|hrs?|minutes?|mins?|days?|seconds?|secs?|weeks?)",
)
RATES = (
    r"(?i)#\s*.*?(?:1/|per\s+|/)(hours?|hrs?|hr|minutes?|mins?|min|days?|seconds?|secs?|sec|weeks?|wk)",
    r"(?iU)#\s*.*?\w+/(hours?|hrs?|hr|minutes?|mins?|min|days?|seconds?|secs?|sec|weeks?|wk)",
)
CONVERSION = r"t\s*[*/]\s*(?:60|24|1440|3600)(?:\.0)?|[*/]\s*60(?:\.0)?\s*$"
DOCUMENTED = r"(?i)converted\s+to|→|=>|->|convert(?:ed|s|ing)"
ODE_CALL = r"(\w+_ode)\s*\(([^)]*)\)"


def canonical(unit: Column) -> Column:
    """The unit's plural, in lower case."""
    low = F.lower(F.trim(unit))
    return F.coalesce(*[F.when(low.isin(*names), plural) for plural, names in UNITS.items()], low)


def rate_units(code: DataFrame) -> DataFrame:
    """(file, line_no, unit, line): one row for each pattern that a line of code(file, line_no, line) has."""
    each = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(k).alias("pattern"), canonical(F.regexp_extract("line", p, 1)).alias("unit"))) for k, p in enumerate(RATES)]))
    return code.select("file", "line_no", F.trim("line").alias("line"), F.inline(each))


def by_file(code: DataFrame) -> DataFrame:
    """(file, unit, declared_line, n_rates, n_conversions, first_conversion): the first declaration counts."""
    said = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), canonical(F.regexp_extract("line", p, 1))) for p in DECLARED]))
    rates = F.aggregate(F.array(*[F.col("line").rlike(p).cast("int") for p in RATES]), F.lit(0), lambda a, x: a + x)
    flat = code.select("file", "line_no", F.get(said, F.lit(0)).alias("unit"), rates.alias("rates"), F.col("line").rlike(CONVERSION).alias("converts"))
    line = F.when(F.col("unit").isNotNull(), F.col("line_no"))
    return flat.groupBy("file").agg(F.min_by("unit", line).alias("unit"), F.min(line).alias("declared_line"), F.sum("rates").alias("n_rates"), F.count_if("converts").alias("n_conversions"), F.min(F.when(F.col("converts"), F.col("line_no"))).alias("first_conversion"))


def unit_mismatches(code: DataFrame) -> DataFrame:
    """(file, line_no, unit, declared, issue): rates in another unit than the file declares; a documented conversion is information."""
    declared = by_file(code).filter("unit is not null").select("file", F.col("unit").alias("declared"))
    other = rate_units(code).join(declared, "file").filter("unit <> declared")
    return other.withColumn("issue", F.when(F.col("line").rlike(DOCUMENTED), "documented_unit_conversion").otherwise("internal_unit_mismatch"))


def unit_summary(code: DataFrame) -> DataFrame:
    """(unit, n_files, files): which files declare which unit."""
    return by_file(code).filter("unit is not null").groupBy("unit").agg(F.count("*").alias("n_files"), F.array_join(F.array_sort(F.collect_set(F.col("file").cast("string"))), ",").alias("files"))


def solver_conversions(models: DataFrame, solvers: DataFrame) -> DataFrame:
    """(file, issue, severity, line_no) of solver code if the models use more than one unit: whether it converts."""
    units = by_file(models).agg(F.count_distinct("unit").alias("n_units"))
    return by_file(solvers).crossJoin(F.broadcast(units)).filter("n_units > 1").select("file", F.when(F.col("n_conversions") > 0, "time_conversion_present").otherwise("missing_time_conversion").alias("issue"), F.when(F.col("n_conversions") > 0, "info").otherwise("critical").alias("severity"), F.coalesce("first_conversion", F.lit(0)).alias("line_no"))


def direct_calls(models: DataFrame, solvers: DataFrame) -> DataFrame:
    """(file, line_no, function, unit): calls of a model's equations with a bare `t` and no conversion within two lines.

    models(file, stem, line_no, line): a model is known by its stem or what
    stands before its first underscore; of several the first stem counts.
    """
    near = Window.partitionBy("file").orderBy("line_no").rangeBetween(-2, 2)
    flagged = solvers.withColumn("near", F.max(F.col("line").rlike(CONVERSION)).over(near))
    name, args = (F.regexp_extract_all("line", F.lit(ODE_CALL), F.lit(g)) for g in (1, 2))
    calls = flagged.filter("not near").select("file", "line_no", F.inline(F.arrays_zip(name.alias("function"), args.alias("args"))))
    calls = calls.filter(F.trim(F.split("args", ",")[0]) == "t")
    known = by_file(models).filter("unit is not null").join(models.select("file", "stem").distinct(), "file")
    hints = known.select("stem", "unit", F.explode(F.array_distinct(F.array("stem", F.split("stem", "_")[0]))).alias("hint"))
    met = anywhere(calls.select(F.col("function").alias("text")), hints.select(F.col("hint").alias("pattern"))).select(F.col("text").alias("function"), F.col("pattern").alias("hint"))
    first = met.join(hints, "hint").groupBy("function").agg(F.min_by("unit", F.struct("stem", "hint")).alias("unit"))
    return calls.select("file", "line_no", "function").distinct().join(first, "function").select("file", "line_no", "function", "unit")


def time_units(models: DataFrame, solvers: DataFrame) -> DataFrame:
    """(file, line_no, severity, issue, unit): all findings on time units; file is null for the findings on all models."""
    files, off = by_file(models), unit_mismatches(models)
    cols = lambda df, issue, severity, line, unit="unit": df.select(F.col("file").cast("string").alias("file"), line.cast("int").alias("line_no"), severity.alias("severity"), issue.alias("issue"), F.col(unit).cast("string").alias("unit"))
    first_rate = rate_units(models).groupBy("file").agg(F.min("line_no").alias("line_no"), F.array_join(F.array_sort(F.collect_set("unit")), ",").alias("unit"))
    undeclared = first_rate.join(files.filter("unit is null").select("file"), "file", "left_semi")
    every = files.agg(F.count_distinct("unit").alias("n"), F.array_join(F.array_sort(F.collect_set("unit")), ",").alias("unit")).filter("n > 0").withColumn("file", F.lit(None).cast("string"))
    many = F.col("n") > 1
    out = [
        cols(files.filter("unit is not null"), F.lit("time_unit_detected"), F.lit("info"), F.col("declared_line")),
        cols(off, F.col("issue"), F.when(F.col("issue") == "internal_unit_mismatch", "critical").otherwise("info"), F.col("line_no")),
        cols(undeclared, F.lit("no_time_unit_declaration"), F.lit("warning"), F.col("line_no")),
        cols(solver_conversions(models, solvers).withColumn("unit", F.lit("")), F.col("issue"), F.col("severity"), F.col("line_no")),
        cols(direct_calls(models, solvers), F.lit("direct_t_pass"), F.lit("warning"), F.col("line_no")),
        cols(every, F.when(many, "multiple_time_units").otherwise("uniform_time_units"), F.when(many, "warning").otherwise("info"), F.lit(0)),
    ]
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first
