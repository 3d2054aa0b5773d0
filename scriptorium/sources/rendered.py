"""Synthetic manuscripts, code, outputs and bibliographies, written from the star-schema tables.

The prose of the test tables has no claims, p-values or LaTeX. These
expressions render such inputs from keys, in SQL that Spark and DuckDB both
read, so that queries have something to find. `~` stands for a backslash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.tables import dealt

_SENTENCES = (
    "This result proves the rule and has proven proof  that it holds.",
    "The model was validated, not validated twice, and qualitatively validated once.",
    "It is impossible to reach machine precision or machine-precision here.",
    "Groups were statistically indistinguishable.",
    "This confirms the trend and demonstrates that it lasts.",
    "The first-ever, first of its kind, unprecedented view.",
    "We definitively and conclusively show it.",
    "A groundbreaking paradigm shift.",
    "It is always positive, always there, never zero, never late.",
    "A significant effect, significant at once, significant p < 0.01 in t-test.",
    "Clearly and Obviously it works, surprisingly so.",
    "Nothing of note. % this is proven",
    "A share of 100~% proves little. % clearly",
    "We saw p = 0.05 in n = 12 mice.",
    "We saw p < 0.032.",
    "A paired t-test gave p = 0.01 and p > .5 here.",
    "There was no significant difference, so the groups are similar.",
    "ANOVA with Bonferroni gave p = 0.2.",
    "A power analysis was done.",
    "Text <!-- proven --> proves it.",
    "We measured 12 days and 2.5-fold, 40 Hz at 3 mM.",
    "Values fell by 14.5% over 3 weeks.",
    "The novel view is clear.",
    "Plain words only.",
)


def _case(of: str, texts: tuple[str, ...]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(texts)) + " END"


_DOC, _K = "CAST(floor(o_orderkey / 50) AS BIGINT)", "CAST(o_orderkey % 50 AS INT)"
_X = "CAST(100 + CAST(floor(o_orderkey / 50) AS BIGINT) % 37 AS VARCHAR(20))"
_BODY = "CAST(100 + CAST(floor(o_orderkey / 50) AS BIGINT) % 37 + o_custkey % 4 AS VARCHAR(20))"
_CELL = "CAST(100 + CAST(floor(o_orderkey / 50) AS BIGINT) % 37 + o_custkey % 9 AS VARCHAR(20))"
_MD = "CAST(floor(o_orderkey / 50) AS BIGINT) % 4 = 3"
#: columns of `orders` to doc_id, ext, line_no, line
MANUSCRIPT_LINES = {
    "doc_id": _DOC,
    "ext": f"CASE WHEN {_MD} THEN '.md' ELSE '.tex' END",
    "line_no": f"{_K} + 1",
    "line": f"""replace(CASE {_K}
        WHEN 0 THEN '~title{{Study of tissue}}'
        WHEN 1 THEN CASE WHEN {_MD} THEN '## Abstract' ELSE '~begin{{abstract}}' END
        WHEN 2 THEN 'We report a novel dose of ' || {_X} || '.5 mg in tissue.'
        WHEN 3 THEN 'The mean was ' || {_X} || '.25 and 77.7 overall.'
        WHEN 4 THEN CASE WHEN {_MD} THEN '# Introduction' ELSE '~end{{abstract}}' END
        WHEN 15 THEN CASE WHEN {_MD} THEN '## Methods' ELSE '~section{{Methods}}' END
        WHEN 16 THEN 'The dose was ' || {_BODY} || '.5 mg in tissue.'
        WHEN 17 THEN 'In the second series, which two readers kept apart from all the others, the dose was ' || {_BODY} || '.25 there, and no other sentence of this series is nearly as long as this one.'
        WHEN 20 THEN CASE WHEN {_MD} THEN '## Results' ELSE '~section*{{Results and Discussion}}' END
        WHEN 21 THEN 'A change of ' || {_BODY} || ' days was seen.'
        WHEN 22 THEN 'It took ' || CAST(o_custkey % 50 + 400 AS VARCHAR(20)) || ' ms.'
        WHEN 23 THEN CASE WHEN {_DOC} % 6 = 5 THEN 'Values were typed in by hand.' ELSE 'All values come from `fit.py`.' END
        WHEN 30 THEN '~begin{{table}}'
        WHEN 31 THEN '~caption{{Doses up to ' || {_X} || ' mg}}'
        WHEN 32 THEN '~end{{table}}'
        WHEN 33 THEN '~begin{{table}}'
        WHEN 34 THEN '~begin{{tabular}}{{ll}} dose & ' || {_CELL} || '.5 ~~ rate & $1.48 ~times 10^{{2}}$ ~end{{tabular}}'
        WHEN 35 THEN '~end{{table}}'
        WHEN 36 THEN CASE WHEN {_MD} THEN '## Limits' ELSE '~subsection{{Limits}}' END
        ELSE {_case("o_custkey % 24", _SENTENCES)} END, '~', chr(92))""",
}
#: One row for each document, from all its orders.
OUTPUT_ROWS = "(SELECT min(o_orderkey) AS o_orderkey, min(o_custkey) AS o_custkey FROM orders GROUP BY floor(o_orderkey / 50))"
#: columns of OUTPUT_ROWS to script outputs and declared claims, one of each document
OUTPUTS = {
    "doc_id": _DOC,
    "script": "'fit.py'",
    "exit_code": "CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END",
    "stdout": f"CASE {_DOC} % 13 WHEN 3 THEN ' ' WHEN 4 THEN 'done' ELSE 'dose: ' || {_BODY} || '.5' || chr(10) || 'rate ' || CAST(140 + o_custkey % 30 AS VARCHAR(20)) || '.0 OK' END",
    "stderr": "CASE WHEN o_custkey % 5 = 0 THEN 'ValueError' ELSE '' END",
}
_FILE, _P = "CAST(floor(p_partkey / 20) AS BIGINT)", "CAST(p_partkey % 20 AS INT)"
#: columns of `part` to file, line_no, line
CODE_LINES = {
    "file": _FILE,
    "line_no": f"{_P} + 1",
    "line": f"""CASE {_P}
        WHEN 0 THEN CASE {_FILE} % 4 WHEN 0 THEN '# Units: time in hours' WHEN 1 THEN '# time unit: MIN' WHEN 2 THEN '# time in days' ELSE '# a model' END
        WHEN 1 THEN 'k_on = ' || CAST(p_size AS VARCHAR(20)) || '  # k_on = ' || CAST(p_size + p_partkey % 3 AS VARCHAR(20))
        WHEN 2 THEN 'k_off = 0.5  # 1/hr'
        WHEN 3 THEN 'k_deg = 1.5  # per min, converted to 1/hr'
        WHEN 4 THEN 'rates = {{"alpha": 3, "beta": 4}}  # alpha = 5'
        WHEN 5 THEN 'k_on = ' || CAST(p_size + 1 AS VARCHAR(20))
        WHEN 6 THEN 'dose = ' || CAST(100 + {_FILE} % 37 + p_size % 4 AS VARCHAR(20))
        WHEN 7 THEN 'y = hpa_ode(t, x)'
        WHEN 8 THEN CASE WHEN {_FILE} % 5 = 0 THEN 'y = hpa_ode(t * 60, x)' ELSE 'pass' END
        WHEN 9 THEN 'steady_state = [1.0, 2.0, k_on]'
        ELSE 'x' || CAST({_P} AS VARCHAR(20)) || ' = ' || CAST(p_size AS VARCHAR(20)) || '.5' END""".replace("{{", "{").replace("}}", "}"),
}
#: columns of `supplier` to bib_id, text and the catalogue's record
BIBLIOGRAPHY = {
    "bib_id": "s_suppkey",
    "text": """'@article{key' || CAST(s_suppkey AS VARCHAR(20)) || ',' || chr(10) || ' title = {Cortisol dynamics in cohort ' || CAST(s_nationkey AS VARCHAR(20)) || '},' || chr(10) ||
        ' author = {Smith, Ann and Bob Jones' || CASE WHEN s_suppkey % 3 = 0 THEN ' and Lee, C.' ELSE '' END || '},' || chr(10) || ' journal = {J. Tissue},' || chr(10) ||
        CASE s_suppkey % 7 WHEN 0 THEN '' ELSE ' doi = {https://doi.org/10.1/' || CAST(s_suppkey AS VARCHAR(20)) || '},' || chr(10) END || ' year = {2010}' || chr(10) || '}'""",
}
CATALOGUE = {
    "doi": "'10.1/' || CAST(s_suppkey AS VARCHAR(20))",
    "status": "CASE WHEN s_suppkey % 7 = 2 THEN NULL ELSE 'ok' END",
    "title": "CASE WHEN s_suppkey % 2 = 0 THEN 'Cortisol dynamics in cohort ' || CAST(s_nationkey AS VARCHAR(20)) ELSE 'Other matters altogether' END",
    "names": "CASE s_suppkey % 4 WHEN 0 THEN 'Smith,Jones' WHEN 1 THEN 'SMITH,Brown,Gray,White' WHEN 2 THEN 'Brown' ELSE 'Lee,Jones' END",
    "journal": "CASE WHEN s_suppkey % 5 = 0 THEN 'Annals of Quite Something Else' ELSE 'J. Tissue' END",
}


def table(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str], where: str = "true") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").filter(where).selectExpr(*[f"{sql} AS {c}" for c, sql in columns.items()])


def select(columns: dict[str, str], table_name: str, where: str = "true") -> str:
    """The same as SQL text."""
    return "SELECT " + ", ".join(f"{sql} AS {c}" for c, sql in columns.items()) + f" FROM {table_name} WHERE {where}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ext, text): the manuscripts as whole texts. Keys travel, and lines are written where their document is."""
    keys = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), F.expr(_DOC))
    lines = keys.selectExpr(*[f"{sql} AS {c}" for c, sql in MANUSCRIPT_LINES.items()]).groupBy("doc_id", "ext").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return lines.select("doc_id", "ext", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("text"))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", CODE_LINES)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, source): whole files of code."""
    lines = code(spark, sf_dir).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return lines.select("file", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("source"))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.floor(F.col("o_orderkey") / 50)).agg(F.min("o_orderkey").alias("o_orderkey"), F.min("o_custkey").alias("o_custkey"))
    return orders.selectExpr(*[f"{sql} AS {c}" for c, sql in OUTPUTS.items()])


def bibliographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier", BIBLIOGRAPHY)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all but every seventh cited work."""
    return table(spark, sf_dir, "supplier", CATALOGUE, "s_suppkey % 7 <> 1").withColumn("families", F.split("names", ",")).drop("names")


#: The model and the agent that an event names, some of them none; they differ from event to event.
EVENT_MODEL, EVENT_AGENT = "CASE WHEN event_id % 7 <> 0 THEN event_id % 4 END", "CASE WHEN event_id % 11 <> 0 THEN event_id % 5 END"


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, ts, event_id, event, model_id, agent_id, difficulty) from the clicks of users."""
    name = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "complete").when(F.col("event_type") == "purchase", "verify").when(F.col("event_type") == "error", "fail").otherwise("start")
    of = lambda sql, name: F.expr(sql).cast("bigint").alias(name)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("task_id"), "ts", "event_id", name.alias("event"), of(EVENT_MODEL, "model_id"), of(EVENT_AGENT, "agent_id"), (F.col("user_id") % 3).alias("difficulty"))
