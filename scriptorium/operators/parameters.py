"""Parameters of analysis code: what comments say and what is assigned."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.values import relative_difference
from scriptorium.operators.findings import finding, together
from scriptorium.tables import stored

#: A name and a number after a # or a quote, and names of steady states.
COMMENT_VALUE = r"(?iU)#.*?(\w+)\s*[=:]\s*([+-]?\d+\.?\d*(?:e[+-]?\d+)?)|[\"'].*?(\w+)\s*[=:]\s*([+-]?\d+\.?\d*(?:e[+-]?\d+)?)"
STEADY_NAMES = ("steady", "fixed_point", "equilibrium")


def comment_values(code: DataFrame) -> DataFrame:
    """(file, line_no, name, value) of code(file, line_no, line)."""
    p = F.lit(COMMENT_VALUE)
    a, b, c, d = (F.regexp_extract_all("line", p, F.lit(g)) for g in (1, 2, 3, 4))
    pair = F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")), lambda x: F.struct(F.coalesce(F.nullif(x["a"], F.lit("")), x["c"]).alias("name"), F.coalesce(F.nullif(x["b"], F.lit("")), x["d"]).cast("double").alias("value")))
    return code.select("file", "line_no", F.inline(pair)).filter("name <> ''")


def _number(node: ast.expr) -> float | None:
    sign = 1
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        sign, node = -1, node.operand
    return sign * float(node.value) if isinstance(node, ast.Constant) and isinstance(node.value, int | float) else None


def _read(source: str) -> list[dict]:
    """Assignments, dictionary entries and steady-state arrays; nothing of a source that doesn't parse."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign):
            value = _number(node.value)
            for target in node.targets:
                name = target.id if isinstance(target, ast.Name) else ast.unparse(target) if isinstance(target, ast.Attribute) else None
                if name and value is not None:
                    out.append({"kind": "assignment", "name": name, "line_no": node.lineno, "value": value})
                listed = node.value.elts if isinstance(node.value, ast.List | ast.Tuple) else [e for a in node.value.args[:1] if isinstance(a, ast.List | ast.Tuple) for e in a.elts] if isinstance(node.value, ast.Call) else []
                if listed and isinstance(target, ast.Name) and any(s in target.id.lower() for s in STEADY_NAMES):
                    values = [_number(e) for e in listed]
                    known = values.index(None) if None in values else len(values)
                    if known:
                        out.append({"kind": "steady_state", "name": target.id, "line_no": node.lineno, "value": float(known)})
        elif isinstance(node, ast.Dict):
            for key, value in zip(node.keys, node.values, strict=True):
                if isinstance(key, ast.Constant) and isinstance(key.value, str) and isinstance(value, ast.Constant) and isinstance(value.value, int | float):
                    out.append({"kind": "dict", "name": key.value, "line_no": value.lineno, "value": float(value.value)})
    return out


def literals(sources: DataFrame) -> DataFrame:
    """(file, kind, name, line_no, value) of sources(file, source): number literals by syntax, in Arrow batches.

    Kinds are assignment, dict, and steady_state, whose value is how many leading numbers its array has.
    """

    @F.pandas_udf("array<struct<kind string, name string, line_no int, value double>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(_read)

    return sources.select("file", F.inline(read("source")))


def mismatches(comments: DataFrame, assigned: DataFrame, by: list[str] = ("file", "name")) -> DataFrame:
    """Pairs of a comment's and a literal's value of one name that differ by more than 0.1 %."""
    theirs = assigned.select(*by, F.col("line_no").alias("code_line"), F.col("value").alias("code_value"))
    apart = relative_difference(F.col("value"), F.col("code_value"))
    return comments.join(theirs, list(by)).filter("value <> 0 and code_value <> 0").withColumn("rel_diff", apart).filter("rel_diff > 0.001")


def duplicates(assigned: DataFrame) -> DataFrame:
    """(file, name, n_values, first_line): names that are assigned more than one value."""
    grouped = assigned.groupBy("file", "name").agg(F.count_distinct("value").alias("n_values"), F.min("line_no").alias("first_line"))
    return grouped.filter("n_values > 1")


def parameters(code: DataFrame, sources: DataFrame) -> DataFrame:
    """All findings on parameters; a file's number is its document's."""
    known, said = stored(literals(sources)), comment_values(code)
    of = lambda kind: known.filter(F.col("kind") == kind)
    doc = lambda df: df.withColumn("doc_id", F.col("file"))
    name = F.col("name")
    return together(
        [
            finding(doc(mismatches(said, of("assignment"))), "parameters", "comment_code_mismatch", "critical", matched=name),
            finding(doc(mismatches(said, of("dict"))), "parameters", "comment_dict_mismatch", "critical", matched=name),
            finding(doc(duplicates(of("assignment"))), "parameters", "duplicate_parameter", "warning", line="first_line", matched=name),
            finding(doc(of("steady_state")), "parameters", "steady_state_found", "info", matched=name),
        ]
    )
