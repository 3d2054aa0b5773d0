"""Manuscripts, code and bibliographies from folders, whole files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.folders import text_files

MANUSCRIPTS = (".tex", ".md", ".txt", ".rst")


def files(spark: SparkSession, path: str, *extensions: str) -> DataFrame:
    """(doc_id, file, name, ext, text) of all files below a path, whatever their names begin with; a missing path fails at once. doc_id is a hash of the file's path."""
    rows = text_files(spark, path, extensions)
    name = F.element_at(F.split("file", "/"), -1)
    return rows.select(F.xxhash64("file").alias("doc_id"), "file", name.alias("name"), F.lower(F.regexp_extract(name, r"\.[^.]+$", 0)).alias("ext"), "text")


def manuscripts(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".tex", ".md")) -> DataFrame:
    unknown = set(extensions) - set(MANUSCRIPTS)
    if unknown:
        raise ValueError(f"not a kind of manuscript: {sorted(unknown)}")
    return files(spark, path, *extensions)


def code_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, stem, line_no, line) of all Python files below a path, and of `_constants.py` and `__init__.py` too."""
    lines = files(spark, path, ".py").select("file", "name", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("file", "name", F.regexp_replace("name", r"\.py$", "").alias("stem"), (F.col("pos") + 1).alias("line_no"), "line")


def model_lines(lines: DataFrame) -> DataFrame:
    """The code lines that are looked at for time units: not those of files whose names begin with two underscores."""
    return lines.filter(~F.col("name").startswith("__"))


def solvers(lines: DataFrame, models: str) -> DataFrame:
    """Of the code lines below the parent of a models' folder, those of the solvers beside that folder and of what lies in its neighbour named coupling."""
    parent = models.rstrip("/").rpartition("/")[0]
    within = F.regexp_replace("file", "^file://", "")
    at = F.when(within.startswith(f"{parent}/"), within.substr(F.lit(len(parent) + 2), F.length(within)))
    return model_lines(lines).filter(at.isin("unified_solver.py", "solver.py") | at.startswith("coupling/"))


def script_references(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, script): Python files that manuscripts name, once for each way of naming them."""
    # fixed values: how manuscripts name scripts
    patterns = (r"(?i)\\texttt\{([^}]*\.py)\}", r"(?i)\\verb\|([^|]*\.py)\|", r"`([^`]*\.py)`", r"(?i)\\lstinputlisting(?:\[.*?\])?\{([^}]*\.py)\}", r"(?iU)(?:run|execute|script|code)\s+(?:in\s+)?(?:the\s+)?[`\"']?(\w[\w/]*\.py)[`\"']?")
    found = F.concat(*[F.regexp_extract_all("line", F.lit(p), F.lit(1)) for p in patterns])
    return lines.select("doc_id", "line_no", F.explode(found).alias("script"))


def resolved(references: DataFrame, scripts: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """references with the path of scripts(path): in the manuscript's own folder, else the longest tail of the path that agrees, else a file of that name; of equals the first.

    With a doc_id, scripts are those of the document's own repository.
    folders(doc_id, folder) says where manuscripts lie, if they do: what a
    repository has at its top comes before it, deeper files after it.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    own = [c for c in ("doc_id",) if c in scripts.columns]
    top = [c for c in ("root",) if c in scripts.columns]
    met = references.withColumn("name", name("script")).join(scripts.select(*own, *top, "path", name("path").alias("name")), [*own, "name"], "left")
    met = met.join(folders, "doc_id", "left") if folders is not None else met.withColumn("folder", F.lit(None).cast("string"))
    at = lambda folder: F.coalesce(F.col("path") == F.concat(folder, F.lit("/"), F.col("script")), F.lit(False))
    exact = F.col("path").endswith(F.concat(F.lit("/"), F.col("script")))
    rank = F.when(at(F.col("root")), 0) if top else F.when(F.lit(False), 0)
    rank = rank.when(at(F.col("folder")), 1).when(exact, 2).otherwise(3)
    return met.groupBy("doc_id", "line_no", "script").agg(F.min_by("path", F.struct(rank, F.length("path"), F.col("path"))).alias("path"))
