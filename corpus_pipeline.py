"""From raw documents to packed training sequences, stage by stage.

Every stage but the last returns the columns of documents. Stages drop whole
documents by joins on their rows' keys, so nothing is sampled or collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontam, linededup, neardup, packing, toxicity
from scriptorium.llm.store import forget, shared_folder

#: A document is rejected as toxic from this score on.
TOXIC = 0.5


def _dropped(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is among ids(doc_id); rows with a null doc_id stay."""
    return docs.join(ids.filter("doc_id is not null").distinct().hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches TOXIC go. Only the text is scored, so null doc_ids and repeated rows need no join."""
    score = toxicity.scorer(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(score(F.col("text").cast("string")) < TOXIC)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the line blocks that an earlier document has; n_chars follows, and texts left without a word go."""
    return linededup.with_lines_removed(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id.

    Of rows that agree in doc_id and text one stays, the one whose other
    columns come first as JSON; different texts under one doc_id are one
    document, and stay or go together. Rows with a null doc_id stay.
    """
    found = neardup.near_duplicates(docs)
    kept = found.filter("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(kept.hint("merge"), "doc_id", "left_semi")
    others = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in ("doc_id", "text")])
    whole = named.select("doc_id", "text", others.alias("others"))
    one = whole.groupBy("doc_id", "text").agg(F.min_by("others", F.to_json("others")).alias("others")).select("doc_id", "text", "others.*")
    return one.select(*["`" + c.replace("`", "``") + "`" for c in docs.columns]).union(docs.filter("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go, all rows of their doc_id. Null and empty texts have none; rows with a null doc_id stay."""
    leaks = decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _dropped(docs, leaks.select("doc_id"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of training sequences, a null or empty text as its end token alone; each row is packed by itself."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained and randomised stages can't be written as SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over `documents`; each result is written as Parquet and read again, and deleted when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, done = shared_folder(spark), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        if done is not None:
            forget(done)
        docs = done = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
