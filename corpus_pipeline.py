"""Cleans the documents and turns them into token ids, stage by stage.

Every stage takes the rows that the former one kept, whole texts. For all of them:
a null text is an empty one (and stays null where the text isn't changed); null and
reused doc_ids are rows like any other; repeated rows are treated alike (of repeated
rows one stays, as of other copies); extra columns are handed on, whatever their
names, by all stages but the last, which drops them; an empty table gives an empty
one; an empty benchmark or no labels reject and change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, pii, simhash, toxicity, wfst
from quillspark.llm.common import Shelf, free


def _counted(docs: DataFrame, cols: list[str]) -> DataFrame:
    """n_chars, where there is such a column, says how long the text is now."""
    if "n_chars" in cols:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*cols)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Without labels of both classes none does."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free("score", docs.columns)
    return toxicity.score(docs, model, name).where(F.col(name) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id (any one of a group without ids). Texts
    without words are copies of each other."""
    return simhash.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts; n_chars follows."""
    return _counted(decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by the name of their kind; n_chars follows."""
    return _counted(pii.redact(docs), docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of every document, with their number, how many are bytes, their crc32, and whether they decode to the text."""
    return wfst.encode(docs).select("doc_id", "ids", "n_pieces", "n_bytes", "ids_crc32", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("pii", mask_personal),
    ("sentencepiece", to_pieces),
]
#: No SQL expresses the stages; tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shelf = Shelf(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
