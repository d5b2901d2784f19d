"""A corpus from raw documents to packed sequences, in five stages.

Every stage works on all documents that the one before has kept. Its result is
written as Parquet in the shared folder and read again, so a lost executor
costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.linededup import remove_widespread_lines
from tidefold.llm.mixing import mixed
from tidefold.llm.packing import pack
from tidefold.llm.quality import keep_good
from tidefold.llm.simhash import SHINGLE, keep_first
from tidefold.session import fresh_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that spread over sites stay in one document only; all documents stay, with all their other columns."""
    # The other columns travel in a struct, so that none meets a column that the operator adds.
    rest = F.struct(*[c for c in docs.columns if c not in ("text", "n_chars")]).alias("rest")
    cleaned = remove_widespread_lines(docs.select("doc_id", "text", "source", rest))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cleaned.select(*[new.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: three-word shingles, fingerprints linked at two differing bits or fewer."""
    return keep_first(docs, width=SHINGLE)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequences that they lie in."""
    return pack(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near),
    ("mixing to target weights", mixing),
    ("packing", packing),
]

# SQL can't express entropy balancing or the tokens; a test compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_dir(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
