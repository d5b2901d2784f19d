"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import oracle
from tidefold.llm.ann import nearest
from tidefold.llm.chat import conversations, format_pairs, weakened
from tidefold.llm.clustering import cluster
from tidefold.llm.langid import fit, identify
from tidefold.llm.licenses import SHORT_NOTICES, scan_licenses
from tidefold.llm.linededup import remove_widespread_lines
from tidefold.llm.mixing import mix
from tidefold.llm.negatives import hard_negatives
from tidefold.llm.packing import pack
from tidefold.llm.quality import quality_rules
from tidefold.llm.secretscan import BASE, find_secrets
from tidefold.llm.simhash import near_duplicates
from tidefold.llm.tokencount import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).drop("rate", "mark")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_short_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notices of fewer than five words, which the SQL of op4_licenses leaves out."""
    return scan_licenses(_table(spark, sf_dir, "documents"), templates=SHORT_NOTICES)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_widespread_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(_table(spark, sf_dir, "documents"))
    return counted.withColumn("tokens", F.col("tokens").cast("long"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks as text: a flag and a length for each segment."""
    found = format_pairs(weakened(conversations(_table(spark, sf_dir, "conversations"))))
    runs = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat(s["train"].cast("int").cast("string"), F.lit(":"), s["chars"].cast("string"))), " "
    )
    return found.withColumns({c: runs(c) for c in ("chosen_mask", "rejected_mask")})


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit(docs.filter(~held_out))
    found = identify(docs.withColumn("held_out", held_out), model, ("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).drop("failed_rules")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as text: kind, start and end."""
    found = find_secrets(_table(spark, sf_dir, "documents"))
    texts = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.sha2(texts(of_kind(*BASE)).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, texts(F.col("spans")).alias("spans"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op5_packing": op5_packing,
    "op3_nearest": op3_nearest,
    "op4_licenses": op4_licenses,
    "op4_short_notices": op4_short_notices,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_chat_format": op8_chat_format,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_secrets": op12_secrets,
    "op13_clusters": op13_clusters,
}

ORACLE: dict[str, str] = {
    "op4_licenses": oracle.LICENSES,
    "op4_short_notices": oracle.SHORT_NOTICES,
    "op6_line_dedup": oracle.LINE_DEDUP,
    "op8_chat_format": oracle.CHAT_FORMAT,
    "op10_quality_rules": oracle.QUALITY_RULES,
    "op11_hard_negatives": oracle.HARD_NEGATIVES,
    "op12_secrets": oracle.SECRETS,
    "op13_clusters": oracle.CLUSTERS,
}
