"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import ann, bagminhash, bestfit, divergence, langid, lattice, packing, pieces, pii, resample, ring, suffixes, zones
from quire.llm.common import table


def op1_packing(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack(table(spark, base, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_language_id(spark: SparkSession, base: str) -> DataFrame:
    return langid.identify(table(spark, base, "documents"))


def op3_pii(spark: SparkSession, base: str) -> DataFrame:
    found = pii.find(table(spark, base, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)),
        F.sha2(pii.shown(F.col("base")), 256).alias("base_sha256"),
        pii.shown(F.col("spans")).alias("spans"),
    )


def op4_suffix_dedup(spark: SparkSession, base: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, base, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, base: str) -> DataFrame:
    return divergence.quality(table(spark, base, "documents"))


def op6_nearest(spark: SparkSession, base: str) -> DataFrame:
    return ann.nearest(table(spark, base, "embeddings"))


def op7_sharding(spark: SparkSession, base: str) -> DataFrame:
    out = ring.shard_documents(table(spark, base, "documents"), shards=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_binary_output(spark: SparkSession, base: str) -> DataFrame:
    return bestfit.pack_matrix(table(spark, base, "documents"))


def op9_minhash(spark: SparkSession, base: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, base, "documents"))


def op10_sentencepiece(spark: SparkSession, base: str) -> DataFrame:
    done = pieces.decode(pieces.encode(table(spark, base, "documents")))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_resampling(spark: SparkSession, base: str) -> DataFrame:
    drawn = resample.resample(table(spark, base, "documents"), table(spark, base, "benchmark"), percent=10, least_words=20, most=1, buckets=10_000, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_clustering(spark: SparkSession, base: str) -> DataFrame:
    return zones.cluster(table(spark, base, "embeddings"), k=40, rounds=5, seed=2, width=64, scale=256)


def op13_lm_scoring(spark: SparkSession, base: str) -> DataFrame:
    return lattice.score(table(spark, base, "documents"))


QUERIES = {
    q.__name__: q
    for q in (
        op1_packing,
        op2_language_id,
        op3_pii,
        op4_suffix_dedup,
        op5_quality,
        op6_nearest,
        op7_sharding,
        op8_binary_output,
        op9_minhash,
        op10_sentencepiece,
        op11_resampling,
        op12_clustering,
        op13_lm_scoring,
    )
}
ORACLES: dict[str, str] = {}
