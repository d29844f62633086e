"""From documents to packed training sequences, in stages that each read what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bagminhash, langid, packing, pii, suffixes
from quire.llm.common import table
from quire.sources import scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_TAKEN: dict[tuple[str, int], set[str]] = {}


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that holds a fair share of the text, go."""
    return langid.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return bagminhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages that stand in several places are cut out of the texts."""
    return _counted(suffixes.cut_texts(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by the names of their kinds."""
    return _counted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in its sequence, with its token ids."""
    return packing.pack(docs)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def _stage(number: int, work: Stage) -> Stage:
    """``work``, after the tables that the stage before it needed for itself are deleted: its result is written by now."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.clear(spark, _TAKEN.pop((sf_dir, number - 1), ()))
        with scratch.collected() as taken:
            out = work(spark, docs, sf_dir)
        _TAKEN[sf_dir, number] = taken
        return out

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    (name, _stage(k, work))
    for k, (name, work) in enumerate(
        [("language_id", identify), ("minhash", deduplicate), ("suffix_dedup", cut_repeats), ("pii", redact), ("packing", pack)]
    )
]
# Random fields, signatures and trees are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with scratch.collected() as place:
                docs = scratch.written(docs)
            if before:
                scratch.clear(spark, before)
            before = place
    return docs
