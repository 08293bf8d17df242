"""A corpus pipeline of five stages over ``documents``: each takes all that the one before it kept.

Every stage reads doc_id and text (mixing also source) and carries the other columns along in one struct, so that columns
named like something a stage makes come through unchanged; only the last stage adds columns (size, text_crc32, shard, slot),
which replace own ones of those names. Defined results: null and empty texts aren't toxic unless the model says so, have no
near copies and aren't contaminated, and have size 0 in the mix; null doc_ids and repeated rows are rows like others, but of
equal texts one row stays after the second stage; ties go to the smallest doc_id, then to a digest; an empty table passes
through all stages and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from waybill.llm.common import crc_mod, read, table

TOXIC = 0.7


def carried(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], *read_columns: str) -> DataFrame:
    """What ``stage`` makes of ``docs``, with the columns of ``docs``: of them it sees ``read_columns`` and a struct of the rest."""
    rest = [c for c in docs.columns if c not in read_columns]
    if not rest:
        return stage(docs).select(*docs.columns)
    name = "_rest"
    while name in docs.columns:
        name += "_"
    made = stage(docs.select(*read_columns, F.struct(*[F.col(f"`{c}`") for c in rest]).alias(name)))
    return made.select(*[F.col(name).getField(c).alias(c) if c in rest else F.col(c) for c in docs.columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score less than TOXIC."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    return carried(docs, lambda d: toxicity.with_score(d, model, "_toxic").where(F.col("_toxic") < TOXIC), "doc_id", "text")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of shingle sets (five words) that are at least 0.8 alike."""
    return carried(docs, lambda d: ngram_join.one_of_each(d, width=5, percent=80), "doc_id", "text")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate."""
    benchmark = read(spark, sf_dir, "benchmark")
    return carried(docs, lambda d: decontaminate.decontaminate(d, benchmark).where(~F.col("contaminated")), "doc_id", "text")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0 to 3 times, as rows."""

    def taken(d: DataFrame) -> DataFrame:
        rows = mixing.mix(d, F.regexp_count("text", F.lit(mixing.WORD))).where("copies > 0")
        return rows.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))

    return carried(docs, taken, "doc_id", "text", "source")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot, shards of near equal bytes, equal texts together."""
    return sharding.assign(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The first stage's scores aren't SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what one returns is written as Parquet and read again for the next."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
