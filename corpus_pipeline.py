"""The corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, tokenization."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tradelake.llm import decontaminate, line_dedup, near_copies, piece_codec, quality, simhash
from tradelake.llm.common import discard, result_only, small_batches, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects (low quality or toxic) go. Null and empty texts are judged like others,
    rows that share an id each by itself; an empty table gives an empty one, without labels all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters in at least 5 documents stay only in the document with the largest id. Every row stays; a
    null text stays null, and a null id counts as the smallest."""
    return line_dedup.drop_shared_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity 0.8 of five-word shingles) the document with the smallest id stays: SimHash
    and its grid find near links, and a prefix filter those beyond its reach. Null and empty texts are copies of one
    another; rows that share an id stay or go together; rows with a null id stay."""
    return simhash.keep_one(docs, near_copies.near_copies)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row judged by its own text; null and empty texts stay."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids (null for a null text), how many these are, and whether they decode to the text."""
    return piece_codec.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), verify=True)


#: Of the Python workers of all stages, which serve one after another: what they free goes back to the system at once, and is not
#: kept by an allocator for the stage that comes next.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "262144"}


def _sparing(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with WORKERS and with small batches for them, whoever runs it: also for rows that it leaves to be computed when
    its result is written. Both stay set for the session."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.sparkContext.environment.update(WORKERS)
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    (name, _sparing(stage))
    for name, stage in (
        ("quality", quality_stage),
        ("line_dedup", line_stage),
        ("near_dedup", near_dedup_stage),
        ("decontamination", decontamination_stage),
        ("pieces", piece_stage),
    )
]

#: The first and the last stage cannot be said in SQL; tests hold what the other stages make of the first one's result
#: against a plain version, and the first one's sums against plain ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared scratch folder and read again. What a stage wrote on
    its way goes once its result is there, and a stage's result once the next one's is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = result_only(lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")  # noqa: B023
        discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
