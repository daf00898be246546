"""A training corpus from raw documents in five stages; each stage's table is written as Parquet and read as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelspark.llm.common import materialize


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    from pixelspark.llm.quality import keep_good

    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest doc_id, of each group of near duplicates on five-word shingles."""
    from pixelspark.llm.minhash import keep_first

    return keep_first(docs, k=5, percent=80)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    from pixelspark.llm.decontaminate import decontaminate

    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a document occurs as often as it is taken."""
    from pixelspark.llm.mixing import mix

    return mix(docs)


def _token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files; a row for each document in them."""
    import public_tokenizers

    from pixelspark.llm.tokenfiles import encode_round_trip

    return encode_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [("quality", _quality), ("near_duplicates", _near_duplicates), ("decontaminate", _decontaminate), ("mix", _mix), ("token_files", _token_files)]

#: Trained models and token ids are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
