"""The corpus pipeline: five stages, one after another, over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last
return the columns of ``documents``. ``run`` writes each stage's result as Parquet in the
shared checkpoint folder and rereads it as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, language_id, near_copies, secret_scan, sentencepiece_codec, shared
from larkspur.llm.catalogue import tokenizer_path
from larkspur.runtime import ensure_workers_see_package, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; rows go if every row of their id and text is rejected."""
    ensure_workers_see_package(spark)
    model = language_id.fit(docs, "doc_id", "text", "lang")
    marked = docs.withColumn("_id", F.col("doc_id")).withColumn("_hash", F.xxhash64("text"))
    found = language_id.identify(marked.withColumn("_key", F.struct("_id", "_hash")), "_key", model=model)
    verdicts = found.groupBy("_key").agg(F.bool_or("kept").alias("kept")).where(~F.col("kept"))
    return shared.without(marked, verdicts.select("_key.*"), ["_id", "_hash"]).drop("_id", "_hash")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8 alike), the one with the smallest id."""
    ensure_workers_see_package(spark)
    return near_copies.drop_near_copies(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and lengths brought up to date."""
    ensure_workers_see_package(spark)
    return secret_scan.redact_secrets(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every document."""
    ensure_workers_see_package(spark)
    return sentencepiece_codec.encode_digests(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secrets", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: Trigram likelihoods, 64-bit hashes and merges aren't SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the result of the last one is returned unwritten."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            shared.delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
