"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, html_extract, language_id, license_scan, quality_rules, secret_scan, sentencepiece_codec, simhash, token_counts, warc_zip
from larkspur.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("base_labels", F.array_join("base_labels", ",")).withColumn("labels", F.array_join("labels", ","))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language_id.fit(docs, "doc_id", "text", "lang")
    found = language_id.identify(docs, model=model).withColumn("kind", F.lit("document"))
    seen = language_id.identify(pages, "page_id", "html", None, None, "url", model, html_col="html")
    return found.unionByName(seen.withColumnRenamed("page_id", "doc_id").withColumn("kind", F.lit("page")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_ids", F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ","))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_extraction": op3_html_extraction,
    "op4_license_scans": op4_license_scans,
    "op5_simhash": op5_simhash,
    "op6_secret_scans": op6_secret_scans,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
}
ORACLES: dict[str, str] = {"op2_quality_rules": quality_rules.ORACLE, "op8_warc": warc_zip.ORACLE, "op9_decontamination": decontaminate.ORACLE}
