"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from larkspur.llm import (
    decontaminate, html_extract, language_id, license_scan, quality_rules, secret_scan, sentencepiece_codec, simhash, token_counts, warc_zip,
)
from larkspur.llm.catalogue import tokenizer_path

LONG = "the quick brown fox jumps " * 20_000
ROWS = [(1, None), (2, ""), (3, "   \n"), (4, LONG), (5, "one two three"), (5, "one two three"), (None, "one two three"), (6, "é 日本 \U0001f642 \x00")]
EXTRA = ("k0", "t", "fp", "n", "i", "host", "spans", "ids", "w", "at")
BENCH = [(1, None), (2, ""), (3, "too short"), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]

OPERATORS = {
    "encode": lambda d: sentencepiece_codec.encode_decode(d, tokenizer_path("piece_bpe_32k.model")),
    "digests": lambda d: sentencepiece_codec.encode_digests(d, tokenizer_path("piece_bpe_32k.model")),
    "quality": quality_rules.quality,
    "licenses": license_scan.scan_licenses,
    "simhash": simhash.near_duplicates,
    "secrets": secret_scan.scan_secrets,
    "secret_digests": secret_scan.secret_digests,
    "language": lambda d: language_id.identify(d, declared_col="lang", host_col="source"),
    "decontaminate": lambda d: decontaminate.contaminated(d, d.sparkSession.createDataFrame(BENCH, "item_id long, text string")),
    "counts": lambda d: token_counts.token_counts(d, tokenizer_path("byte_bpe_50k.json")),
    "html": lambda d: html_extract.extract(d, "doc_id", "lang", "text"),
    "warc": lambda d: warc_zip.round_trip(d, "doc_id", "text", None),
    "redact": secret_scan.redact_secrets,
}


def docs(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({"lang": F.when(F.col("doc_id") < 4, F.lit("en")), "source": F.when(F.col("doc_id") > 1, F.lit("s")), "n_chars": F.length("text"), **{c: F.lit("x") for c in EXTRA}})


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_each_in_any_case(spark, name):
    rows = OPERATORS[name](docs(spark)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ROWS)
    same = [r for r in rows if r.doc_id == 5]
    assert same[0] == same[1]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](docs(spark).where("false")).collect() == []


def test_defined_results(spark):
    d = docs(spark)
    by = lambda name: {r.doc_id: r for r in OPERATORS[name](d).collect() if r.doc_id is not None}
    assert [by("counts")[i].n_tokens for i in (1, 2)] == [0, 0] and by("counts")[4].over_limit
    assert by("encode")[1].ids == [] and by("encode")[6].decoded == ROWS[-1][1]
    q = by("quality")
    assert q[1].base_failed and not q[1].kept and q[4].base_failed and q[4].n_words == 100_000
    s = by("simhash")
    assert s[1].fingerprint == "0" * 16 == s[2].fingerprint == s[3].fingerprint and s[2].component_id == 1 and s[5].component_id == 5
    lang = by("language")
    assert lang[1].language is None and not lang[1].kept and lang[1].confidence == 0
    assert by("licenses")[1].first_word is None and by("html")[1].text == "" and by("html")[5].text == "one two three"
    red = {r.doc_id: r for r in secret_scan.redact_secrets(d).collect()}
    assert red[1].text is None and red[4].text == LONG and secret_scan.redact_secrets(d).columns == d.columns


def test_texts_without_labels(spark):
    d = docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert language_id.identify(d).where("kept").count() == 0
