"""Manifest rows of long documents."""

from larkspur import queries


def test_long_documents_are_in_the_manifest(spark, tmp_path):
    rows = [(1, "a", "en", "s", 128_657), (2, "b", "de", "s", 100_000), (3, "c", "fr", "s", 99_999)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    values = sorted(r.value for r in queries.QUERIES["jsonl_manifest"](spark, str(tmp_path)).collect())
    assert [v.split('"duration_seconds":')[1].split(",")[0] for v in values] == ["1286.57", "1000.0", "999.99"]
