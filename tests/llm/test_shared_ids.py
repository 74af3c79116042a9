"""Rows that share an id, or have none, are judged apart in the pipeline."""

import corpus_pipeline
from larkspur.llm import decontaminate, simhash

TEXT = "the quick words of this text are in one language and are clean"


def test_clean_rows_of_a_contaminated_id_stay(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    leak = "so one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(None, leak), (None, TEXT), (3, leak), (3, TEXT), (4, TEXT)], "doc_id long, text string")
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in left.collect() if r.text == TEXT))) == ["3", "4", "None"] and left.count() == 3


def test_rejected_rows_of_a_kept_id_go(spark, sf_dir):
    rows = [(1, TEXT), (1, "1 2 3"), (None, TEXT), (None, "4 5 6"), (None, None), *((i, TEXT) for i in range(10, 20))]
    df = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.identify_language(spark, df, sf_dir)
    assert left.columns == df.columns and [r.text for r in left.collect()] == [TEXT] * 12


def test_names_may_clash(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "x")], "doc_id long, text string, id string")
    leak = "so one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(3, leak, "u", 1), (4, TEXT, "u", 2)], "doc_id long, text string, _hash string, _id long")
    rows = decontaminate.contaminated(df, bench, item_col="doc_id").orderBy("doc_id").collect()
    assert [(r.doc_id, r.item_ids, r.contaminated) for r in rows] == [(3, [1], True), (4, [], False)]
    assert decontaminate.overlaps(df, bench, item_col="doc_id").columns[:2] == ["doc_id", "item"]
    left = decontaminate.drop_contaminated(df, bench, item_col="doc_id")
    assert left.columns == df.columns and [r._id for r in left.collect()] == [2]
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r._hash for r in kept.collect()} == {"u"}


def test_blocks_change_no_result(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    pick = lambda n: sorted(decontaminate.overlaps(docs, bench, block_words=n).collect())
    assert pick(10**6) == pick(bench.count() * 8) and pick(10**6)
