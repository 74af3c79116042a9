"""Queries of this package that SQL can express, against DuckDB."""

import duckdb
import pytest

from larkspur.llm.catalogue import ORACLES, QUERIES

ODD = [
    (1, None), (2, ""), (2, "again"), (3, "# $ & a b\n\n \t\na b c d e a b c d e\n"), (4, "word " * 60), (5, "A B C D E F G H I J"), (6, "hey! " * 4 + "you and me! and them too"),
    (7, "x\ny\n" * 9), (8, "1 2 3 4 5 6 7 8 9 10 11 12"), (9, "\u00e9\u00df \u65e5\u672c " * 6), (None, "one two three four five six seven eight nine ten"),
]
ITEMS = [(1, None), (2, "too short"), (7, " ".join(f"w{i}" for i in range(70))), (8, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (8, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
LEAKS = [
    (20, "before it " + " ".join(f"w{i}" if i % 6 else "other" for i in range(70)) + " after"), (21, "Alpha, beta; gamma DELTA epsilon x eta theta iota kappa"), (22, "alpha beta gamma delta x y z v iota kappa"),
    (23, " ".join(f"w{i}" for i in range(30, 70))), (23, "nothing"), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
]


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op8_warc"}))
@pytest.mark.parametrize("made", [False, True])
def test_equals_sql(spark, sf_dir, tmp_path, name, made):
    if made:
        sf_dir = str(tmp_path)
        spark.createDataFrame(ODD + LEAKS, "doc_id long, text string").coalesce(1).write.parquet(f"{sf_dir}/documents.parquet")
        spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1).write.parquet(f"{sf_dir}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet{'/*.parquet' if made else ''}')")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda rows: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())
