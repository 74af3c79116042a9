"""What may be broadcast to wide rows."""

from pyspark.sql import functions as F

from larkspur.operators import models
from larkspur.runtime import attach
from larkspur.schema import conform


def test_long_texts_are_not_broadcast(spark):
    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long text "), 100_000).alias("text"))
    made = models.attach_transcripts(conform(spark.range(60).select(F.col("id").alias("doc_id"))), texts)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    rows = made.groupBy(F.length("transcription").alias("n")).count().collect()
    assert {r.n: r["count"] for r in rows} == {999_999: 40, 0: 20}


def test_either_bound_ends_the_broadcast(spark):
    wide, narrow = spark.range(5), spark.createDataFrame([(1, "x" * 90), (2, None)], "k long, `t.t` string")
    for bounds, seen in (({}, True), ({"limit": 1}, False), ({"most_bytes": 91}, False), ({"most_bytes": 92}, True)):
        made = attach(wide, narrow, F.col("id") == F.col("k"), **bounds)
        assert ("BroadcastHashJoin" in made._jdf.queryExecution().executedPlan().toString()) is seen
        assert made.where("k is not null").count() == 2 and made.count() == 5
    assert attach(wide, narrow.where("false"), F.col("id") == F.col("k")).count() == 5
