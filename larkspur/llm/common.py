"""Shared plumbing of the corpus operators.

``map_texts`` is the one place where text leaves the JVM: it projects the key and the text
(so extra columns, whatever their names, never travel or clash), cuts each Arrow batch into
slices of bounded bytes and hands whole texts to a kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 2 << 20
BATCH_ROWS = 500
SMALL_BYTES = 8 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches from their default of 10,000 rows, which is too many for whole texts.

    A setting other than the default is the user's and stays.
    """
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """A table of an estimated ``SMALL_BYTES`` or less dealt over all cores; others as they are.

    A small file is often one row group and so one task. Larger tables are read in many, and
    their texts never move for this.
    """
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except ValueError:  # estimates multiply over joins, until Python refuses their digits
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if 0 <= size <= SMALL_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory, read lazily by Spark only."""
    from larkspur.runtime import table as read

    return read(spark, sf_dir, name)


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch by the bytes of one column; a longer single row is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if int(sizes.sum()) <= max_bytes:
        yield batch
        return
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start)


def map_texts(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    kernel: Callable[[], Callable[[list], dict]],
    fields: Sequence[tuple[str, str]],
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Map whole texts to result columns, one output row per input row.

    ``kernel()`` is called once per partition and returns a function from a list of texts
    (``None`` for null) to ``{field: values}``. ``fields`` are (name, DDL type) pairs; the
    result has the key columns followed by them.
    """
    bound_batches(df.sparkSession)
    slim = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{text}`").cast("string").alias("t"))
    out = T.StructType([T.StructField(k, slim.schema[i].dataType, True) for i, k in enumerate(keys)])
    for name, ddl in fields:
        out.add(name, T._parse_datatype_string(ddl), True)
    schema, n = to_arrow_schema(out), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = kernel()
        for whole in batches:
            for batch in slices(whole, n, slice_bytes):
                made = apply(batch.column(n).to_pylist())
                columns = [batch.column(i) for i in range(n)]
                for name, _ in fields:
                    columns.append(pa.array(made[name], type=schema.field(name).type))
                columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return spread(slim).mapInArrow(run, out)
