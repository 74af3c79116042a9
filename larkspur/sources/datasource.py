"""Clips as a Spark data source: ``spark.read.format("clips").option("rate", 16000).load(glob)``.

For places that every worker can open. ``clips()`` in ``sources.audio`` reads any store that
Spark reads and is the way to prefer; this source suits SQL and external catalogues.
"""

from __future__ import annotations

import glob
import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from larkspur.functions import kernels as K

FIELDS = "doc_id string, source_path string, audio array<float>, sample_rate int, duration_seconds double, error string"


class Clips(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clips"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> DataSourceReader:
        return ClipsReader(self.options)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ClipsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pattern, self.rate, self.size = options["path"], int(options.get("rate", 16_000)), int(options.get("files_per_partition", 64))

    def partitions(self) -> list[InputPartition]:
        paths = sorted(glob.glob(self.pattern))
        return [Files(paths[i : i + self.size]) for i in range(0, len(paths), self.size)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            name = hashlib.sha256(path.encode()).hexdigest()[:16]
            try:
                with open(path, "rb") as f:
                    audio, got = K.decode_wav(f.read())
                audio = K.resample(audio, got, self.rate)
                yield name, path, audio.tolist(), self.rate, len(audio) / self.rate, None
            except Exception as e:  # one bad file must not stop the scan
                yield name, path, None, 0, None, f"{type(e).__name__}: {e}"[:500]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Clips)
