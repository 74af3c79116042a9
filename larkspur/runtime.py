"""Session helpers shared by the queries: table access and worker import paths."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATTACH_ROWS = 1_000_000
ATTACH_BYTES = 32 << 20
ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_workers_see_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    A cluster gets the package through ``--py-files`` or its image; this only adds the
    driver's own copy to the workers' path, which helps local sessions started elsewhere.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *[p for p in have if p]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory, read lazily by Spark only."""
    ensure_workers_see_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names, or that the session was given.

    Where none is set, a local session gets a temporary folder; on a cluster that would lie on
    one machine, out of the executors' sight, so it is a RuntimeError there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="larkspur-checkpoint-"))
    return named or sc.getCheckpointDir()


def attach(df: DataFrame, narrow: DataFrame, on: Column, how: str = "left", limit: int = ATTACH_ROWS, most_bytes: int = ATTACH_BYTES) -> DataFrame:
    """``df``, whose rows hold audio, joined with a narrow table: measured first, and broadcast up to ``limit`` rows and ``most_bytes`` of cells.

    So wide rows stay where they are; only beyond a bound do both sides shuffle. A broadcast table
    passes through the driver and lies in every executor, and few rows may hold long texts, which
    estimates from compressed files don't tell.
    """
    narrow = cut_lineage(narrow)
    cells = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("bigint") for c in narrow.columns]
    rows, held = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(cells, F.lit(0).cast("bigint"))), F.lit(0))).first()
    return df.join(F.broadcast(narrow) if rows <= limit and held <= most_bytes else narrow.hint("merge"), on, how)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there from now on."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
