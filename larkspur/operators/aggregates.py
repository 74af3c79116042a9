"""Reports and batches: quality report, inspection, relational intervals, padding, manifest checks."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import signal as S
from larkspur.runtime import cut_lineage


def qc_report(clips: DataFrame, flags: tuple[Column, Column] | None = None) -> DataFrame:
    """One row: clips, clipped, silence_only, duration_min/max/mean.

    ``flags`` replaces the columns ``clipped`` and ``silent``. No clips: counts 0, durations null.
    The report's list of noise ratios grows with the corpus; ``manifests.write_report`` streams it
    into the report file, so that no task holds it.
    """
    clipped, silent = flags or (F.col("clipped"), F.col("silent"))
    return clips.agg(
        F.count(F.lit(1)).alias("clips"), F.count_if(clipped).alias("clipped"), F.count_if(silent).alias("silence_only"),
        F.min("duration_seconds").alias("duration_min"), F.max("duration_seconds").alias("duration_max"),
        F.avg("duration_seconds").alias("duration_mean"),
    )


def inspect_stats(clips: DataFrame, limit: int | None = None) -> DataFrame:
    """One row: files, total seconds and hours, mean, exact median, least and largest duration."""
    known = clips.where("duration_seconds is not null")
    known = known.orderBy("source_path").limit(limit) if limit else known
    d = F.col("duration_seconds")
    return known.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(d), F.lit(0.0)).alias("total_seconds"),
        (F.coalesce(F.sum(d), F.lit(0.0)) / 3600).alias("total_hours"), F.avg(d).alias("mean_seconds"),
        F.lit(quantile(known, "duration_seconds", 0.5)).cast("double").alias("median_seconds"), F.min(d).alias("min_seconds"), F.max(d).alias("max_seconds"),
    )


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The exact, linearly interpolated quantile of a column, null values aside; None without values.

    Equal values are counted first and the counts range-partitioned by value; the driver sees
    one sum a partition, and only the partition that holds the place is looked into. (The
    built-in percentile gathers all distinct values in one task.)
    """
    by = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    by = cut_lineage(by.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    sums = sorted((r.part, r.n) for r in by.groupBy("part").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in sums)
    if not total:
        return None
    place = q * (total - 1)

    def at(rank: int) -> float:
        before = 0
        for part, n in sums:
            if rank < before + n:
                break
            before += n
        upto = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
        return by.where(F.col("part") == part).withColumn("upto", upto).where(F.col("upto") > rank - before).agg(F.min("v").alias("v")).first().v

    low = at(math.floor(place))
    high = low if place == math.floor(place) else at(math.ceil(place))
    return low + (place - math.floor(place)) * (high - low)


def count_formats(clips: DataFrame) -> DataFrame:
    """(format, n) by lower-case extension, sorted."""
    ext = F.lower(F.regexp_extract("source_path", r"\.([^./]+)$", 1))
    return clips.groupBy(ext.alias("format")).agg(F.count(F.lit(1)).alias("n")).orderBy("format")


def interval_union(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): overlapping or touching intervals of each key joined (gaps and islands)."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where("end > start").withColumn("_new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def interval_gaps(union: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): what lies between the joined intervals of each key."""
    by = Window.partitionBy(*keys).orderBy("start")
    return union.select(*keys, F.lag("end").over(by).alias("_from"), F.col("start").alias("end")).where("_from < end").select(*keys, F.col("_from").alias("start"), "end")


def samples_in_intervals(frames: DataFrame, spans: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Frames (keys, at) that lie in an interval [start, end) of their key: a range join by bins.

    Intervals are cut into bins of ``width``, so the join is by equality on (keys, bin).
    """
    bins = spans.where("end > start").select(*keys, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_bin"))
    dealt = frames.withColumn("_bin", F.floor(F.col("at") / width))
    return dealt.join(bins, [*keys, "_bin"]).where("at >= start and at < end").select(*[frames[c] for c in frames.columns]).distinct()


def numbered(df: DataFrame, order: list[str], name: str = "_row") -> DataFrame:
    """Rows numbered from 0 in a global order, without one task sorting all rows.

    Rows are range-partitioned and sorted; each partition's offset comes from the counts of
    the earlier ones (one number a partition reaches the driver).
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets = list(zip([part for part, _ in counts], accumulate([0, *(n for _, n in counts)])))
    first = df.sparkSession.createDataFrame(offsets, "_of int, _first bigint")  # a row a partition
    placed = ranged.join(F.broadcast(first), F.col("_part") == F.col("_of"))
    return placed.withColumn(name, F.col("_at") + F.col("_first")).drop("_part", "_at", "_of", "_first")


def collate(clips: DataFrame, size: int, order: list[str]) -> DataFrame:
    """(batch, lengths, audios, texts, paths): batches of ``size`` clips in order, zero-padded to the longest."""
    rows = numbered(clips, order).withColumn("batch", F.floor(F.col("_row") / size))
    item = F.struct("_row", "audio", "transcription", "source_path")
    by = rows.groupBy("batch").agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["_row"] < b["_row"], -1).otherwise(1)).alias("x"))
    longest = F.array_max(F.transform("x", lambda c: F.size(c["audio"])))
    by = by.withColumn("_long", longest)
    pad = F.transform("x", lambda c: F.concat(c["audio"], F.array_repeat(F.lit(0.0).cast("float"), F.col("_long") - F.size(c["audio"]))))
    return by.select(
        "batch", F.transform("x", lambda c: F.size(c["audio"]).cast("bigint")).alias("lengths"), pad.alias("audios"),
        F.transform("x", lambda c: c["transcription"]).alias("texts"), F.transform("x", lambda c: c["source_path"]).alias("paths"),
    )


def check_manifest(manifest: DataFrame, files: DataFrame | None = None, least: int = 10) -> None:
    """ValueError if a manifest has too few records or names paths that ``files`` (path) lacks."""
    if manifest.limit(least).count() < least:
        raise ValueError(f"a training manifest needs at least {least} records")
    if files is not None:
        lost = missing_files(manifest, files).limit(3).collect()
        if lost:
            raise ValueError(f"the manifest names files that aren't there: {[r.path for r in lost]}")


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path) of manifest records whose file isn't among ``files`` (path); a null path never is."""
    return manifest.select("path").join(files.select("path"), "path", "left_anti")


def newest(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The path modified last (of equal times the last path) of a binaryFile listing, for each of the keys if given."""
    return files.groupBy(*(keys or [])).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def best_epoch(metrics: DataFrame) -> DataFrame:
    """(epoch, loss): mean loss of each epoch, and whether it is the first least one."""
    by = metrics.groupBy("epoch").agg(F.avg("loss").alias("loss"))
    best = by.agg(F.min(F.struct("loss", "epoch")).alias("m")).select(F.col("m.epoch").alias("_best"))
    return by.join(best, F.col("epoch") == F.col("_best"), "left").select("epoch", "loss", F.col("_best").isNotNull().alias("best"))


def quality_flags(audio: Column) -> tuple[Column, Column]:
    return S.is_clipped(audio), S.is_silent(audio)


def join_segments(segments: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """(keys, text): the texts of each key in order, joined by a space and trimmed."""
    parts = F.array_sort(F.collect_list(F.struct(*order, text)))
    return segments.groupBy(*keys).agg(F.trim(F.array_join(F.transform(parts, lambda p: p[text]), " ")).alias("text"))
