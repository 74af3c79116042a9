"""Manifests as tables, and tables as manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import kernels as K
from larkspur.operators.aggregates import numbered
from larkspur.operators.stage import active
from larkspur.providers import get_provider
from larkspur.runtime import attach, cut_lineage, ensure_workers_see_package

FORMATS = ("ljspeech", "f5tts")


# Reading


def parse_filelist(lines: DataFrame, line: str = "value", least: float = 0.0, most: float | None = None) -> DataFrame:
    """(path, duration_seconds, text): blank lines left out, unreadable durations 0, bounds for known ones."""
    parts = F.split(F.col(line), "\t")
    rows = lines.where(F.trim(F.col(line)) != "").select(
        F.get(parts, F.lit(0)).alias("path"),
        F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(0.0)).alias("duration_seconds"),
        F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("text"),
    )
    d = F.col("duration_seconds")
    return rows.where((d == 0) | ((d >= least) & ((d <= most) if most is not None else F.lit(True))))


def parse_strict(lines: DataFrame, line: str = "value") -> DataFrame:
    """(path, duration, text) of lines with three fields; further tabs belong to the text."""
    parts = F.split(F.col(line), "\t", 3)
    return lines.where(F.size(parts) == 3).select(parts[0].alias("path"), parts[1].alias("duration"), parts[2].alias("text"))


def parse_for_augmentation(lines: DataFrame, limit: int | None = None, at: str = "at", line: str = "value") -> DataFrame:
    """(at, text, wav): of the first ``limit`` lines (by ``at`` from 0), those with three fields and a text."""
    first = lines.where(F.col(at) < limit) if limit is not None else lines
    parts = F.split(F.col(line), "\t", -1)
    return first.where((F.size(parts) == 3) & (F.trim(parts[2]) != "")).select(
        F.col(at).alias("at"), F.trim(parts[2]).alias("text"), F.format_string("kokoro_%06d.wav", F.col(at)).alias("wav")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): the lines of text files, numbered from 0 in file order; files are read in splits."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")]
    lines = spark.read.text(path).select("value", *place)
    return numbered(lines, ["_file", "_block", "_line"], "at").select("at", "value")


# Writing


def one_line(text: Column) -> Column:
    """Text that fits in one manifest field: delimiters and runs of white space become one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s|]+", " "))


def output_name(clips: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``wav``: the source's stem, with the clip's id for children and for stems that occur twice or are ``taken`` (wav)."""
    stem = F.regexp_extract("source_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    named = clips.withColumn("_stem", stem)
    twice = named.where("parent_doc_id is null").groupBy("_stem").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_stem").alias("_twice"))
    if taken is not None:
        twice = twice.union(taken.select(F.regexp_replace("wav", r"\.wav$", ""))).distinct()
    out = attach(named, twice, F.col("_stem") == F.col("_twice"))
    full = F.concat("_stem", F.lit("_"), "doc_id", F.lit(".wav"))
    return out.withColumn("wav", F.when(F.col("parent_doc_id").isNotNull() | F.col("_twice").isNotNull(), full).otherwise(F.concat("_stem", F.lit(".wav")))).drop("_stem", "_twice")


def ljspeech_rows(clips: DataFrame, speaker: str = "speaker_00") -> DataFrame:
    """(value): wav|speaker|text of clips with ``wav``."""
    return clips.select(F.concat_ws("|", "wav", one_line(F.coalesce("speaker_id", F.lit(speaker))), one_line(F.col("transcription"))).alias("value"))


def f5_rows(clips: DataFrame, folder: str = "") -> DataFrame:
    """(value): path, duration with four decimals and text, by tabs."""
    path = F.concat(F.lit(folder), F.col("wav"))
    return clips.select(F.concat_ws("\t", path, F.format_string("%.4f", F.col("duration_seconds")), one_line(F.col("transcription"))).alias("value"))


def jsonl_rows(clips: DataFrame, version: str, processed_at: Column | None = None) -> DataFrame:
    """(value): a JSON object for each clip, features under ``metadata``, absent ones left out."""
    from larkspur.schema import FEATURES

    kept = [c for c in ("parent_doc_id", *FEATURES) if c in clips.columns and c not in ("fingerprint", "clipped", "silent", "extra")]
    stamp = processed_at if processed_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    body = F.struct(
        "doc_id", "source_path", "sample_rate", F.round("duration_seconds", 4).alias("duration_seconds"),
        F.struct(*kept).alias("metadata"), F.lit(version).alias("pipeline_version"), stamp.alias("processed_at"),
    )
    return clips.select(F.to_json(body).alias("value"))


def training_rows(manifest: DataFrame) -> DataFrame:
    """(name, text) for a two-column training list, to be written with ``|``."""
    return manifest.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "text")


def write_training(manifest: DataFrame, path: str) -> None:
    """The two-column training list of a manifest as one file, sorted by path."""
    rows = training_rows(manifest.orderBy("path"))
    single_file(rows.select(F.concat_ws("|", "name", one_line(F.col("text"))).alias("value")), path)


def stage_jsonl(clips: DataFrame, path: str, version: str, run_id: str) -> None:
    """Write a run's JSON lines beside those of earlier runs, out of readers' sight until ``publish_jsonl``."""
    jsonl_rows(clips, version).write.mode("overwrite").text(f"{path}/_runs/{run_id}")


def publish_jsonl(spark: SparkSession, path: str, committed: DataFrame) -> None:
    """Show the staged lines of committed runs (run_id) and delete those of runs that never were committed.

    A file's name holds its run and part, so doing this again after a crash changes nothing.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_runs")
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return
    staged = [s.getPath() for s in fs.listStatus(at)]
    known = {r.run_id for r in committed.where(F.col("run_id").isin([p.getName() for p in staged])).select("run_id").distinct().collect()}
    for run in staged:
        if run.getName() in known:
            for part in (s.getPath() for s in fs.listStatus(run)):
                if part.getName().startswith("part-"):
                    fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{path}/part-{run.getName()}-{part.getName()[5:10]}.txt"))
        fs.delete(run, True)


def single_file(rows: DataFrame, path: str) -> None:
    """Write (value) rows as one text file, in the rows' order; an empty result still makes the file.

    Tasks write sorted parts; as trainers want one file, the parts' bytes are then streamed
    one after another into it. No task sorts or holds all rows.
    """
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    part = f"{path}.{uuid.uuid4().hex}"
    rows.write.text(part)
    at, to, whole = (jvm.org.apache.hadoop.fs.Path(p) for p in (part, path, f"{part}/_whole"))
    fs = at.getFileSystem(conf)
    files = sorted((s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    out = fs.create(whole)
    for file in files:
        held = fs.open(file)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 1 << 20, False)
        held.close()
    out.close()
    fs.delete(to, False)
    fs.rename(whole, to)
    fs.delete(at, True)


def write_wavs(clips: DataFrame, folder: str) -> DataFrame:
    """Write each clip's audio as a WAV file in a shared folder; (doc_id, wav, n_bytes) of those written.

    A file is written under a temporary name and renamed, so a retried task overwrites whole files only.
    """
    ensure_workers_see_package(clips.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        uri = "file:///" + folder[5:].lstrip("/") if folder.startswith("file:") else folder
        fs, root = pafs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pafs.LocalFileSystem(), uri)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            done: list[tuple] = []
            for doc, wav, rate, audio in zip(*(batch.column(i) for i in range(4))):
                data = K.encode_wav(audio.values.to_numpy(zero_copy_only=False), rate.as_py())
                held = f"{root.rstrip('/')}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(held) as f:
                    f.write(data)
                fs.move(held, f"{root.rstrip('/')}/{wav.as_py()}")
                done.append((doc.as_py(), wav.as_py(), len(data)))
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "wav", "n_bytes"), map(list, zip(*done)))))

    return clips.where(F.col("audio").isNotNull()).select("doc_id", "wav", "sample_rate", "audio").mapInArrow(run, "doc_id string, wav string, n_bytes bigint")


def wav_bytes(clips: DataFrame) -> DataFrame:
    """(path, content): clips with audio as WAV files in memory, named by ``wav``; what ``audio.decode`` reads."""
    ensure_workers_see_package(clips.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for wav, rate, audio in zip(*(batch.column(i) for i in range(3))):
                data = K.encode_wav(audio.values.to_numpy(zero_copy_only=False), rate.as_py())
                yield pa.RecordBatch.from_pydict({"path": [wav.as_py()], "content": [data]})

    return clips.where(F.col("audio").isNotNull()).select("wav", "sample_rate", "audio").mapInArrow(run, "path string, content binary")


RUN_COLUMNS = ("doc_id", "source_path", "segment_start_sample", "segment_start", "wav", "speaker_id", "transcription", "duration_seconds")


def exported(spark: SparkSession, folder: str, committed: DataFrame | None = None) -> DataFrame:
    """Manifest rows of the runs that were exported to a folder: each clip's newest, of committed runs (run_id) or of all."""
    ddl = "doc_id string, source_path string, segment_start_sample int, segment_start double, wav string, speaker_id string, transcription string, duration_seconds double, at timestamp, run_id string"
    try:
        rows = spark.read.schema(ddl).parquet(f"{folder}/_runs")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], ddl)
    if committed is not None:
        rows = rows.join(committed.select("run_id").distinct(), "run_id", "left_semi")
    by = rows.groupBy("doc_id").agg(F.max_by(F.struct(*rows.columns), F.struct("at", "run_id")).alias("r"))
    return by.select("r.*")


def export_run(clips: DataFrame, folder: str, run_id: str, taken: DataFrame | None = None) -> dict:
    """WAV files of kept clips, and their manifest rows as the part of one run; {kept, total_duration_seconds}.

    Nothing of earlier runs is touched: names that are ``taken`` (wav) get the clip's id. The
    rows count once the run is committed, see :func:`compose`.
    """
    kept = output_name(clips.where(active()), taken)
    write_wavs(kept, folder).agg(F.count(F.lit(1))).collect()
    rows = kept.select(*RUN_COLUMNS).withColumns({"at": F.current_timestamp(), "run_id": F.lit(run_id)})
    rows.write.mode("overwrite").parquet(f"{folder}/_runs/part={run_id}")
    mine = clips.sparkSession.read.parquet(f"{folder}/_runs/part={run_id}")
    total = mine.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("s")).first()
    return {"kept": total.n, "total_duration_seconds": round(total.s, 4)}


def check_formats(formats: tuple[str, ...]) -> None:
    if unknown := set(formats) - set(FORMATS):
        raise ValueError(f"unknown export formats: {sorted(unknown)}")


def export_tts(clips: DataFrame, folder: str, formats: tuple[str, ...] = FORMATS, speaker: str = "speaker_00") -> dict:
    """WAV files and manifests of kept clips; {kept, total_duration_seconds, output_files}.

    ``clips`` should be persisted: it is read for the files and again, without audio, for the
    manifests. Unknown formats are a ValueError. A folder's manifests hold all that was ever
    exported to it; a clip that comes again replaces its line.
    """
    check_formats(formats)
    spark = clips.sparkSession
    taken = exported(spark, folder).join(clips.select("doc_id").distinct(), "doc_id", "left_anti")
    made = export_run(clips, folder, uuid.uuid4().hex, taken)
    return made | {"output_files": compose(exported(spark, folder), folder, formats, speaker)}


def compose(rows: DataFrame, folder: str, formats: tuple[str, ...] = FORMATS, speaker: str = "speaker_00") -> list[str]:
    """The folder's manifests from rows of :func:`exported`, sorted by source and place; their paths."""
    check_formats(formats)
    lines = cut_lineage(rows).orderBy("source_path", "segment_start_sample", "segment_start", "doc_id")
    files = []
    if "ljspeech" in formats:
        single_file(ljspeech_rows(lines, speaker), f"{folder}/metadata.csv")
        files.append(f"{folder}/metadata.csv")
    if "f5tts" in formats:
        single_file(f5_rows(lines, f"{folder}/"), f"{folder}/filelist.txt")
        files.append(f"{folder}/filelist.txt")
    return files


def synthesize(rows: DataFrame, folder: str, voice: str = "default", provider: str = "tone") -> DataFrame:
    """Synthetic clips of (at, text, wav) rows, written as WAV files; (doc_id, wav, n_bytes)."""

    def run(batches):
        import pyarrow as pa

        model = get_provider("synthesizer", provider)
        for batch in batches:
            for at, text, wav in zip(*(c.to_pylist() for c in batch.columns)):
                made = model.run(text, voice)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([str(at)]), pa.array([wav]), pa.array([made.sample_rate], pa.int32()), pa.array([made.audio], pa.list_(pa.float32()))],
                    names=["doc_id", "wav", "sample_rate", "audio"],
                )

    ensure_workers_see_package(rows.sparkSession)
    made = rows.select("at", "text", "wav").mapInArrow(run, "doc_id string, wav string, sample_rate int, audio array<float>")
    return cut_lineage(write_wavs(made, folder))


def write_report(report: DataFrame, clips: DataFrame, path: str) -> None:
    """A quality report row and the clips' noise ratios (doc_id, snr_db), by doc_id, as one JSON file.

    The list has a line for each clip and goes through ``single_file`` like a manifest.
    """
    r = report.first().asDict()
    head = {"clips": r["clips"], "clipped": r["clipped"], "silence_only": r["silence_only"], "duration_seconds": {k: r[f"duration_{k}"] for k in ("min", "max", "mean")}}
    ratios = numbered(clips.where("snr_db is not null").select("doc_id", "snr_db"), ["doc_id", "snr_db"])
    comma = F.when(F.col("_row") > 0, F.lit(",")).otherwise(F.lit(""))
    lines = ratios.select(F.lit(1).alias("_part"), "_row", F.concat(comma, F.col("snr_db").cast("string")).alias("value"))
    ends = [(0, 0, json.dumps(head)[:-1] + ', "snr_db": ['), (2, 0, "]}")]
    lines = lines.unionByName(report.sparkSession.createDataFrame(ends, "_part int, _row bigint, value string"))
    single_file(lines.orderBy("_part", "_row").select("value"), path)
