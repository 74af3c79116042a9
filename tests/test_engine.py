"""Stages, sources, sinks, checkpoints, de-duplication and streaming on synthesised audio."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur import providers, sql
from larkspur.functions import kernels as K
from larkspur.operators import aggregates as A
from larkspur.operators import dedup, fanout, filters, models
from larkspur.operators.analyze import Analysis, analyze
from larkspur.operators.stage import active, drop_failed_families, errors_by_stage, filter_stage, run_stages, run_stats
from larkspur.plans import machine
from larkspur.plans.checkpoint import Checkpoint, committed_outputs
from larkspur.plans.curate import column_stages, curate, curate_tts, inspect, run, tts_stages
from larkspur.schema import CLIP, conform
from larkspur.sources import audio as sources
from larkspur.sources import manifests
from larkspur.streaming import files as streaming

RATE = 16_000


def speech(seconds, seed=0, level=0.5):
    r = np.random.default_rng(seed)
    n = int(seconds * RATE)
    x = r.normal(0, 0.001, n)
    x[int(0.30 * n) : int(0.62 * n)] += level * np.sin(2 * np.pi * (150 + 900 * seed) * np.arange(int(0.62 * n) - int(0.30 * n)) / RATE)
    return x.astype(np.float32)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("audio in")
    (top / "deep").mkdir()
    made = {"a.wav": speech(6, 1), "b.wav": speech(6, 2), "short.wav": speech(1.2, 3), "silence.wav": np.zeros(3 * RATE, np.float32), "tiny.wav": speech(0.2, 4), "deep/a.wav": speech(5, 5), "again.WAV": speech(6, 1)}
    for name, x in made.items():
        (top / name).write_bytes(K.encode_wav(x, RATE))
    (top / "bad.wav").write_bytes(b"not audio at all")
    (top / "note.txt").write_text("x")
    return str(top)


def frame(spark, arrays, rate=RATE):
    rows = [(f"d{i}", f"/in/d{i}.wav", [float(x) for x in a], rate, len(a) / rate) for i, a in enumerate(arrays)]
    return conform(spark.createDataFrame(rows, "doc_id string, source_path string, audio array<float>, sample_rate int, duration_seconds double"))


def test_scan_finds_decodes_and_isolates(spark, folder):
    found = sources.clips(spark, sources.patterns_of(folder, ["wav"]))
    rows = {os.path.basename(r.source_path): r for r in found.drop("audio").collect()}
    assert set(rows) == {"a.wav", "b.wav", "short.wav", "silence.wav", "tiny.wav", "again.WAV", "bad.wav"}
    assert rows["bad.wav"].reject_stage == "reader" and rows["tiny.wav"].reject_reason == "too_short"
    assert rows["a.wav"].n_samples == 6 * RATE and rows["a.wav"].source_path == f"{folder}/a.wav"
    assert sources.list_audio(spark, folder, ["WAV"]).count() == 8
    assert sources.audio_files(spark, [f"{folder}/*.wav", f"{folder}/a*.wav", "/nowhere/*.wav"]).count() == 6
    cut = sources.clips(spark, f"{folder}/a.wav", rate=8000, most_seconds=2.0).first()
    assert len(cut.audio) == 16_000 and cut.duration_seconds == 2.0
    assert sources.parse_extensions("WAV, .flac,") == ["wav", "flac"]


def test_contents_are_not_read_for_a_listing(spark, folder):
    plan = sources.list_audio(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_kernel_equals_column_stages(spark):
    r = np.random.default_rng(3)
    arrays = []
    for i in range(25):
        x = r.normal(0, 0.03, 40 + 3 * i)
        x[10 + i % 7 : 18 + i % 11] += r.normal(0, 0.5, 8 + i % 11 - i % 7)
        arrays.append(x)
    df = frame(spark, arrays, 8).repartition(3)
    chain = run_stages(df, column_stages(0.1, 125, 1.0, 4.0, 2.0, 7.0, 8))
    fused = analyze(df, Analysis(0.1, 125, 1.0, 4.0, 2.0, 7.0, frame=8))
    pick = ["doc_id", "n_samples", "duration_seconds", "vad_speech_ratio", "vad_speech_timestamps", "snr_db", "reject_stage", "reject_reason", "trimmed_duration_seconds"]
    assert sorted(chain.select(pick).collect()) == sorted(fused.select(pick).collect())


def test_nulls_empty_tables_and_clashing_columns(spark):
    df = frame(spark, [[]]).withColumn("audio", F.lit(None).cast("array<float>")).withColumn("item", F.lit("mine"))
    assert analyze(df, Analysis()).first().error_stage == "analyze"
    assert run_stages(df.drop("item"), column_stages(0.1, 150, 1, 4, 2, 7, 512)).first().reject_stage == "vad"
    none = df.where("false")
    for out in (analyze(none, Analysis()), fanout.segment_speech()(none.drop("item")), dedup.deduplicate(none)):
        assert out.count() == 0
    assert run_stats(none).first().asDict() == {"processed": 0, "kept": 0, "skipped": 0, "errors": 0}
    assert A.qc_report(none).first().clips == 0


def test_accounting(spark):
    rows = [
        ("a", "a", None, None, None), ("b1", "b", "snr", "low", None), ("b2", "b", None, None, None), ("c", "c", "segment", "no_items", None),
        ("d", "d", "reader", "bad", None), ("e1", "e", None, None, "analyze"), ("e2", "e", None, None, None),
    ]
    df = conform(spark.createDataFrame(rows, "doc_id string, root_doc_id string, reject_stage string, reject_reason string, error_stage string"))
    assert run_stats(df).first().asDict() == {"processed": 4, "kept": 2, "skipped": 5, "errors": 1}
    assert [tuple(r) for r in errors_by_stage(df).collect()] == [("analyze", 1)]
    assert {r.doc_id for r in drop_failed_families(df).collect()} == {"a", "b2"}


def test_fan_out(spark):
    df = frame(spark, [speech(3, 1), np.zeros(RATE)])
    out = fanout.segment_speech(merged=True)(df).collect()
    made = [r for r in out if r.reject_stage is None]
    spans = K.merge(K.energy_vad(speech(3, 1)), 3 * RATE)
    assert [(r.segment_start_sample, r.segment_end_sample) for r in made] == spans
    assert all(r.parent_doc_id == "d0" and r.root_doc_id == "d0" and len(r.audio) == r.n_samples for r in made)
    assert [r.reject_reason for r in out if r.reject_stage] == ["no_items"]
    turns = spark.createDataFrame([("d0", "S1", 0.0, 1.0), ("d0", "S2", 1.0, 99.0)], "doc_id string, speaker_id string, start double, end double")
    kids = {r.doc_id: r for r in fanout.speaker_turns(turns)(df).where(active()).collect()}
    assert set(kids) == {"d0__S1__0_1000", "d0__S2__1000_99000"} and kids["d0__S2__1000_99000"].n_samples == 2 * RATE
    assert fanout.speaker_turns(turns, max_speakers=1)(df).where(active()).count() == 0


def test_greedy_dedup_equals_the_sequential_rule(spark):
    r = np.random.default_rng(5)
    base = [int(x) for x in r.integers(-(2**62), 2**62, 40)]
    fps = []
    for i in range(300):
        x = base[i % 40]
        for b in r.integers(0, 63, r.integers(0, 9)):
            x ^= 1 << int(b)
        fps.append((f"c{i:03d}", x))
    df = spark.createDataFrame([*fps, ("none", None)], "doc_id string, fingerprint long").repartition(5)
    got = {x.doc_id: x.duplicate_of for x in dedup.greedy_duplicates(df, 8, ("doc_id",), agree=2).collect()}
    kept, want = [], {"none": None}
    for d, f in fps:
        want[d] = next((k for k, g in kept if ((f ^ g) & (2**64 - 1)).bit_count() <= 8), None)
        if want[d] is None:
            kept.append((d, f))
    assert got == want


def test_blocking_follows_the_number_of_words():
    assert [dedup.best_agreement(n, 8) for n in (100, 100_000, 10**9)] == [1, 3, 5] and dedup.best_agreement(2000, 20) == 1


def test_quantile_is_exact_over_partitions(spark):
    r = np.random.default_rng(9)
    x = np.round(r.gamma(2, 3, 5001), 2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(7)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert abs(A.quantile(df, "v", q) - np.quantile(x, q)) < 1e-9
    assert A.quantile(df.where("v is null"), "v", 0.5) is None and A.quantile(df.where("v < 0"), "v", 0.5) is None


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = manifests.read_lines(spark, str(tmp_path / "long.txt"))
        assert spark.read.text(str(tmp_path / "long.txt")).rdd.getNumPartitions() > 5
        assert sorted(map(tuple, rows.collect())) == [(i, f"line {i}") for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    manifests.single_file(rows.orderBy("at").select("value"), str(tmp_path / "back.txt"))
    assert (tmp_path / "back.txt").read_text() == (tmp_path / "long.txt").read_text()


def test_block_masks_are_complete():
    r = np.random.default_rng(2)
    masks = [m & (2**64 - 1) for m in dedup.block_masks(8, 3)]
    for _ in range(300):
        flip = sum(1 << int(b) for b in r.choice(64, 8, replace=False))
        assert any(flip & m == 0 for m in masks)


def test_curate_for_speech_with_resume(spark, folder, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    texts = {"x": "y"}
    providers.register("transcriber", "fixed", lambda: providers.TableTranscriber(texts))
    made = curate_tts(spark, [f"{folder}/*.wav", f"{folder}/*.WAV"], out, checkpoint=mark, snr_min=5.0, least_seconds=1.5, dedup_threshold=8)
    assert made["kept"] == 2 and made["filtered"] == 5
    lines = open(made["output_files"][0]).read().splitlines()
    assert [x.split("|")[0] for x in lines] == ["a.wav", "b.wav"] and all(os.path.exists(f"{out}/{x.split('|')[0]}") for x in lines)
    report = json.load(open(made["qc_report"]))
    assert report["clips"] == 2 and len(report["snr_db"]) == 2
    again = curate_tts(spark, [f"{folder}/*.wav", f"{folder}/*.WAV"], str(tmp_path / "again"), checkpoint=mark, snr_min=5.0)
    assert again["kept"] == 0 and os.path.getsize(again["output_files"][0]) == 0
    with pytest.raises(ValueError):
        manifests.export_tts(frame(spark, []), out, ("mp3",))


def names(path):
    return [x.split("|")[0] for x in open(path).read().splitlines()]


def test_later_runs_add_to_the_manifests(spark, tmp_path):
    """Two runs into one folder, a crash before the commit, and the same stem from another folder."""
    out, mark, into = str(tmp_path / "out"), str(tmp_path / "mark"), tmp_path / "in"
    (into / "deep").mkdir(parents=True)
    options = {"checkpoint": mark, "snr_min": 5.0, "least_seconds": 1.5}
    (into / "a.wav").write_bytes(K.encode_wav(speech(6, 1), RATE))
    assert curate_tts(spark, f"{into}/*.wav", out, **options)["kept"] == 1
    (into / "b.wav").write_bytes(K.encode_wav(speech(6, 2), RATE))
    (into / "deep/a.wav").write_bytes(K.encode_wav(speech(5, 3), RATE))

    def crash(*_):
        raise RuntimeError("lost before the commit")

    with pytest.MonkeyPatch.context() as m:
        m.setattr(Checkpoint, "commit", crash)
        with pytest.raises(RuntimeError):
            curate_tts(spark, f"{into}/*.wav", out, **options)
    assert names(f"{out}/metadata.csv") == ["a.wav"]
    made = curate_tts(spark, [f"{into}/*.wav", f"{into}/deep/*.wav"], out, **options)
    lines = names(made["output_files"][0])
    assert made["kept"] == 2 and len(lines) == 3 and {"a.wav", "b.wav"} < set(lines)
    assert len({x for x in lines if x.startswith("a_")}) == 1 and all(os.path.exists(f"{out}/{x}") for x in lines)
    assert curate_tts(spark, f"{into}/*.wav", out, **options)["kept"] == 0 and names(f"{out}/metadata.csv") == lines


def test_json_lines_come_once(spark, tmp_path):
    out, mark, into = tmp_path / "m", str(tmp_path / "mark"), tmp_path / "in"
    into.mkdir()
    (into / "a.wav").write_bytes(K.encode_wav(speech(6, 1), RATE))
    options = {"checkpoint": mark, "vad_threshold": 0.1, "snr_min": 5.0}

    def crash(*_):
        raise RuntimeError("lost")

    for at in ("commit", None):
        with pytest.MonkeyPatch.context() as m:
            if at:
                m.setattr(Checkpoint, at, crash)
                with pytest.raises(RuntimeError):
                    curate(spark, f"{into}/*.wav", str(out), **options)
            else:
                curate(spark, f"{into}/*.wav", str(out), **options)
    (into / "b.wav").write_bytes(K.encode_wav(speech(6, 2), RATE))
    with pytest.MonkeyPatch.context() as m:
        shown = manifests.publish_jsonl
        m.setattr(manifests, "publish_jsonl", lambda s, p, c: shown(s, p, c.where("false")) if c.count() < 2 else crash())
        with pytest.raises(RuntimeError):
            curate(spark, f"{into}/*.wav", str(out), **options)
    curate(spark, f"{into}/*.wav", str(out), **options)
    lines = [json.loads(x)["source_path"] for p in out.glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(map(os.path.basename, lines)) == ["a.wav", "b.wav"]


def test_crowded_keys_lose_no_pair(spark):
    r = np.random.default_rng(7)
    words = {int(x) for x in r.integers(0, 1 << 20, 400)} | {int(x) << 30 for x in r.integers(0, 1 << 20, 50)}
    df = spark.createDataFrame([(w,) for w in words], "fp long")
    want = {(a, b) for a in words for b in words if a < b and (a ^ b).bit_count() <= 4}
    for bucket in (10, 60):
        assert {(x.a, x.b) for x in dedup.near_pairs(df, 4, 1, bucket).collect()} == want


def test_audio_stays_where_it_is(spark):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = frame(spark, [speech(2, 1), speech(2, 1), speech(2, 2)]).withColumn("fingerprint", F.xxhash64("n_samples"))
        turns = spark.createDataFrame([("d0", "S1", 0.0, 1.0)], "doc_id string, speaker_id string, start double, end double")
        texts = spark.createDataFrame([("d0", "hi")], "doc_id string, text string")
        for made in (dedup.deduplicate(df), fanout.speaker_turns(turns)(df), models.attach_transcripts(df, texts), manifests.output_name(df)):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_decoders_and_notes(spark, folder, tmp_path):
    (tmp_path / "x.raw").write_bytes(b"\0\0" * 16_000)
    (tmp_path / "x.flac").write_bytes(b"fLaC")
    rows = {r.source_path.rpartition(".")[2]: r for r in sources.clips(spark, f"{tmp_path}/x.*", decoders={"raw": lambda b: (K.from_pcm16(b), RATE)}, warn_bytes=1000).collect()}
    assert rows["raw"].duration_seconds == 1.0 and rows["raw"].extra == {"large_file": "32000"} and rows["flac"].reject_stage == "reader"
    manifests.write_training(spark.createDataFrame([("d/b.wav", "two"), ("d/a.wav", "one")], "path string, text string"), str(tmp_path / "train.csv"))
    assert (tmp_path / "train.csv").read_text() == "a.wav|one\nb.wav|two\n"


def test_no_local_checkpoint_folder_on_a_cluster():
    from larkspur import runtime

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        runtime.checkpoint_folder(Session)


def test_generic_curation_and_inspection(spark, folder, tmp_path):
    stats = curate(spark, f"{folder}/*.wav", str(tmp_path / "m"), vad_threshold=0.1, snr_min=5.0, enhancer="identity")
    lines = [json.loads(x) for p in sorted((tmp_path / "m").glob("part-*")) for x in p.read_text().splitlines()]
    assert stats["kept"] == len(lines) > 0 and lines[0]["metadata"]["enhanced"] is True and lines[0]["metadata"]["snr_db"] >= 5
    assert inspect(spark, f"{folder}/*.wav")["files"] == 5


def test_checkpoint_counts_committed_runs_only(spark, tmp_path):
    store = Checkpoint(spark, str(tmp_path / "c"))
    assert store.done().count() == 0
    ids = spark.createDataFrame([("a",), ("a",), ("b",)], "doc_id string")
    run_id = store.commit(ids)
    spark.createDataFrame([("z", None, "crashed")], "doc_id string, processed_at timestamp, run_id string").write.mode("append").parquet(str(tmp_path / "c/ids"))
    assert {r.doc_id for r in store.done().collect()} == {"a", "b"}
    assert [r.doc_id for r in store.remaining(spark.createDataFrame([("a",), ("z",)], "doc_id string")).collect()] == ["z"]
    out = spark.createDataFrame([(1, run_id), (2, "crashed")], "x int, run_id string")
    assert committed_outputs(out, store).count() == 1
    store.upgrade(spark.createDataFrame([("old",), ("a",)], "doc_id string"))
    assert store.done().count() == 3


def test_models_and_errors(spark):
    df = frame(spark, [speech(1, 1), speech(1, 2)])

    class Broken:
        def run(self, doc_id, audio, rate):
            raise RuntimeError("no")

    providers.register("transcriber", "table2", lambda: providers.TableTranscriber({"d0": " hello "}))
    assert models.transcribe(df, "table").where("transcription = ''").count() == 2
    texts = spark.createDataFrame([("d0", " hi ")], "doc_id string, text string")
    assert {r.doc_id: r.transcription for r in models.attach_transcripts(df, texts).collect()} == {"d0": "hi", "d1": ""}
    out = models.enhance(df).first()
    assert out.enhanced and len(out.audio) == RATE
    assert models.mel_features(df).first().mel_length == RATE // 256
    with pytest.raises(ValueError):
        providers.get_provider("detector", "nothing")
    with pytest.raises(RuntimeError):
        providers.InferenceSession("synthesizer", "tone").run("x", "v")
    with providers.InferenceSession("synthesizer", "TONE") as s:
        assert len(s.run("hello", "v").audio) > 0
    fall = providers.WithFallback(Broken())
    assert fall.spans(speech(1, 1), RATE, 512)[1] == "energy_fallback"


class Batched:
    """Upper-cases ids, a list at a time; one clip's id breaks it."""

    def run_batch(self, items):
        if any(doc == "d2" for doc, _, _ in items):
            raise RuntimeError("no d2")
        return [providers.InferenceResult(text=f" {doc.upper()} of {len(items)} ") for doc, _, _ in items]


def test_models_get_bounded_groups(spark):
    assert list(models.groups([5, 5, 5, 50, 1, 1], 2, 12)) == [(0, 2), (2, 3), (3, 4), (4, 6)] and list(models.groups([])) == []
    df = frame(spark, [speech(0.1, i) for i in range(5)]).repartition(1)
    df = df.withColumn("reject_stage", F.when(F.col("doc_id") == "d4", "vad")).withColumn("audio", F.when(F.col("doc_id") != "d4", F.col("audio")))
    get = lambda kind, name: Batched()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(models, "get_provider", get)
        made = models._run_all(Batched(), [("d0", None, 1), ("d1", None, 1)])
        assert [x.text for x in made] == [" D0 of 2 ", " D1 of 2 "]
        rows = [{"doc_id": f"d{i}", "error_stage": None, "error": None} for i in range(4)]

        def some(rows, audio):
            for row, x in zip(rows, models._run_all(get("", ""), [(r["doc_id"], None, 1) for r in rows])):
                row["text"] = x.text
            return audio

        assert models._tried(some, "transcribe", rows, list("abcd")) == list("abcd")
    assert [r.get("text") for r in rows] == [" D0 of 1 ", " D1 of 1 ", None, " D3 of 1 "] and rows[2]["error"] == "RuntimeError: no d2"
    out = {r.doc_id: r for r in models.transcribe(df, "nothing of this name").collect()}
    assert out["d4"].error_stage is None and out["d4"].audio is None and all(out[f"d{i}"].error_stage == "transcribe" for i in range(4))
    assert {r.doc_id: r.transcription for r in models.transcribe(df, "table").collect()} == {"d0": "", "d1": "", "d2": "", "d3": "", "d4": None}


def test_progress_is_reported(spark):
    from larkspur.plans.progress import watch

    seen = []
    with watch(spark, seen.append, 0.05):
        spark.range(0, 2_000_000, 1, 4).selectExpr("sum(sqrt(id))").collect()
    assert seen and all(p.done <= p.total for p in seen) and "tasks" in str(seen[-1])
    with watch(spark, None):
        pass


def test_user_filter_and_persisted_run(spark, tmp_path):
    df = frame(spark, [speech(6, 1), speech(3, 2)])
    stage = filter_stage("long", F.col("duration_seconds") > 5)
    result = run(df, [stage], Checkpoint(spark, str(tmp_path / "k")))
    assert result.stats["kept"] == 1 and result.stats["skipped"] == 1 and Checkpoint(spark, str(tmp_path / "k")).done().count() == 2
    result.close()
    assert [s.name for s in tts_stages(segment=True, transcriber="table", dedup_threshold=8)] == ["segment", "analyze", "dedup", "transcribe"]


def test_sql_surface(spark):
    sql.register(spark)
    sql.view(frame(spark, [speech(2, 1)]), "clips_t")
    row = spark.sql("select clip_fingerprint(audio, sample_rate) f, size(clip_energy_vad(audio, sample_rate)) n, clip_snr_db(audio, sample_rate) s from clips_t").first()
    assert row.f == K.fingerprint(speech(2, 1)) and row.n > 0 and row.s > 10
    rows = spark.sql("select s.* from clips_t, lateral clip_segments(audio, sample_rate) s").collect()
    assert [(r.start, r.end) for r in rows] == K.merge(K.energy_vad(speech(2, 1)), 2 * RATE)


def test_streaming_files(spark, folder, tmp_path):
    stream = streaming.arriving_clips(spark, folder)
    query = streaming.curate_stream(stream, tts_stages(snr_min=5.0, least_seconds=1.5), str(tmp_path / "o"), str(tmp_path / "s"), once=True)
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    again = streaming.curate_stream(streaming.arriving_clips(spark, folder), tts_stages(snr_min=5.0), str(tmp_path / "o"), str(tmp_path / "s"), once=True)
    again.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_manifest_files(spark, tmp_path):
    (tmp_path / "f.txt").write_text("p1\t1.0\tone\np2\tx\ttwo\n\np3\t3\tthree\tmore\n")
    lines = manifests.read_lines(spark, str(tmp_path / "f.txt"))
    assert [r.duration_seconds for r in manifests.parse_filelist(lines).collect()] == [1.0, 0.0, 3.0]
    assert [r.text for r in manifests.parse_strict(lines).collect()] == ["one", "two", "three\tmore"]
    rows = manifests.parse_for_augmentation(lines, limit=2)
    made = manifests.synthesize(rows, str(tmp_path / "w")).collect()
    assert sorted(r.wav for r in made) == ["kokoro_000000.wav", "kokoro_000001.wav"] and (tmp_path / "w/kokoro_000001.wav").exists()
    with pytest.raises(ValueError):
        A.check_manifest(manifests.parse_strict(lines))
    with pytest.raises(ValueError):
        A.check_manifest(manifests.parse_strict(lines), spark.createDataFrame([("p1",)], "path string"), least=1)
    row = spark.createDataFrame([("a|b\n c",)], "x string").select(manifests.one_line(F.col("x")).alias("x")).first()
    assert row.x == "a b c"


def test_names_and_collisions(spark):
    rows = [("d1", "/x/a.wav", None), ("d2", "/y/a.wav", None), ("d3", "/y/b.c.wav", None), ("d4", "/y/b.wav", "d3")]
    df = spark.createDataFrame(rows, "doc_id string, source_path string, parent_doc_id string")
    assert {r.doc_id: r.wav for r in manifests.output_name(df).collect()} == {"d1": "a_d1.wav", "d2": "a_d2.wav", "d3": "b.c.wav", "d4": "b_d4.wav"}


def test_machine(tmp_path):
    ran = []
    steps = {n: (lambda n=n: ran.append(n)) for n in machine.STEPS}
    state = str(tmp_path / "s.json")
    (tmp_path / "s.json").write_text('{"stage": "curated"}')
    assert machine.run_machine(state, steps) == "previewed" and ran == ["trained", "previewed"]
    assert machine.run_machine(state, steps) == "previewed" and len(ran) == 2
    assert machine.advise(16, 6.5) == {"workers": 6, "ram_per_worker_gib": 0.81, "warnings": [], "master": "local[6]", "spark.driver.memory": "4g"}
    with pytest.raises(RuntimeError):
        machine.run_all(lambda: {"kept": 0}, None, None)


def test_batches_pad_to_the_longest(spark):
    df = frame(spark, [[1.0], [1.0, 2.0], [3.0]], 8)
    rows = sorted(A.collate(df, 2, ["doc_id"]).collect())
    assert rows[0].lengths == [1, 2] and rows[0].audios == [[1.0, 0.0], [1.0, 2.0]] and rows[1].paths == ["/in/d2.wav"]


def test_partitioning_does_not_change_results(spark):
    df = frame(spark, [speech(2 + i / 4, i) for i in range(8)])
    stages = tts_stages(snr_min=5.0, least_seconds=1.0, dedup_threshold=8)
    pick = ["doc_id", "reject_stage", "duplicate_of", "snr_db", "fingerprint"]
    assert sorted(map(str, run_stages(df.repartition(1), stages).select(pick).collect())) == sorted(map(str, run_stages(df.repartition(7), stages).select(pick).collect()))
    assert set(CLIP) <= set(df.columns)


def test_trim_leaves_known_spans_alone(spark):
    df = frame(spark, [speech(3, 1)]).withColumn("vad_speech_timestamps", F.array(F.struct(F.lit(8000).alias("start"), F.lit(32000).alias("end"))))
    row = filters.trim_silence()(df).first()
    assert row.n_samples == 24_000 + 2 * 2400 and row.vad_speech_timestamps[0].start == 2400
    short = df.withColumn("vad_speech_timestamps", F.array(F.struct(F.lit(8000).alias("start"), F.lit(9000).alias("end"))))
    assert filters.trim_silence()(short).first().n_samples == 3 * RATE


def test_data_source(spark, folder):
    from larkspur.sources import datasource

    datasource.register(spark)
    rows = {os.path.basename(r.source_path): r for r in spark.read.format("clips").option("rate", 8000).load(f"{folder}/*.wav").collect()}
    assert len(rows["a.wav"].audio) == 48_000 and rows["bad.wav"].error and rows["bad.wav"].audio is None


def test_command_line(spark, folder, tmp_path, capsys):
    from larkspur.cli import main

    assert main(["doctor"]) == 0 and json.loads(capsys.readouterr().out)["workers"] >= 1
    assert main(["inspect", folder]) == 0 and json.loads(capsys.readouterr().out)["files"] == 6
    assert main(["curate", folder, str(tmp_path / "m"), "--vad-threshold", "0.1", "--snr-min", "5", "--progress"]) == 0
    assert json.loads(capsys.readouterr().out)["kept"] >= 2
    assert main(["curate", f"{folder}/a.wav", str(tmp_path / "t"), "--tts", "--snr-min", "5", "--formats", "ljspeech"]) == 0
    assert json.loads(capsys.readouterr().out)["kept"] == 1 and (tmp_path / "t/metadata.csv").exists()
    with pytest.raises(SystemExit):
        main(["nothing"])


def test_windows_and_repeats_by_event_time(spark, tmp_path):
    rows = [("a", "2026-01-01 00:01:00", 1.0, None), ("a", "2026-01-01 00:02:00", 1.0, None), ("b", "2026-01-01 00:12:00", 2.0, "snr")]
    df = spark.createDataFrame(rows, "doc_id string, at string, duration_seconds double, reject_stage string").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    schema = df.schema
    for name, make in (("w", lambda s: streaming.windowed_report(s.withColumn("error_stage", F.lit(None).cast("string")), "at")), ("d", lambda s: streaming.first_of_id(s, "at"))):
        mode = "complete" if name == "w" else "append"
        q = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(f"q_{name}").outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted((r.clips, r.kept) for r in spark.table("q_w").collect()) == [(1, 0), (2, 2)]
    assert sorted(r.doc_id for r in spark.table("q_d").collect()) == ["a", "b"]
