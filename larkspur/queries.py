"""The query catalogue: each operator on the driver's tables, with DuckDB SQL for the same result.

Waveforms are derived from tables: per-user event values (8 samples a second, frames of 8)
and 64-number embeddings. Doubles that reach a result are rounded to six digits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import ids
from larkspur.functions import signal as S
from larkspur.operators import aggregates as A
from larkspur.operators import dedup, fanout, filters, models
from larkspur.operators.analyze import Analysis, analyze
from larkspur.operators.stage import active, drop_failed_families, errors_by_stage, reject, run_stages, run_stats
from larkspur.plans.checkpoint import Checkpoint, finished_sources
from larkspur.plans.curate import column_stages, status
from larkspur.runtime import checkpoint_folder, table
from larkspur.schema import conform
from larkspur.sources import audio, manifests, waveforms

FRAME = RATE = 8
THRESHOLD = 20
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def user_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waveforms.series(table(spark, sf_dir, "events").where("user_id is not null"), "user_id", F.col("value") / 500.0, ["ts", "event_id"], RATE)


def vector_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waveforms.arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", RATE)


def key(name: str) -> F.Column:
    return F.col("doc_id").cast("bigint").alias(name)


# SQL building blocks: u/v are clips (k, a, n); e adds frame energies; h adds hit frames.
CLIPS_U = "u AS (SELECT user_id AS k, list(CAST(value / 500.0 AS FLOAT) ORDER BY ts, event_id) AS a FROM events WHERE user_id IS NOT NULL GROUP BY user_id)"
CLIPS_V = "u AS (SELECT vec_id AS k, embedding AS a FROM embeddings)"
SQUARE = "list_transform(a[i * 8 + 1 : i * 8 + 8], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))"
HITS = f"""
e AS (SELECT k, a, len(a) AS n, list_transform(range(0, CAST(ceil(len(a) / 8.0) AS BIGINT)), lambda i: list_sum({SQUARE}) / least(8, len(a) - i * 8)) AS e FROM u),
m AS (SELECT *, list_avg(e) AS mu, sqrt(list_avg(list_transform(e, lambda x: (x - list_avg(e)) * (x - list_avg(e))))) AS sd FROM e),
h0 AS (SELECT *, list_filter(range(0, len(e)), lambda i: e[i + 1] > mu + sd) AS h1 FROM m),
h AS (SELECT *, CASE WHEN mu >= 1e-4 AND len(h1) >= 0.1 * len(e) THEN h1 ELSE CAST([] AS BIGINT[]) END AS hits FROM h0),
r AS (SELECT *, coalesce(list_sum(list_transform(hits, lambda i: least((i + 1) * 8, n) - i * 8)), 0) / n AS ratio FROM h)"""
TRIM = """
t0 AS (SELECT *, greatest(0, list_min(hits) * 8 - 1) AS s0, least(n, least((list_max(hits) + 1) * 8, n) + 1) AS e0 FROM r),
t AS (SELECT *, coalesce(len(hits) > 0 AND (e0 - s0) / 8.0 >= 1.0, FALSE) AS cut FROM t0),
c AS (SELECT k, a, n, hits, ratio, cut, CASE WHEN cut THEN s0 ELSE 0 END AS s, CASE WHEN cut THEN e0 ELSE n END AS t FROM t)"""
NOISE = """
p0 AS (SELECT *, list_filter(range(s, t), lambda i: list_contains(hits, i // 8)) AS loud, list_filter(range(s, t), lambda i: NOT list_contains(hits, i // 8)) AS quiet FROM c),
p1 AS (SELECT *, list_sum(list_transform(loud, lambda i: CAST(a[i + 1] AS DOUBLE) ** 2)) / len(loud) AS ps, list_sum(list_transform(quiet, lambda i: CAST(a[i + 1] AS DOUBLE) ** 2)) / len(quiet) AS pn FROM p0),
p AS (SELECT *, (t - s) / 8.0 AS seconds, CASE WHEN len(quiet) < 0.8 OR pn = 0 THEN 40.0 ELSE 10 * log10(ps / (pn + 1e-10)) END AS db, len(quiet) < 0.8 AS short FROM p1)"""


@query("SELECT doc_id, sha256(text)[1:16] AS text_id, sha256(source || ':' || doc_id || ':' || n_chars)[1:16] AS segment_id FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def doc_id_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    return docs.select("doc_id", ids.source_id(F.col("text")).alias("text_id"), ids.segment_id(F.col("source"), F.col("doc_id"), F.col("n_chars")).alias("segment_id"))


@query(f"WITH {CLIPS_U}, {HITS} SELECT k AS user_id, unnest(range(0, len(e))) AS frame, round(unnest(e), 6) AS energy FROM e")
def frame_energy(spark, sf_dir):
    e = user_clips(spark, sf_dir).select("doc_id", F.posexplode(S.frame_energies(F.col("audio"), FRAME)).alias("frame", "energy"))
    return e.select(key("user_id"), F.col("frame").cast("bigint").alias("frame"), F.round("energy", 6).alias("energy"))


@query(f"WITH {CLIPS_U}, {HITS}, x AS (SELECT k, n, unnest(hits) AS i FROM h) SELECT k AS user_id, i * 8 AS start_at, least((i + 1) * 8, n) AS end_at FROM x")
def energy_vad_segments(spark, sf_dir):
    found = filters.with_vad(user_clips(spark, sf_dir), FRAME).select("doc_id", F.explode("vad_speech_timestamps").alias("s"))
    return found.select(key("user_id"), F.col("s.start").cast("bigint").alias("start_at"), F.col("s.end").cast("bigint").alias("end_at"))


@query(f"WITH {CLIPS_V}, {HITS} SELECT k AS vec_id, CAST(len(hits) AS BIGINT) AS n_spans, round(ratio, 4) AS ratio, len(hits) > 0 AND ratio >= 0.25 AS keep FROM r")
def vad_filter(spark, sf_dir):
    rows = filters.vad_filter(0.25, FRAME)(vector_clips(spark, sf_dir))
    return rows.select(key("vec_id"), F.size("vad_speech_timestamps").cast("bigint").alias("n_spans"), F.col("vad_speech_ratio").alias("ratio"), active().alias("keep"))


@query(f"""WITH {CLIPS_U}, {HITS}, x AS (SELECT k, a, n, unnest(hits) AS i FROM h), y AS (SELECT *, i * 8 AS s, least((i + 1) * 8, n) AS t FROM x)
SELECT k AS user_id, sha256(k || ':' || s || ':' || t)[1:16] AS segment_id, s AS start_at, t AS end_at, (t - s) / 8.0 AS seconds, round(list_avg(list_transform(a[s + 1 : t], lambda v: CAST(v AS DOUBLE))), 6) AS mean FROM y""")
def vad_segment_docs(spark, sf_dir):
    rows = fanout.segment_speech(FRAME)(user_clips(spark, sf_dir)).where(active())
    wide = F.transform("audio", lambda x: x.cast("double"))
    return rows.select(
        F.col("parent_doc_id").cast("bigint").alias("user_id"), F.col("doc_id").alias("segment_id"), F.col("segment_start_sample").cast("bigint").alias("start_at"),
        F.col("segment_end_sample").cast("bigint").alias("end_at"), F.col("duration_seconds").alias("seconds"), F.round(S.mean(wide), 6).alias("mean"),
    )


def turn_spans(spark, sf_dir) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").where("text is not null and turn is not null")
    return talk.select("conv_id", (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + F.length("text") % 25).alias("end"))


SPANS_SQL = """s AS (SELECT conv_id, turn * 10 AS a, turn * 10 + length(text) % 25 AS b FROM conversations WHERE text IS NOT NULL AND turn IS NOT NULL),
s1 AS (SELECT *, max(b) OVER (PARTITION BY conv_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s WHERE b > a),
s2 AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM s1),
g AS (SELECT conv_id, min(a) AS a, max(b) AS b FROM s2 GROUP BY conv_id, g)"""


@query(f"WITH {SPANS_SQL} SELECT conv_id, a AS start_at, b AS end_at FROM g")
def interval_union(spark, sf_dir):
    return A.interval_union(turn_spans(spark, sf_dir), ["conv_id"]).select("conv_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query(f"WITH {SPANS_SQL}, q AS (SELECT conv_id, lag(b) OVER (PARTITION BY conv_id ORDER BY a) AS a, a AS b FROM g) SELECT conv_id, a AS start_at, b AS end_at FROM q WHERE a < b")
def noise_gaps(spark, sf_dir):
    union = A.interval_union(turn_spans(spark, sf_dir), ["conv_id"])
    return A.interval_gaps(union, ["conv_id"]).select("conv_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query(f"WITH {SPANS_SQL}, f AS (SELECT conv_id, unnest(range(0, m)) AS pos FROM (SELECT conv_id, max(b) AS m FROM s GROUP BY conv_id)) SELECT f.conv_id, count(DISTINCT pos) AS n_inside FROM f JOIN s ON f.conv_id = s.conv_id AND pos >= a AND pos < b GROUP BY f.conv_id")
def samples_in_intervals(spark, sf_dir):
    spans = turn_spans(spark, sf_dir)
    frames = spans.groupBy("conv_id").agg(F.max("end").alias("n")).where("n > 0").select("conv_id", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("at"))
    return A.samples_in_intervals(frames, spans, ["conv_id"], 16).groupBy("conv_id").agg(F.count_distinct("at").alias("n_inside"))


@query(f"WITH {CLIPS_U}, {HITS}, c AS (SELECT *, 0 AS s, n AS t FROM r WHERE len(hits) > 0), {NOISE} SELECT k AS user_id, round(db, 4) AS snr_db, coalesce(short, FALSE) AS short_noise FROM p")
def snr_timestamps(spark, sf_dir):
    rows = filters.with_vad(user_clips(spark, sf_dir), FRAME).where(F.size("vad_speech_timestamps") > 0)
    value, note = filters.snr_columns(F.col("audio"), F.col("vad_speech_timestamps"), F.col("sample_rate"), FRAME)
    return rows.select(key("user_id"), F.round(value, 4).alias("snr_db"), note.isNotNull().alias("short_noise"))


@query(f"""WITH {CLIPS_V}, e AS (SELECT k, list_transform(range(0, len(a) // 8), lambda i: list_sum({SQUARE}) / 8) AS e FROM u),
x AS (SELECT k, unnest(e) AS e FROM e), q AS (SELECT k, quantile_cont(e, 0.75) AS q FROM x GROUP BY k)
SELECT x.k AS vec_id, round(10 * log10(avg(e) FILTER (WHERE e >= q) / (avg(e) FILTER (WHERE e < q) + 1e-10)), 4) AS snr_db FROM x JOIN q USING (k) GROUP BY x.k""")
def snr_energy_fallback(spark, sf_dir):
    value, _ = filters.snr_columns(F.col("audio"), F.col("vad_speech_timestamps"), F.col("sample_rate"), FRAME)
    return vector_clips(spark, sf_dir).select(key("vec_id"), F.round(value, 4).alias("snr_db"))


@query(f"""WITH {CLIPS_U}, {HITS}, {TRIM} SELECT k AS user_id, CAST(t - s AS BIGINT) AS n_samples, (t - s) / 8.0 AS seconds,
coalesce(CAST(list_min(hits) * 8 - s AS BIGINT), -1) AS first_start, round(list_sum(list_transform(a[s + 1 : t], lambda v: CAST(v AS DOUBLE))), 6) AS total FROM c""")
def silence_trim(spark, sf_dir):
    rows = filters.trim_silence(125, 1.0, FRAME)(user_clips(spark, sf_dir))
    total = F.aggregate("audio", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    first = F.coalesce(F.array_min(F.transform("vad_speech_timestamps", lambda s: s["start"])).cast("bigint"), F.lit(-1))
    return rows.select(key("user_id"), F.col("n_samples").cast("bigint").alias("n_samples"), F.col("duration_seconds").alias("seconds"), first.alias("first_start"), F.round(total, 6).alias("total"))


@query(f"WITH {CLIPS_U} SELECT k AS user_id, len(a) / 8.0 AS seconds, CASE WHEN len(a) / 8.0 BETWEEN 7 AND 10 THEN 'keep' WHEN len(a) / 8.0 < 7 THEN 'too_short' ELSE 'too_long' END AS verdict FROM u")
def duration_bucket(spark, sf_dir):
    rows = filters.duration_filter(7, 10)(user_clips(spark, sf_dir))
    return rows.select(key("user_id"), F.col("duration_seconds").alias("seconds"), F.coalesce("reject_reason", F.lit("keep")).alias("verdict"))


@query(f"WITH {CLIPS_U} SELECT k AS user_id, CAST(least(len(a), 72) AS BIGINT) AS n_samples, least(len(a) / 8.0, 9.0) AS seconds FROM u WHERE len(a) / 8.0 >= 7.5")
def reader_bounds(spark, sf_dir):
    rows = filters.reader_bounds(user_clips(spark, sf_dir), 7.5, 9.0).where(active())
    return rows.select(key("user_id"), F.col("n_samples").cast("bigint").alias("n_samples"), F.col("duration_seconds").alias("seconds"))


def _posed(df: DataFrame, name: str, values: F.Column, digits: int | None = 6) -> DataFrame:
    out = df.select(key(name), F.posexplode(values).alias("at", "x"))
    x = F.round(F.col("x").cast("double"), digits) if digits is not None else F.col("x").cast("bigint")
    return out.select(name, F.col("at").cast("bigint").alias("at"), x.alias("x"))


@query(f"WITH {CLIPS_V} SELECT k AS vec_id, unnest(range(0, 32)) AS at, round(unnest(list_transform(range(0, 32), lambda i: (CAST(a[2 * i + 1] AS DOUBLE) + CAST(a[2 * i + 2] AS DOUBLE)) / 2)), 6) AS x FROM u")
def downmix(spark, sf_dir):
    return _posed(vector_clips(spark, sf_dir), "vec_id", S.downmix(F.col("audio"), 2))


@query(f"""WITH {CLIPS_V}, j AS (SELECT k, a, unnest(range(0, 96)) AS i FROM u), y AS (SELECT *, i * CAST(64 AS DOUBLE) / 96 AS p FROM j)
SELECT k AS vec_id, i AS at, round(CAST(a[CAST(floor(p) AS BIGINT) + 1] AS DOUBLE) + (p - floor(p)) * (CAST(a[least(CAST(floor(p) AS BIGINT) + 2, 64)] AS DOUBLE) - CAST(a[CAST(floor(p) AS BIGINT) + 1] AS DOUBLE)), 6) AS x FROM y""")
def resample_linear(spark, sf_dir):
    return _posed(vector_clips(spark, sf_dir), "vec_id", S.resample_linear(F.col("audio"), 16_000, 24_000))


@query(f"WITH {CLIPS_V} SELECT k AS vec_id, unnest(range(0, 64)) AS at, unnest(list_transform(a, lambda v: CAST(trunc(greatest(-1.0, least(1.0, 4 * CAST(v AS DOUBLE))) * 32767) AS BIGINT))) AS x FROM u")
def pcm16_encode(spark, sf_dir):
    return _posed(vector_clips(spark, sf_dir), "vec_id", S.pcm16(F.transform("audio", lambda x: 4 * x.cast("double"))), None)


@query(f"WITH {CLIPS_U} SELECT k AS user_id, round(list_max(list_transform(a, lambda v: abs(CAST(v AS DOUBLE)))), 6) AS peak, len(list_filter(a, lambda v: abs(CAST(v AS DOUBLE)) >= 0.97)) > 0 AS loud, len(list_filter(a, lambda v: abs(CAST(v AS DOUBLE)) > 1e-4)) < 0.01 * len(a) AS silent FROM u")
def quality_flags(spark, sf_dir):
    return user_clips(spark, sf_dir).select(key("user_id"), F.round(S.peak(F.col("audio")), 6).alias("peak"), (S.peak(F.col("audio")) >= 0.97).alias("loud"), S.is_silent(F.col("audio")).alias("silent"))


BITS = "b AS (SELECT vec_id, CAST(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > list_avg(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) THEN CAST(1 AS HUGEINT) << i ELSE CAST(0 AS HUGEINT) END)) AS HUGEINT) AS fp FROM embeddings)"


def vector_prints(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id"), S.band_fingerprint(F.col("embedding")).alias("fingerprint"))


@query(f"WITH {BITS} SELECT vec_id, lpad(lower(to_hex(fp)), 16, '0') AS fp, sha256(unhex(array_to_string(list_transform(range(0, 8), lambda i: lpad(lower(to_hex(fp)), 16, '0')[15 - 2 * i : 16 - 2 * i]), '')))[1:16] AS fp_hash FROM b")
def fingerprint_bits(spark, sf_dir):
    return vector_prints(spark, sf_dir).select("vec_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fp"), S.fingerprint_hash(F.col("fingerprint")).alias("fp_hash"))


@query(f"WITH {BITS}, d AS (SELECT DISTINCT fp FROM b) SELECT least(lpad(lower(to_hex(x.fp)), 16, '0'), lpad(lower(to_hex(y.fp)), 16, '0')) AS a, greatest(lpad(lower(to_hex(x.fp)), 16, '0'), lpad(lower(to_hex(y.fp)), 16, '0')) AS b FROM d x JOIN d y ON x.fp < y.fp AND bit_count(xor(x.fp, y.fp)) <= {THRESHOLD}")
def fingerprint_pairs(spark, sf_dir):
    pairs = dedup.near_pairs(vector_prints(spark, sf_dir).select(F.col("fingerprint").alias("fp")).distinct(), THRESHOLD)
    a, b = (F.lower(F.lpad(F.hex(c), 16, "0")) for c in ("a", "b"))
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


@query(f"""WITH RECURSIVE {BITS}, f AS (SELECT vec_id, fp, row_number() OVER (ORDER BY vec_id) AS r FROM b),
s AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(id BIGINT, fp HUGEINT)[]) AS kept, CAST(NULL AS BIGINT) AS vec_id, CAST(NULL AS BIGINT) AS dup
UNION ALL SELECT r, CASE WHEN len(m) = 0 THEN list_append(kept, {{'id': vec_id, 'fp': fp}}) ELSE kept END, vec_id, m[1].id
FROM (SELECT f.r, f.vec_id, f.fp, s.kept, list_filter(s.kept, lambda k: bit_count(xor(k.fp, f.fp)) <= {THRESHOLD}) AS m FROM s JOIN f ON f.r = s.r + 1))
SELECT vec_id, dup AS duplicate_of FROM s WHERE r > 0""")
def fingerprint_dedup(spark, sf_dir):
    rows = vector_prints(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "fingerprint")
    return dedup.greedy_duplicates(rows, THRESHOLD, order=("doc_id",)).select(F.col("doc_id").alias("vec_id"), "duplicate_of")


def talk_turns(spark, sf_dir) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").where("text is not null and role is not null and turn is not null")
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("text")).over(by)
    return talk.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("role").alias("speaker_id"), ((end - F.length("text")) / 100.0).cast("double").alias("start"), (end / 100.0).cast("double").alias("end"))


@query("""WITH w AS (SELECT conv_id, role, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL AND turn IS NOT NULL),
x AS (SELECT conv_id, role, CAST((e - n) / 100.0 AS DOUBLE) AS s, CAST(e / 100.0 AS DOUBLE) AS e, CAST(floor(max(e) OVER (PARTITION BY conv_id) / 10) AS BIGINT) AS total FROM w)
SELECT conv_id || '__' || role || '__' || CAST(trunc(s * 1000) AS BIGINT) || '_' || CAST(trunc(e * 1000) AS BIGINT) AS doc_id, role AS speaker_id, round(e - s, 6) AS seconds,
CAST(greatest(least(trunc(s * 10), total), least(trunc(e * 10), total)) - least(trunc(s * 10), total) AS BIGINT) AS n_samples FROM x""")
def diarize_turns(spark, sf_dir):
    turns = talk_turns(spark, sf_dir)
    talks = turns.groupBy("doc_id").agg(F.array_repeat(F.lit(0.5).cast("float"), F.floor(F.max(F.round(F.col("end") * 100)) / 10).cast("int")).alias("audio"))
    rows = fanout.speaker_turns(turns)(conform(talks.withColumns({"sample_rate": F.lit(10), "duration_seconds": F.size("audio") / 10.0})))
    return rows.where(active()).select("doc_id", "speaker_id", F.round("duration_seconds", 6).alias("seconds"), F.col("n_samples").cast("bigint").alias("n_samples"))


@query("SELECT conv_id, trim(string_agg(text, ' ' ORDER BY turn, text)) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def asr_text_join(spark, sf_dir):
    return A.join_segments(table(spark, sf_dir, "conversations").where("text is not null"), ["conv_id"], ["turn"], "text")


def doc_clips(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("source is not null and lang is not null and n_chars is not null")
    return docs.select(
        "doc_id", F.concat_ws("/", F.lit("in"), "source", F.concat(F.lit("f"), (F.col("doc_id") % 97).cast("string"), F.lit("."), "lang")).alias("source_path"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("parent_doc_id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("speaker_id"),
        F.col("text").alias("transcription"), (F.col("n_chars") / 100.0).cast("double").alias("duration_seconds"),
    )


DOCS_SQL = r"""d AS (SELECT doc_id, 'f' || (doc_id % 97) AS stem, doc_id % 3 = 0 AS child, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'speaker_00' END AS who, trim(regexp_replace(coalesce(text, ''), '[\s|]+', ' ', 'g')) AS line, n_chars / 100.0 AS sec FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL),
c AS (SELECT stem FROM d WHERE NOT child GROUP BY stem HAVING count(*) > 1),
o AS (SELECT d.*, CASE WHEN child OR c.stem IS NOT NULL THEN d.stem || '_' || doc_id || '.wav' ELSE d.stem || '.wav' END AS wav FROM d LEFT JOIN c ON d.stem = c.stem)"""


@query(f"WITH {DOCS_SQL} SELECT wav || '|' || who || '|' || line AS value FROM o")
def ljspeech_manifest(spark, sf_dir):
    return manifests.ljspeech_rows(manifests.output_name(doc_clips(spark, sf_dir)))


@query(f"WITH {DOCS_SQL} SELECT 'wavs/' || wav || chr(9) || printf('%.4f', sec) || chr(9) || line AS value FROM o")
def f5_manifest(spark, sf_dir):
    return manifests.f5_rows(manifests.output_name(doc_clips(spark, sf_dir)), "wavs/")


@query("""SELECT '{"doc_id":' || doc_id || ',"source_path":"in/' || source || '/f' || (doc_id % 97) || '.' || lang || '","sample_rate":16000,"duration_seconds":' || CAST(round(n_chars / 100.0, 4) AS DOUBLE) ||
',"metadata":{' || concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN '"parent_doc_id":"' || source || '"' END, CASE WHEN doc_id % 2 = 0 THEN '"speaker_id":"' || lang || '"' END) || '},"pipeline_version":"0.1.0","processed_at":"2026-01-01T00:00:00+00:00"}' AS value
FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL""")
def jsonl_manifest(spark, sf_dir):
    rows = doc_clips(spark, sf_dir).drop("transcription").withColumn("sample_rate", F.lit(16_000))
    return manifests.jsonl_rows(rows, "0.1.0", F.lit("2026-01-01T00:00:00+00:00"))


def manifest_lines(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    wide = F.when(F.col("doc_id") % 7 == 0, F.lit("bad")).otherwise((F.col("n_chars") / 100.0).cast("double").cast("decimal(18,2)").cast("string"))
    line = F.when(F.col("doc_id") % 11 == 0, F.lit("")).when(F.col("doc_id") % 5 == 0, F.concat(F.lit("p"), F.col("doc_id"), F.lit("\t"), wide)).otherwise(F.concat(F.lit("p"), F.col("doc_id"), F.lit("\t"), wide, F.lit("\t"), text))
    return docs.where("n_chars is not null").select(F.col("doc_id").alias("at"), line.alias("value"))


LINES_SQL = r"""n AS (SELECT doc_id AS pos, regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') AS t, CASE WHEN doc_id % 7 = 0 THEN 'bad' ELSE CAST(CAST(n_chars / 100.0 AS DECIMAL(18, 2)) AS VARCHAR) END AS w FROM documents WHERE n_chars IS NOT NULL),
l AS (SELECT pos, CASE WHEN pos % 11 = 0 THEN '' WHEN pos % 5 = 0 THEN 'p' || pos || chr(9) || w ELSE 'p' || pos || chr(9) || w || chr(9) || t END AS value, w, t FROM n)"""


@query(f"WITH {LINES_SQL}, p AS (SELECT 'p' || pos AS path, coalesce(TRY_CAST(w AS DOUBLE), 0.0) AS duration_seconds, CASE WHEN pos % 5 = 0 THEN '' ELSE t END AS text FROM l WHERE pos % 11 <> 0) SELECT * FROM p WHERE duration_seconds = 0 OR duration_seconds BETWEEN 5 AND 40")
def manifest_parse(spark, sf_dir):
    return manifests.parse_filelist(manifest_lines(spark, sf_dir), least=5.0, most=40.0)


@query(f"WITH {LINES_SQL} SELECT 'p' || pos AS path, w AS duration, t AS text FROM l WHERE pos % 11 <> 0 AND pos % 5 <> 0")
def manifest_strict(spark, sf_dir):
    return manifests.parse_strict(manifest_lines(spark, sf_dir))


@query(f"WITH {LINES_SQL} SELECT pos AS at, trim(t) AS text, printf('kokoro_%06d.wav', pos) AS wav FROM l WHERE pos % 11 <> 0 AND pos % 5 <> 0 AND trim(t) <> ''")
def manifest_augment(spark, sf_dir):
    return manifests.parse_for_augmentation(manifest_lines(spark, sf_dir))


@query("SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def checkpoint_resume(spark, sf_dir):
    store = Checkpoint(spark, f"{checkpoint_folder(spark)}/resume-{uuid.uuid4().hex}")
    store.commit(table(spark, sf_dir, "labels").where("doc_id is not null"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("doc_id").cast("string").alias("name"))
    return store.remaining(docs, "name").select("doc_id", "n_chars")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0 WHEN doc_id % 5 = 0 THEN 1 ELSE 2 END AS pattern FROM documents")
def path_dedup(spark, sf_dir):
    """Paths that several patterns match, each by its first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"))
    found = [docs.where(c).withColumn("_pattern", F.lit(i)) for i, c in enumerate(("doc_id % 2 = 0", "doc_id % 5 = 0", "doc_id is not null"))]
    rows = audio.first_match(found[0].unionByName(found[1]).unionByName(found[2]))
    return rows.select("doc_id", F.col("_pattern").alias("pattern"))


@query("SELECT d.doc_id, l.quality AS decoded, l.quality IS NULL AS lazily FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def decoded_lookup(spark, sf_dir):
    found = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("source_path")).agg(F.max("quality").alias("sample_rate"))
    entries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    rows = audio.mark_missing(entries, found.withColumn("audio", F.array().cast("array<float>")))
    return rows.select(F.col("path").alias("doc_id"), F.col("sample_rate").alias("decoded"), F.col("sample_rate").isNull().alias("lazily"))


@query(f"""WITH {CLIPS_U}, q AS (SELECT k, len(a) / 8.0 AS s, list_max(list_transform(a, lambda v: abs(CAST(v AS DOUBLE)))) AS p, len(list_filter(a, lambda v: abs(CAST(v AS DOUBLE)) > 1e-4)) < 0.01 * len(a) AS z FROM u)
SELECT count(*) AS clips, count(*) FILTER (WHERE p >= 0.999) AS clipped, count(*) FILTER (WHERE z) AS silence_only, min(s) AS duration_min, max(s) AS duration_max, round(avg(s), 6) AS duration_mean FROM q""")
def qc_report(spark, sf_dir):
    report = A.qc_report(user_clips(spark, sf_dir), A.quality_flags(F.col("audio")))
    return report.withColumn("duration_mean", F.round("duration_mean", 6))


@query("SELECT count(*) AS files, round(sum(n_chars / 100.0), 4) AS total_seconds, round(sum(n_chars / 100.0) / 3600, 6) AS total_hours, round(avg(n_chars / 100.0), 6) AS mean_seconds, round(quantile_cont(n_chars / 100.0, 0.5), 6) AS median_seconds, min(n_chars / 100.0) AS min_seconds, max(n_chars / 100.0) AS max_seconds FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL")
def inspect_stats(spark, sf_dir):
    rows = A.inspect_stats(doc_clips(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 4 if c == "total_seconds" else 6) for c in rows.columns if c != "files"})


@query("SELECT lang AS format, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL GROUP BY lang")
def format_counts(spark, sf_dir):
    return A.count_formats(doc_clips(spark, sf_dir))


@query(f"""WITH {CLIPS_U}, o AS (SELECT *, (row_number() OVER (ORDER BY k) - 1) // 16 AS batch FROM u)
SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, CAST(max(len(a)) AS BIGINT) AS longest, string_agg(CAST(len(a) AS VARCHAR), ',' ORDER BY k) AS lengths, round(sum(list_sum(list_transform(a, lambda v: CAST(v AS DOUBLE)))), 4) AS total FROM o GROUP BY batch""")
def collate_batches(spark, sf_dir):
    clips = user_clips(spark, sf_dir).withColumn("_k", F.col("doc_id").cast("bigint"))
    rows = A.collate(clips, 16, ["_k"])
    sums = F.transform("audios", lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double")))
    return rows.select(
        F.col("batch").cast("bigint").alias("batch"), F.size("lengths").cast("bigint").alias("n"), F.array_max(F.transform("audios", lambda a: F.size(a))).cast("bigint").alias("longest"),
        F.array_join(F.transform("lengths", lambda n: n.cast("string")), ",").alias("lengths"), F.round(F.aggregate(sums, F.lit(0.0), lambda acc, x: acc + x), 4).alias("total"),
    )


CHAIN = f"""{CLIPS_U}, {HITS}, {TRIM}, {NOISE},
z AS (SELECT *, CASE WHEN NOT (len(hits) > 0 AND ratio >= 0.1) THEN 'vad' WHEN NOT db >= 4.0 THEN 'snr' WHEN seconds < 2 OR seconds > 7 THEN 'duration' ELSE 'keep' END AS status FROM p)"""
CHAIN_ROWS = f"""WITH {CHAIN} SELECT k AS user_id, CASE WHEN status = 'vad' THEN n ELSE t - s END AS n_samples, round(ratio, 4) AS ratio, CASE WHEN status <> 'vad' THEN round(db, 2) END AS snr_db,
CASE WHEN status = 'vad' THEN n / 8.0 ELSE seconds END AS seconds, status, CASE status WHEN 'vad' THEN 'low_speech_ratio' WHEN 'snr' THEN 'low_snr' WHEN 'duration' THEN CASE WHEN seconds < 2 THEN 'too_short' ELSE 'too_long' END END AS reason FROM z"""


def _chain_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        key("user_id"), F.col("n_samples").cast("bigint").alias("n_samples"), F.col("vad_speech_ratio").alias("ratio"), "snr_db",
        F.col("duration_seconds").alias("seconds"), status().alias("status"), F.col("reject_reason").alias("reason"),
    )


@query(CHAIN_ROWS)
def curate_pipeline(spark, sf_dir):
    """Speech, trim, noise and duration as Column stages: no Python, one shuffle to make the clips."""
    return _chain_rows(run_stages(user_clips(spark, sf_dir), column_stages(0.1, 125, 1.0, 4.0, 2.0, 7.0, FRAME)))


@query(CHAIN_ROWS)
def curate_kernel(spark, sf_dir):
    """The same chain in the fused Arrow kernel."""
    steps = Analysis(vad_min_ratio=0.1, trim_padding_ms=125, trim_least_seconds=1.0, snr_min_db=4.0, least_seconds=2.0, most_seconds=7.0, frame=FRAME)
    return _chain_rows(analyze(user_clips(spark, sf_dir), steps))


@query(f"WITH {CHAIN} SELECT count(*) AS processed, count(*) FILTER (WHERE status = 'keep') AS kept, count(*) FILTER (WHERE status <> 'keep') AS skipped, CAST(0 AS BIGINT) AS errors FROM z")
def stage_stats(spark, sf_dir):
    return run_stats(run_stages(user_clips(spark, sf_dir), column_stages(0.1, 125, 1.0, 4.0, 2.0, 7.0, FRAME)))


@query("SELECT event_type AS epoch, round(avg(value), 6) AS loss, avg(value) = min(avg(value)) OVER () AS best FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def epoch_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type is not null").select(F.col("event_type").alias("epoch"), F.col("value").alias("loss"))
    return A.best_epoch(rows).withColumn("loss", F.round("loss", 6))


@query("SELECT CAST(user_id % 10 AS BIGINT) AS shard, arg_max(event_id, ts) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 10, ts ORDER BY event_id DESC) AS r FROM events WHERE user_id IS NOT NULL) WHERE r = 1 GROUP BY 1")
def newest_checkpoint(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("user_id is not null")
    rows = rows.select((F.col("user_id") % 10).cast("bigint").alias("shard"), F.col("event_id").alias("path"), F.col("ts").alias("modificationTime"))
    return A.newest(rows, ["shard"]).withColumnRenamed("path", "newest")


@query("SELECT doc_id, n_chars >= 500 AND lang = 'en' AS keep FROM documents")
def user_filter(spark, sf_dir):
    """A predicate of the user's as a filter stage; null rejects."""
    docs = conform(table(spark, sf_dir, "documents").withColumn("source_path", F.col("source")).drop("text"))
    rows = reject(docs, "user", (F.col("n_chars") >= 500) & (F.col("lang") == "en"), "user_rule")
    return rows.select("doc_id", active().alias("keep"))


# Decoded audio and the kernels behind it


def wav_files(spark, sf_dir) -> DataFrame:
    """(path, content): every vector as a WAV file, each tenth one damaged."""
    files = manifests.wav_bytes(vector_clips(spark, sf_dir).withColumn("wav", F.concat(F.lit("in/"), "doc_id", F.lit(".wav"))))
    damaged = vec_of("path") % 10 == 0
    return files.withColumn("content", F.when(damaged, F.encode(F.lit("no audio"), "UTF-8")).otherwise(F.col("content")))


def vec_of(path: str) -> F.Column:
    return F.regexp_extract(path, r"in/(\d+)\.wav", 1).cast("bigint")


STORED = "u AS (SELECT vec_id AS k, list_transform(embedding, lambda v: CAST(trunc(greatest(-1.0, least(1.0, CAST(v AS DOUBLE))) * 32767) / CAST(32767 AS DOUBLE) AS FLOAT)) AS a FROM embeddings)"


@query(f"""WITH {STORED} SELECT k AS vec_id, CASE WHEN k % 10 <> 0 THEN CAST(len(a) AS BIGINT) END AS n_samples, k % 10 = 0 AS unread,
CASE WHEN k % 10 <> 0 THEN round(list_sum(list_transform(a, lambda v: CAST(v AS DOUBLE))), 6) END AS total FROM u""")
def wav_decode(spark, sf_dir):
    """WAV bytes written and read back; damaged files are rejected by the reader."""
    rows = audio.decode(wav_files(spark, sf_dir), RATE)
    total = F.aggregate("audio", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return rows.select(vec_of("source_path").alias("vec_id"), F.col("n_samples").cast("bigint").alias("n_samples"), F.coalesce(F.col("reject_stage") == "reader", F.lit(False)).alias("unread"), F.round(total, 6).alias("total"))


TAP = "0.75 * CASE WHEN p - b - o = 0 THEN 1 ELSE sin(pi() * 0.75 * (p - b - o)) / (pi() * 0.75 * (p - b - o)) END * (0.5 + 0.5 * cos(pi() * greatest(-1, least(1, (p - b - o) / 32))))"


@query(f"""WITH {STORED}, j AS (SELECT k, a, unnest(range(0, 48)) AS i FROM u WHERE k % 10 <> 0), q AS (SELECT *, i * (CAST(8 AS DOUBLE) / 6) AS p, CAST(floor(i * (CAST(8 AS DOUBLE) / 6)) AS BIGINT) AS b FROM j)
SELECT k AS vec_id, i AS at, round(CAST(CAST(list_sum(list_transform(range(-31, 33), lambda o: CASE WHEN b + o BETWEEN 0 AND 63 THEN CAST(a[b + o + 1] AS DOUBLE) * {TAP} ELSE 0 END))
/ greatest(list_sum(list_transform(range(-31, 33), lambda o: {TAP})), 1e-9) AS FLOAT) AS DOUBLE), 5) AS x FROM q""")
def resample_sinc(spark, sf_dir):
    """Decoding with the windowed-sinc resampler, from 8 to 6 samples a second."""
    rows = audio.decode(wav_files(spark, sf_dir), 6, "sinc").where(active())
    return _posed(rows.withColumn("doc_id", vec_of("source_path")), "vec_id", F.col("audio"), 5)


@query("""WITH t AS (SELECT k, list_transform(range(0, 64), lambda n: cos(2 * pi() * k * n / 2048)) AS c, list_transform(range(0, 64), lambda n: sin(2 * pi() * k * n / 2048)) AS s FROM range(1, 1025) r(k)),
m AS (SELECT vec_id, k, sqrt(list_dot_product(d, c) ** 2 + list_dot_product(d, s) ** 2) AS g FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS d FROM embeddings) CROSS JOIN t),
b AS (SELECT vec_id, (k - 1) // 16 AS band, avg(g) AS g FROM m GROUP BY vec_id, band), w AS (SELECT *, avg(g) OVER (PARTITION BY vec_id) AS mu FROM b)
SELECT vec_id, lpad(lower(to_hex(CAST(sum(CASE WHEN g > mu THEN CAST(1 AS HUGEINT) << CAST(band AS INT) ELSE CAST(0 AS HUGEINT) END) AS HUGEINT))), 16, '0') AS fp FROM w GROUP BY vec_id""")
def spectral_fingerprint(spark, sf_dir):
    """The fused kernel's fingerprint: 64 bands of the spectrum against their mean."""
    rows = analyze(vector_clips(spark, sf_dir), Analysis(vad_min_ratio=None, fingerprint=True, quality=False))
    return rows.select(key("vec_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fp"))


@query("""WITH e AS (SELECT list_transform(range(0, 6), lambda i: 700 * (10 ** (i / CAST(5 AS DOUBLE) * 2595 * log10(1 + 4 / CAST(700 AS DOUBLE)) / 2595) - 1)) AS e),
f AS (SELECT m, list_transform(range(0, 9), lambda k: greatest(0, least((k * 0.5 - e[m + 1]) / (e[m + 2] - e[m + 1]), (e[m + 3] - k * 0.5) / (e[m + 3] - e[m + 2])))) AS f FROM e, range(0, 4) r(m)),
c AS (SELECT vec_id, f AS frame, list_transform(range(0, 16), lambda p: (0.5 - 0.5 * cos(2 * pi() * p / 16)) * CAST(embedding[63 - abs(63 - abs(f * 4 + p - 8)) + 1] AS DOUBLE)) AS x FROM embeddings, range(0, 17) r(f)),
g AS (SELECT vec_id, frame, list_transform(range(0, 9), lambda k: sqrt(list_sum(list_transform(range(0, 16), lambda p: x[p + 1] * cos(2 * pi() * k * p / 16))) ** 2 + list_sum(list_transform(range(0, 16), lambda p: x[p + 1] * sin(2 * pi() * k * p / 16))) ** 2)) AS g FROM c)
SELECT vec_id, frame, m AS mel, round(CAST(CAST(ln(greatest(list_sum(list_transform(range(0, 9), lambda k: g[k + 1] * f.f[k + 1])), 1e-5)) AS FLOAT) AS DOUBLE), 3) AS x, CAST(16 AS BIGINT) AS n_frames FROM g, f""")
def mel_spectrogram(spark, sf_dir):
    """Log-mel frames of training batches, with a short transform for series of 64 samples."""
    rows = models.mel_features(vector_clips(spark, sf_dir), 16, 4, 4).select(key("vec_id"), F.col("mel_length").cast("bigint").alias("n_frames"), F.posexplode("mel").alias("frame", "_mel"))
    rows = rows.select("vec_id", "n_frames", F.col("frame").cast("bigint").alias("frame"), F.posexplode("_mel").alias("mel", "x"))
    return rows.select("vec_id", "n_frames", "frame", F.col("mel").cast("bigint").alias("mel"), F.round(F.col("x").cast("double"), 3).alias("x"))


def closed_sql(a: str, n: int, count: int) -> str:
    """SQL for the list ``a`` of n numbers, interpolated to ``count`` with both ends kept."""
    p = f"CASE WHEN j = {count - 1} THEN {n - 1} ELSE j * (CAST({n - 1} AS DOUBLE) / {count - 1}) END"
    low, high = f"CAST({a}[CAST(floor({p}) AS BIGINT) + 1] AS DOUBLE)", f"CAST({a}[least(CAST(floor({p}) AS BIGINT) + 2, {n})] AS DOUBLE)"
    return f"list_transform(range(0, {count}), lambda j: CAST({low} + ({p} - floor({p})) * ({high} - {low}) AS FLOAT))"


@query(f"""WITH {CLIPS_V}, y AS (SELECT k, {closed_sql("a", 64, 96)} AS y FROM u), z AS (SELECT k, {closed_sql("y", 96, 64)} AS z FROM y)
SELECT k AS vec_id, unnest(range(0, 64)) AS at, round(CAST(unnest(z) AS DOUBLE), 6) AS x FROM z""")
def enhance_identity(spark, sf_dir):
    """Enhancement at the model's own rate (32 to 48 kHz and back) with the model that changes nothing."""
    rows = models.enhance(waveforms.arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 32_000))
    return _posed(rows.where("enhanced"), "vec_id", F.col("audio"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN trim(coalesce(text, '')) ELSE '' END AS transcription, 'table' AS backend FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL")
def transcripts(spark, sf_dir):
    """Texts of a table as transcripts; clips without one get an empty text."""
    texts = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id", "text")
    rows = models.attach_transcripts(conform(doc_clips(spark, sf_dir).drop("transcription")), texts)
    return rows.select("doc_id", "transcription", F.col("transcription_backend").alias("backend"))


# Accounting of families and runs


def fated(spark, sf_dir) -> DataFrame:
    """Documents as clips, three to a source, some rejected, unread or failed."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.expr("doc_id div 3").alias("root_doc_id"))
    return conform(docs.withColumns({
        "error_stage": F.when(n % 11 == 0, "analyze").when(n % 13 == 0, "transcribe"),
        "reject_stage": F.when(n % 17 == 0, "reader").when(n % 5 == 0, "snr"),
    }))


FATED = "d AS (SELECT doc_id, doc_id // 3 AS root, CASE WHEN doc_id % 11 = 0 THEN 'analyze' WHEN doc_id % 13 = 0 THEN 'transcribe' END AS bad, CASE WHEN doc_id % 17 = 0 THEN 'reader' WHEN doc_id % 5 = 0 THEN 'snr' END AS out FROM documents WHERE doc_id IS NOT NULL)"


@query(f"WITH {FATED} SELECT bad AS error_stage, count(DISTINCT root) AS n FROM d WHERE bad IS NOT NULL GROUP BY bad")
def stage_errors(spark, sf_dir):
    return errors_by_stage(fated(spark, sf_dir))


@query(f"WITH {FATED} SELECT doc_id FROM d WHERE bad IS NULL AND out IS NULL AND NOT EXISTS (SELECT 1 FROM d x WHERE x.root = d.root AND x.bad IS NOT NULL)")
def kept_families(spark, sf_dir):
    """Kept clips of sources that had no error in any part."""
    return drop_failed_families(fated(spark, sf_dir)).select("doc_id")


@query(f"WITH {FATED} SELECT root AS doc_id FROM d GROUP BY root HAVING count(bad) = 0 AND count(*) FILTER (WHERE out = 'reader') = 0")
def sources_to_skip(spark, sf_dir):
    """Sources that a checkpoint keeps out of the next run."""
    return finished_sources(fated(spark, sf_dir))


@query(f"WITH {LINES_SQL} SELECT 'p' || pos AS name, t AS text FROM l WHERE pos % 11 <> 0 AND pos % 5 <> 0")
def training_list(spark, sf_dir):
    rows = manifests.parse_strict(manifest_lines(spark, sf_dir))
    return manifests.training_rows(rows.withColumn("path", F.concat(F.lit("wavs/"), "path")))


@query("SELECT 'p' || doc_id AS path FROM documents d WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def manifest_missing_files(spark, sf_dir):
    """Manifest records whose files aren't there."""
    name = F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path")
    return A.missing_files(table(spark, sf_dir, "documents").where("doc_id is not null").select(name), table(spark, sf_dir, "labels").select(name))
