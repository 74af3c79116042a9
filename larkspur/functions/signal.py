"""Signal mathematics on array columns, entirely in the JVM.

These are the forms for waveforms of moderate length (derived series, features, tests) and
for SQL; decoded audio goes through the fused Arrow kernel in ``operators.analyze``, which
gives the same results. Folds run in double precision.

Every function treats a null array as null and an empty one as defined in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int>>"
SILENT = 1e-4
LEAST_SHARE = 0.1
CAP_DB = 40.0


def no_spans() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    The optimiser copies an expression to every place that refers to it, also into lambdas,
    which would compute it anew for each element; a lambda's own variable stays a variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cut(array: Column, start: Column, end: Column) -> Column:
    """array[start:end], 0-based and clamped on both sides."""
    n = F.size(array)
    low = F.greatest(F.lit(0), F.least(start, n))
    return F.slice(array, low + 1, F.greatest(F.lit(0), F.least(end, n) - low))


def energy(array: Column) -> Column:
    """Sum of squares; 0 for an empty array."""
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def _upto(n: Column) -> Column:
    """0 .. n-1 as an array, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def frame_energies(audio: Column, frame: int = 512, partial: bool = True) -> Column:
    """Mean square of each frame; the shorter last frame counts if ``partial``. No frame: empty."""

    def of(x: Column) -> Column:
        n = F.size(x)
        whole = F.ceil(n / frame) if partial else F.floor(n / frame)
        return F.transform(_upto(whole.cast("int")), lambda i: energy(F.slice(x, i * frame + 1, frame)) / F.least(F.lit(frame), n - i * frame))

    return let(audio, of)


def mean(values: Column) -> Column:
    """Arithmetic mean, null for an empty array."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x), F.size(values))


def deviation(values: Column, center: Column) -> Column:
    """Population standard deviation about a known mean, null for an empty array."""
    squares = let(center, lambda c: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - c) * (x - c)))
    return F.sqrt(F.try_divide(squares, F.size(values)))


def hit_frames(energies: Column, center: Column, spread: Column) -> Column:
    """Frames louder than mean plus deviation; none if all is quiet or under a tenth are louder."""
    none = F.array().cast("array<int>")
    louder = let(center + spread, lambda least: F.filter(_upto(F.size(energies)), lambda i: F.get(energies, i) > least))
    return F.when(center >= SILENT, let(louder, lambda hits: F.when(F.size(hits) >= LEAST_SHARE * F.size(energies), hits).otherwise(none))).otherwise(none)


def energy_spans(audio: Column, frame: int = 512) -> Column:
    """Speech spans of a clip by frame energies, one for each loud frame; empty for null audio."""

    def spans(x: Column) -> Column:
        found = lambda e: let(mean(e), lambda m: let(deviation(e, m), lambda d: hit_frames(e, m, d)))
        return frame_spans(let(frame_energies(x, frame), found), F.size(x), frame)

    return F.coalesce(let(audio, spans), no_spans())


def frame_spans(hits: Column, n: Column, frame: int = 512) -> Column:
    """One span [start, end) for each frame number, the last one cut at ``n``."""
    return F.transform(hits, lambda i: F.struct((i * frame).alias("start"), F.least((i + 1) * frame, n).alias("end")))


def merge_spans(spans: Column, n: Column) -> Column:
    """Clamp to [0, n], drop empty spans, sort by start and join overlapping or touching ones."""
    inside = F.transform(spans, lambda s: F.struct(F.greatest(F.lit(0), F.least(s["start"], n)).alias("start"), F.greatest(F.lit(0), F.least(s["end"], n)).alias("end")))
    ordered = F.array_sort(F.filter(inside, lambda s: s["end"] > s["start"]))

    def add(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), F.concat(F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1)), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, no_spans(), add)


def gaps(merged: Column, n: Column) -> Column:
    """The parts of [0, n) outside merged spans."""
    edges = F.transform(_upto(F.size(merged) + 1), lambda i: F.struct(
        F.coalesce(F.get(merged, i - 1)["end"], F.lit(0)).alias("start"), F.coalesce(F.get(merged, i)["start"], n).alias("end")))
    return F.filter(edges, lambda s: s["end"] > s["start"])


def spans_length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda acc, s: acc + (s["end"] - s["start"]))


def spans_energy(audio: Column, spans: Column) -> Column:
    """Sum of squares within spans."""
    return F.aggregate(spans, F.lit(0.0), lambda acc, s: acc + energy(F.slice(audio, s["start"] + 1, s["end"] - s["start"])))


def decibels(signal: Column, noise: Column) -> Column:
    """10 log10(signal / (noise + 1e-10)); minus infinity for no signal, null for unknown powers."""
    return let(signal, lambda s: F.when(s == 0, F.lit(float("-inf"))).otherwise(10 * F.log10(s / (noise + 1e-10))))


def speech_ratio(spans: Column, n: Column) -> Column:
    """Share of samples in spans (overlaps count twice); 0 without spans or samples."""
    return F.coalesce(F.try_divide(spans_length(spans), n), F.lit(0.0))


def quartile_snr(energies: Column, threshold: Column) -> Column:
    """Ratio of mean energies of frames at or above a threshold and below it; null if either side is empty."""

    def ratio(e: Column, t: Column) -> Column:
        loud, quiet = F.filter(e, lambda x: x >= t), F.filter(e, lambda x: x < t)
        return let(loud, lambda a: let(quiet, lambda b: F.when((F.size(a) > 0) & (F.size(b) > 0), decibels(mean(a), mean(b)))))

    return let(energies, lambda e: let(threshold, lambda t: ratio(e, t)))


def span_snr(audio: Column, merged: Column, rate: Column) -> Column:
    """Decibels of merged spans against the rest of a clip; the cap for too little or silent rest."""

    def ratio(x: Column, spans: Column) -> Column:
        n, inside = F.size(x), spans_length(spans)
        noise = F.try_divide(spans_energy(x, gaps(spans, n)), n - inside)
        speech = F.coalesce(F.try_divide(spans_energy(x, spans), inside), F.lit(0.0))
        return F.when(n - inside < 0.1 * rate, F.lit(CAP_DB)).otherwise(let(noise, lambda p: F.when(p == 0, F.lit(CAP_DB)).otherwise(decibels(speech, p))))

    return let(audio, lambda x: let(merged, lambda spans: ratio(x, spans)))


def quantile(values: Column, q: float) -> Column:
    """Linearly interpolated quantile of an array, null for an empty one."""

    def place(ordered: Column) -> Column:
        at = (F.size(ordered) - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        return F.get(ordered, low) + (at - low) * (F.coalesce(F.get(ordered, low + 1), F.get(ordered, low)) - F.get(ordered, low))

    return let(F.array_sort(values), place)


def downmix(interleaved: Column, channels: int) -> Column:
    """Mean over the channels of interleaved samples; an unfinished last group is left out."""
    n = F.floor(F.size(interleaved) / channels).cast("int")
    return F.transform(_upto(n), lambda i: F.aggregate(F.slice(interleaved, i * channels + 1, channels), F.lit(0.0), lambda a, x: a + x.cast("double")) / channels)


def resample_linear(audio: Column, source_rate: int, target_rate: int) -> Column:
    """Linear interpolation at len * target / source evenly spaced places; ends are held."""
    if source_rate == target_rate:
        return audio

    def of(x: Column, count: Column) -> Column:
        def at(place: Column) -> Column:
            low = F.floor(place).cast("int")
            left, right = F.get(x, low).cast("double"), F.coalesce(F.get(x, low + 1), F.get(x, low)).cast("double")
            return left + (place - low) * (right - left)

        return F.transform(F.transform(_upto(count), lambda i: i * F.size(x).cast("double") / count), at)

    return let(audio, lambda x: let(F.floor(F.size(x) * F.lit(target_rate) / source_rate).cast("int"), lambda count: of(x, count)))


def pcm16(audio: Column) -> Column:
    """Samples clipped to [-1, 1], scaled by 32767 and cut to 16-bit integers."""
    return F.transform(audio, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767).cast("smallint"))


def peak(audio: Column) -> Column:
    """Largest absolute sample, 0 for no samples."""
    return F.coalesce(F.array_max(F.transform(audio, lambda x: F.abs(x.cast("double")))), F.lit(0.0))


def is_clipped(audio: Column) -> Column:
    return peak(audio) >= 0.999


def is_silent(audio: Column) -> Column:
    """Fewer than one sample in a hundred above 1e-4; an empty clip isn't silent."""
    loud = F.size(F.filter(audio, lambda x: F.abs(x.cast("double")) > SILENT))
    return (F.size(audio) > 0) & (loud < 0.01 * F.size(audio))


def band_fingerprint(bands: Column) -> Column:
    """64 bands as a bigint: bit i is set if band i exceeds the mean of all bands."""
    center = lambda b: mean(F.transform(b, lambda x: x.cast("double")))
    above = lambda b, c: F.transform(b, lambda x: F.when(x.cast("double") > c, F.expr("1L")).otherwise(F.expr("0L")))
    bits = let(bands, lambda b: let(center(b), lambda c: above(b, c)))
    places = F.transform(bits, lambda b, i: F.call_function("shiftleft", b, i))
    return F.aggregate(places, F.expr("0L"), lambda acc, b: acc.bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint_hash(fp: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the fingerprint's eight little-endian bytes."""
    big = F.lpad(F.hex(fp), 16, "0")
    little = F.concat(*[F.substring(big, 15 - 2 * i, 2) for i in range(8)])
    return F.substring(F.sha2(F.unhex(little), 256), 1, 16)
