"""Deterministic identities of clips, segments and turns, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(text: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of a string's UTF-8."""
    return F.substring(F.sha2(text.cast("string").cast("binary"), 256), 1, 16)


def plain_path(uri: Column) -> Column:
    """A file URI as the plain path that a local listing would give; other URIs stay."""
    bare = F.regexp_replace(uri, r"^file:/+", "/")
    return F.when(uri.startswith("file:"), F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))).otherwise(uri)


def source_id(path: Column) -> Column:
    return short_hash(path)


def segment_id(parent: Column, start: Column, end: Column) -> Column:
    """Id of the part [start, end) of a clip, in samples."""
    return short_hash(F.concat_ws(":", parent, start.cast("bigint"), end.cast("bigint")))


def turn_id(parent: Column, speaker: Column, start: Column, end: Column) -> Column:
    """Id of a speaker's turn, bounds in seconds cut to milliseconds."""
    ms = [(x.cast("double") * 1000).cast("bigint").cast("string") for x in (start, end)]
    return F.concat(parent, F.lit("__"), speaker, F.lit("__"), ms[0], F.lit("_"), ms[1])
