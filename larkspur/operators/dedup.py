"""Near-duplicate clips by spectral fingerprints.

The rule is greedy: in a fixed order, a clip goes if its fingerprint is within ``threshold``
bits of an earlier kept one. It is solved exactly and distributed, over distinct fingerprints
(the earliest clip of each stands for all), in one of two ways with the same result:

* Where blocks of bits tell words apart: candidate pairs by equality of bit blocks, and rounds
  that keep every clip without an undecided earlier neighbour and drop the later neighbours of
  kept clips, with a checkpoint each.
* Where a wide threshold would take more keys a word than there are words to compare it with:
  passes that decide the earliest words in one task, a bounded number of them, and compare all
  later words with those kept. No pairs are listed. ``near_pairs`` compares tiles of words there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import signal as S
from larkspur.operators.aggregates import numbered
from larkspur.operators.stage import active
from larkspur.runtime import attach, cut_lineage, ensure_workers_see_package


def block_masks(threshold: int, agree: int = 2, bits: int = 64) -> list[int]:
    """Masks such that any two words within ``threshold`` bits agree on the whole of at least one.

    ``threshold + agree`` blocks leave at least ``agree`` untouched; a mask takes that many.
    More agreement makes more keys, each more selective.
    """
    n = min(bits, threshold + agree)
    agree = n - threshold
    if agree < 1:
        raise ValueError("the threshold must be under the number of bits")
    edges = [round(i * bits / n) for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(c)) for c in combinations(blocks, agree)]


def best_agreement(n: int, threshold: int, bits: int = 64, most_keys: int = 2000) -> int:
    """How many blocks a mask should take for ``n`` words: the fewest keys and candidate pairs together."""

    def cost(agree: int) -> float:
        return math.comb(threshold + agree, agree) * (1 + n / 2 ** (bits * agree / (threshold + agree)))

    fits = [a for a in range(1, bits - threshold + 1) if math.comb(threshold + a, a) <= most_keys]
    return min(fits or [1], key=cost)


BUCKET = 1000
MOST_KEYS = 2000
#: Rough nanoseconds of a word's key, of a candidate pair of a key, and of a pair of a tile.
KEY_NS, CANDIDATE_NS, PAIR_NS = 1000.0, 12.0, 2.0
#: Words of a tile at most (about), tiles at least if there are words for them, words of such a tile.
TILE, TILES, TILE_LEAST = 1 << 16, 16, 1024
#: Words that a pass decides, comparisons at a time, and windows of ranks that are counted.
PASS, AT_ONCE, WINDOWS = 1 << 16, 1 << 19, 4096


def compares_all(n: int, threshold: int, most_keys: int = MOST_KEYS) -> bool:
    """Whether comparing all of ``n`` words costs less than blocking them."""
    agree = best_agreement(n, threshold, most_keys=most_keys)
    candidates = n / 2 / 2 ** (64 * agree / (threshold + agree))
    return PAIR_NS * n / 2 <= math.comb(threshold + agree, agree) * (KEY_NS + CANDIDATE_NS * candidates)


def _close(left: np.ndarray, right: np.ndarray, threshold: int, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of two arrays within ``threshold`` bits, some pairs at a time; ``own``: of one array with itself, each pair once."""
    at = 0
    while at < len(left):
        some, others = left[at : at + max(1, AT_ONCE // max(1, len(right)))], right[at:] if own else right
        bits = np.bitwise_count(some.view(np.uint64)[:, None] ^ others.view(np.uint64)[None])
        i, j = np.divmod(np.flatnonzero(bits <= threshold), max(1, len(others)))
        if own:
            i, j = i[j > i], j[j > i]
        if len(i):
            yield some[i], others[j]
        at += len(some)


def all_pairs(fps: DataFrame, n: int, threshold: int) -> DataFrame:
    """(a, b) with a < b: of ``n`` distinct values ``fp`` those within ``threshold`` bits, by comparing all of them.

    Words are dealt over tiles, and every two tiles meet in a cell of their own, so that a task
    holds two tiles and each pair comes once.
    """
    ensure_workers_see_package(fps.sparkSession)
    tiles = max(1, math.ceil(n / TILE), min(TILES, n // TILE_LEAST))
    packed = cut_lineage(fps.groupBy(F.pmod(F.xxhash64("fp"), F.lit(tiles)).alias("tile")).agg(F.collect_set("fp").alias("words")))
    cells = packed.select("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other"), "words")
    cells = cells.select(F.least("tile", "other").cast("int").alias("i"), F.greatest("tile", "other").cast("int").alias("j"), "words")
    cells = cells.repartition(min(TILE, tiles * (tiles + 1) // 2), "i", "j").sortWithinPartitions("i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, None
        for batch in batches:
            for i, j, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = x.values.to_numpy(zero_copy_only=False)
                if i != j and at != (i, j):
                    at, first = (i, j), words
                    continue
                for a, b in _close(words if i == j else first, words, threshold, i == j):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return cells.mapInArrow(run, "a bigint, b bigint")


def near_pairs(fps: DataFrame, threshold: int = 8, agree: int | None = None, bucket: int = BUCKET, most_keys: int = MOST_KEYS) -> DataFrame:
    """(a, b) with a < b: distinct values ``fp`` within ``threshold`` bits, complete.

    Without ``agree`` the words are counted and the blocking follows their number, so that
    the candidates of a key stay few as the table grows; where even that costs more than
    comparing all words (see ``compares_all``), they are compared in tiles. Words of a key that still holds more
    than ``bucket`` words (real spectra crowd few keys) are blocked again by one block more:
    both words of a pair in such a key are among them, so none is lost. Blocking ends where
    more blocks would take over ``most_keys`` keys a word.
    """
    if not agree:
        fps = cut_lineage(fps)
        n = fps.count()
        if compares_all(n, threshold, most_keys):
            return all_pairs(fps, n, threshold)
        agree = best_agreement(n, threshold, most_keys=most_keys)
    found = []
    while True:
        masks = F.array(*[F.lit(m).cast("bigint") for m in block_masks(threshold, agree)])
        keyed = fps.select("fp", F.posexplode(masks).alias("slot", "mask")).select("fp", "slot", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        last = threshold + agree >= 64 or math.comb(threshold + agree + 1, agree + 1) > most_keys
        full = None
        if not last:
            full = cut_lineage(keyed.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("slot", "key"))
            full = None if full.isEmpty() else full
        few = keyed if full is None else keyed.join(full, ["slot", "key"], "left_anti")
        left, right = few.withColumnRenamed("fp", "a"), few.withColumnRenamed("fp", "b")
        close = (F.col("a") < F.col("b")) & (S.hamming(F.col("a"), F.col("b")) <= threshold)
        found.append(left.join(right, ["slot", "key"]).where(close).select("a", "b"))
        if full is None:
            return reduce(DataFrame.union, found).distinct()
        fps = cut_lineage(keyed.join(full, ["slot", "key"], "left_semi").select("fp").distinct())
        agree += 1


def _first_kept(nodes: DataFrame, threshold: int) -> DataFrame:
    """(fp, of): the ``at`` of the kept word that each word (fp, at) repeats, its own if it is kept; by passes.

    A pass takes the earliest ``PASS`` undecided words, in windows of ranks. One task decides
    them in order; they are sent to all others, and the undecided words after them that are
    within the threshold of one are decided, by the earliest.
    """
    ensure_workers_see_package(nodes.sparkSession)
    ranked = cut_lineage(numbered(nodes, ["at"], "rank").select("rank", "fp", "at"))
    rest, n, found = ranked.select("rank", "fp"), ranked.count(), []
    window = F.floor(F.col("rank") / math.ceil(max(1, n) / WINDOWS))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ranks, k = np.zeros(1024, np.uint64), np.zeros(1024, np.int64), 0
        for batch in batches:
            rank = batch.column(0).to_numpy()
            of = rank.copy()
            for i, word in enumerate(batch.column(1).to_numpy().view(np.uint64)):
                near = np.bitwise_count(words[:k] ^ word) <= threshold
                at = int(near.argmax()) if k else 0
                if k and near[at]:
                    of[i] = ranks[at]
                    continue
                if k == len(words):
                    words, ranks = np.resize(words, 2 * k), np.resize(ranks, 2 * k)
                words[k], ranks[k], k = word, rank[i], k + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of)], ["rank", "fp", "of"])

    def compare(words: np.ndarray, ranks: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, AT_ONCE // len(words))
            for batch in batches:
                given, of, none = batch.column(1).to_numpy().view(np.uint64), np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, bool)
                for at in range(0, batch.num_rows, step):
                    near = np.bitwise_count(given[at : at + step, None] ^ words[None]) <= threshold
                    first = near.argmax(1)
                    of[at : at + step], none[at : at + step] = ranks[first], ~near[np.arange(len(near)), first]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, mask=none)], ["rank", "fp", "of"])

        return run

    schema = "rank bigint, fp bigint, of bigint"
    while counts := sorted((r.w, r["count"]) for r in rest.groupBy(window.alias("w")).count().collect()):
        end, taken = 0, 0
        while end < len(counts) and (not end or taken + counts[end][1] <= PASS):
            taken, end = taken + counts[end][1], end + 1
        last = window <= counts[end - 1][0]
        part = cut_lineage(rest.where(last).repartition(1).sortWithinPartitions("rank").mapInArrow(decide, schema))
        found.append(part.select("rank", "of"))
        if end == len(counts):
            break
        kept = part.where("rank = of").select("fp", "rank").toArrow().sort_by("rank")  # PASS words at most
        words, ranks = (kept.column(c).to_numpy() for c in ("fp", "rank"))
        rest = cut_lineage(rest.where(~last).mapInArrow(compare(words.view(np.uint64), ranks), schema))
        found.append(rest.where("of is not null").select("rank", "of"))
        rest = rest.where("of is null").select("rank", "fp")
    if not found:
        return nodes.select("fp", F.col("at").alias("of"))
    placed = ranked.join(reduce(DataFrame.union, found), "rank")
    kept = placed.where("rank = of").select(F.col("rank").alias("_rank"), F.col("at").alias("_at"))
    return attach(placed, kept, F.col("of") == F.col("_rank")).select("fp", F.col("_at").alias("of"))


def _by_rounds(nodes: DataFrame, threshold: int, agree: int | None) -> DataFrame:
    """The same as ``_first_kept``, by rounds over the near pairs of words."""
    pairs = near_pairs(nodes.select("fp"), threshold, agree)
    pairs = pairs.join(nodes.toDF("a", "at_a"), "a").join(nodes.toDF("b", "at_b"), "b")
    first = F.col("at_a") < F.col("at_b")
    edges = cut_lineage(pairs.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late"),
        F.least("at_a", "at_b").alias("at"),
    ))
    fate = nodes.select("fp", F.lit(None).cast("boolean").alias("kept"))
    while True:
        open_ = fate.where("kept is null").select("fp")
        if open_.isEmpty():
            break
        live = edges.join(open_.toDF("early"), "early", "left_semi").select(F.col("late").alias("fp")).distinct()
        now = open_.join(live, "fp", "left_anti").select("fp", F.lit(True).alias("now"))
        gone = edges.join(now.select(F.col("fp").alias("early")), "early", "left_semi").select(F.col("late").alias("fp")).distinct()
        fate = fate.join(now, "fp", "left").join(gone.withColumn("gone", F.lit(False)), "fp", "left")
        fate = cut_lineage(fate.select("fp", F.coalesce("kept", "now", "gone").alias("kept")))
    kept = fate.where("kept").select("fp")
    of = edges.join(kept.withColumnRenamed("fp", "early"), "early", "left_semi").groupBy(F.col("late").alias("fp")).agg(F.min("at").alias("of"))
    return nodes.join(of, "fp", "left").select("fp", F.coalesce("of", "at").alias("of"))


def greedy_duplicates(clips: DataFrame, threshold: int = 8, order: tuple[str, ...] = ("source_path", "doc_id"), agree: int | None = None) -> DataFrame:
    """(doc_id, duplicate_of): for every clip (doc_id, fingerprint, order columns) the kept clip it repeats, or null.

    Clips without a fingerprint are kept. Ties in the order go by doc_id.
    """
    key = F.struct(*[F.col(c) for c in order], F.col("doc_id").alias("_id"))
    clips = cut_lineage(clips.select("doc_id", F.col("fingerprint").alias("fp"), key.alias("at")))
    nodes = clips.where("fp is not null").groupBy("fp").agg(F.min("at").alias("at"))
    nodes = cut_lineage(nodes)
    of = _first_kept(nodes, threshold) if not agree and compares_all(nodes.count(), threshold) else _by_rounds(nodes, threshold, agree)
    out = clips.join(of, "fp", "left")
    return out.select("doc_id", F.when(F.col("of._id") != F.col("doc_id"), F.col("of._id")).alias("duplicate_of"))


def deduplicate(df: DataFrame, threshold: int = 8, order: tuple[str, ...] = ("source_path", "doc_id"), agree: int | None = None) -> DataFrame:
    """Reject near-duplicates among active clips; kept ones get ``audio_fingerprint``.

    The order is global, so the result doesn't depend on partitions. Only the duplicates' ids
    come back to the clips, by a counted broadcast.
    """
    live = df.where(active())
    found = greedy_duplicates(live, threshold, order, agree).where("duplicate_of is not null")
    out = attach(df, found.select(F.col("doc_id").alias("_dup"), F.col("duplicate_of").alias("_of")), F.col("doc_id") == F.col("_dup"))
    dup = active() & F.col("_of").isNotNull()
    out = out.withColumns({
        "duplicate_of": F.when(dup, F.col("_of")).otherwise(F.col("duplicate_of")),
        "audio_fingerprint": F.when(active() & ~dup & F.col("fingerprint").isNotNull(), S.fingerprint_hash(F.col("fingerprint"))).otherwise(F.col("audio_fingerprint")),
        "reject_reason": F.when(dup, F.lit("near_duplicate")).otherwise(F.col("reject_reason")),
        "reject_stage": F.when(dup, F.lit("dedup")).otherwise(F.col("reject_stage")),
    })
    return out.select(*df.columns)
