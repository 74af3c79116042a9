"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints link at two or fewer differing bits. A fingerprint is cut into two segments of
32 bits (fewer than the three an exact-segment index needs), so of a linked pair at least
one segment differs by at most one bit. Every segment is indexed under its 32 variants with
one bit deleted (a wildcard); two segments with at most one differing bit share a variant.
Variants are grouped by equality and the pairs of a bucket verified on all 64 bits.

Only distinct fingerprints are indexed, so exact copies cost nothing. A bucket of up to
``BUCKET`` fingerprints is joined with itself; the fingerprints of a larger one are indexed
once more under all 2016 variants with two bits deleted, where equality alone proves a link
and a bucket has at most four members. Nothing is dropped, and no bucket yields a number of
pairs that grows with the square of an unbounded size. A pair that meets in several buckets
is reported only by the first of them.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_texts
from larkspur.llm.shared import HOT_ROWS, cut_lineage, fresh, join_hot, without

SEED = 42
SHINGLE = 3
BUCKET = 64
BLOCK = 1 << 16
LOW = 0xFFFFFFFF


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The SimHash of a whole text as a signed 64-bit number; 0 for a text without words."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z only
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = [b" ".join(s) for s in zip(*(found[i:] for i in range(words)))]
    n, ones = len(shingles), np.zeros(64, dtype=np.int64)
    for start in range(0, n, BLOCK):
        part = shingles[start : start + BLOCK]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), dtype=np.uint64, count=len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_cols: list[str], text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """(ids, fp long) of every whole text; null and empty texts have fingerprint zero."""

    def kernel():
        return lambda texts: {"fp": [fingerprint(t, words) for t in texts]}

    return map_texts(df, id_cols, text_col, kernel, [("fp", "bigint")])


def _variants(fps: DataFrame) -> DataFrame:
    """(fp, key): 64 one-wildcard segment variants of each fingerprint; key = slot << 32 | segment."""
    made = F.expr(
        f"transform(sequence(0, 63), p -> shiftleft(cast(p as bigint), 32) | "
        f"(if(p < 32, fp & {LOW}L, shiftrightunsigned(fp, 32)) & ~shiftleft(1L, p % 32)))"
    )
    return fps.select("fp", F.explode(made).alias("key"))


def _first_slot(a: Column, b: Column) -> Column:
    """The first slot in which a pair with a variant in common meets."""
    x = a.bitwiseXOR(b)
    low, high = x.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(x, 32)
    upper = F.when(high == 0, F.lit(32)).otherwise(F.bit_count(high - 1) + 32)
    return F.when(low == 0, F.lit(0)).when(F.bit_count(low) == 1, F.bit_count(low - 1)).otherwise(upper)


def _linked(a: Column, b: Column, slot: Column, bits: int) -> Column:
    return (F.bit_count(a.bitwiseXOR(b)) <= bits) & (_first_slot(a, b) == slot)


def links(fps: DataFrame, bucket: int = BUCKET, bits: int = 2) -> DataFrame:
    """(a, b) pairs of distinct fingerprints ``fp`` that share a variant and differ in at most ``bits`` bits.

    At two bits complete for connectivity: every link appears, except that within a group of at most
    four fingerprints that agree on 62 bits (all linked to one another) links go to the smallest.
    More than three bits may differ in both segments, and pairs beyond two bits in buckets over
    ``bucket`` aren't made, so such a caller needs another way for the rest.
    """
    # Dealt anew, since a few small partitions of numbers become 64 times as many rows.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Variants move once: their counts and the join with them read the same exchange. A key is of one slot of 64, so it
    # has at most a 64th of these rows, and almost all have one, which nothing could aggregate before the exchange.
    variants = _variants(fps.repartition(parts, "fp")).where("key is not null").repartition("key")
    groups = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.bit_xor("fp").alias("all"))
    # Of two or three fingerprints the smallest stands for the group.
    met = cut_lineage(variants.join(groups.where("n > 1"), "key").where("n > 3 or fp = lo"))
    slot = F.shiftrightunsigned("key", 32)
    few = met.where("n <= 3").select("key", "n", "lo", "hi", F.expr("`all` ^ lo ^ hi").alias("mid"))
    pairs = F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("lo", "hi"), ("lo", "mid"), ("mid", "hi"))])
    few = few.select("key", F.explode(F.when(F.col("n") == 2, F.slice(pairs, 1, 1)).otherwise(pairs)).alias("p"))
    few = few.where(_linked(F.col("p.a"), F.col("p.b"), slot, bits)).select("p.a", "p.b")

    members = met.where("n > 3").select("key", "fp", "n")
    some = members.where(F.col("n") <= bucket)
    left, right = some.select("key", F.col("fp").alias("a")), some.select(F.col("key").alias("key2"), F.col("fp").alias("b"))
    on = (F.col("key") == F.col("key2")) & (F.col("a") < F.col("b")) & _linked(F.col("a"), F.col("b"), slot, bits)
    some = left.join(right, on).select("a", "b")

    dense = members.where(F.col("n") > bucket).select("fp").distinct()
    deleted = F.expr(
        "flatten(transform(sequence(0, 62), p -> transform(sequence(p + 1, 63), q -> "
        "named_struct('s', p * 64 + q, 'v', fp & ~shiftleft(1L, p) & ~shiftleft(1L, q)))))"
    )
    dense = dense.select("fp", F.explode(deleted).alias("k")).groupBy("k.s", "k.v")
    dense = dense.agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    dense = dense.select("a", F.explode("fps").alias("b")).where("a <> b").distinct()
    return few.unionByName(some).unionByName(dense)


def connected(edges: DataFrame, least: int = HOT_ROWS) -> DataFrame:
    """(node, label): the smallest node of each node's component, for every node of ``edges`` (a, b).

    Minimum labels over neighbours plus pointer jumping, one checkpoint a round, until no label
    changes; the number of rounds grows with the logarithm of a component's diameter. Hubs and
    the labels of large components are hot keys of these joins (see ``join_hot``). Repeated
    edges and edges both ways count once; without edges there are no nodes.
    """
    ways = F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in (("a", "b"), ("b", "a"))])
    both = cut_lineage(edges.select(F.explode(ways).alias("e")).select("e.u", "e.v").distinct())
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    few = both.count() <= least  # then no key is hot, and a round is one plan
    while True:
        near = join_hot(both, labels.withColumnRenamed("node", "v"), "v", least=least, few=few).groupBy("u").agg(F.min("label").alias("m"))
        new = labels.join(near, labels.node == near.u).select("node", F.least("label", "m").alias("at"), F.col("label").alias("old"))
        new = new if few else cut_lineage(new)
        new = join_hot(new, labels.toDF("at", "above"), "at", least=least, few=few).select("node", F.least("at", "above").alias("label"), "old")
        new = cut_lineage(new)
        done = new.where("label <> old").isEmpty()
        labels = new.select("node", "label")
        if done:
            return labels


def components(fps: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fp, component): the smallest id in the component of each distinct fingerprint.

    Null ids are passed over unless a component has no others; an empty table has no components.
    """
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min(id_col).alias("rep")))
    roots = connected(links(nodes.select("fp")))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "rep", F.coalesce("label", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    if nodes.count() <= HOT_ROWS:
        return named.join(least, "root").select("fp", "component")
    return cut_lineage(join_hot(cut_lineage(named), cut_lineage(least), "root").select("fp", "component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): one row per input row.

    ``fingerprint`` has 16 hexadecimal digits; ``component_id`` is the smallest id reachable
    over links, itself included. Null, empty and word-less texts have fingerprint zero and
    link like any other; rows with a null id take part but never name a component (a component
    of such rows only has a null id); repeated rows come back as often; an empty table gives
    an empty table; other columns are ignored.
    """
    fps = cut_lineage(fingerprints(df, [id_col], text_col))
    found = components(fps, id_col)
    out = join_hot(fps, found, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
    return out


def keyed_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, t): rows by id and a hash of the text."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"), F.col(f"`{text_col}`").alias("t"))


def keep_first(df: DataFrame, fps: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose key names its component; ``fps`` is (key, fp), ``found`` (fp, component), both checkpointed."""
    rest = join_hot(fps, found, "fp").where(~F.col("key").eqNullSafe(F.col("component"))).select("key.*")
    of, id_of = fresh(df, "_hash"), fresh(df, "_id")
    marked = df.withColumns({of: F.xxhash64(F.col(f"`{text_col}`")), id_of: F.col(f"`{id_col}`")})
    marked = without(marked, rest.toDF(id_of, of), [id_of, of])
    if not fps.groupBy("key").count().where("count > 1").isEmpty():
        marked = marked.dropDuplicates([id_of, of])
    return marked.drop(id_of, of)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked texts: the one with the smallest id, all columns as they were.

    Rows are told apart by id and a hash of the text, so rows that share an id but not the text
    are judged apart; of wholly repeated rows one stays. Null, empty and word-less texts
    form one group. Null ids come before all others.
    """
    fps = fingerprints(keyed_texts(df, id_col, text_col), ["id", "hash"], "t").select(F.struct("id", "hash").alias("key"), "fp")
    fps = cut_lineage(fps)
    return keep_first(df, fps, components(fps, "key"), id_col, text_col)
