"""Near-duplicates by SimHash deletion variants, verified on shingles, and an exact set-similarity join for the rest.

Two texts link if the sets of their five-word shingles have a Jaccard similarity of 0.8 or
more. First the method of :mod:`larkspur.llm.simhash`, on fingerprints of five-word shingles:
texts of one fingerprint, and those whose fingerprints share a one-wildcard variant of a segment
and differ in at most ``BITS`` bits, are candidates, verified on the whole sets. At a similarity of 0.8
fingerprints differ in about ten bits, more or fewer by chance, so no radius that can be indexed
covers all such pairs. Prefixes find the rest: with the shingles of all
texts in one order, a linked pair shares one of the first ``n - ceil(0.8 n) + 1`` shingles
of each text. Texts that share one are a bucket; sizes and places bound the overlap that
is still possible, bitmaps of the sets bound it closer, and pairs are verified on the whole sets. A bucket's leader meets all its
members first, together with the candidates of the fingerprints; after that only members of different components meet, so that a large group of
near copies makes pairs in proportion to its size. Nothing is dropped.

The order puts shingles that are frequent in a sample of texts last. The sample decides how
many candidates there are, never which pairs link. Equal sets are one node.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm import simhash
from larkspur.llm.common import map_texts
from larkspur.llm.shared import BROADCAST_ROWS, cut_lineage, delete, join_hot, written
from larkspur.llm.simhash import SEED, connected, fingerprint, keep_first, keyed_texts

SHINGLE = 5
SHARE = (4, 5)
BITS = 16
SAMPLE_TEXTS = 16_000
COMMON = 300_000


def shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a whole text, ascending; a shorter text is one shingle."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z only
    if not found:
        return np.zeros(0, dtype=np.int64)
    parts = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64).view(np.int64))


def common_shingles(keyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of the shingles that are most frequent in a sample of texts."""
    step = max(1, keyed.count() // SAMPLE_TEXTS)
    some = keyed.where(F.pmod(F.xxhash64("id", "hash"), F.lit(step)) == 0)

    def kernel():
        return lambda texts: {"s": [shingles(t).tolist() for t in texts]}

    counts = map_texts(some, ["hash"], "t", kernel, [("s", "array<bigint>")]).dropDuplicates(["hash"])
    counts = counts.select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.where("n > 1").orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    found, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("s", "n"))
    order = np.argsort(found)
    return found[order], n[order]


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set that a linked set must share one of, in the common order."""
    rank = np.zeros(found.size, dtype=np.int64)
    if common.size and found.size:
        at = np.minimum(np.searchsorted(common, found), common.size - 1)
        rank = np.where(common[at] == found, counts[at], 0)
    most = found.size - -(-found.size * SHARE[0] // SHARE[1]) + 1
    return found[np.lexsort((found, rank))][:most]


def bitmap(found: np.ndarray) -> np.ndarray:
    """A set as a bitmap of four bits a member or more, a power of two, so that halves of it can be laid over one another."""
    size = 1 << max(6, int(4 * found.size - 1).bit_length())
    flags = np.zeros(size, dtype=bool)
    flags[found & (size - 1)] = True
    return np.packbits(flags, bitorder="little").view(np.int64)


def shingle_sets(keyed: DataFrame) -> DataFrame:
    """(id, hash, row, node, size, prefix, bits, fp) of every row; node names the set, row the row, fp is the SimHash."""
    import xxhash

    common, counts = common_shingles(keyed)

    def kernel():
        def apply(texts: list) -> dict:
            found = [shingles(t) for t in texts]
            nodes = np.array([xxhash.xxh64_intdigest(f.tobytes()) for f in found], dtype=np.uint64).view(np.int64)
            return {
                "node": nodes.tolist(), "size": [f.size for f in found], "prefix": [prefix(f, common, counts).tolist() for f in found],
                "bits": [bitmap(f).tolist() for f in found], "fp": [fingerprint(t, SHINGLE) for t in texts],
            }

        return apply

    fields = [("node", "bigint"), ("size", "bigint"), ("prefix", "array<bigint>"), ("bits", "array<bigint>"), ("fp", "bigint")]
    return map_texts(keyed, ["id", "hash"], "t", kernel, fields).withColumn("row", F.monotonically_increasing_id())


def one_each(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The row of ``sets`` that stands for each node; nodes are narrow, so up to a bound the sets don't move."""
    rows = nodes.select(F.col("rep.row").alias("row"))
    return sets.join(F.broadcast(rows) if nodes.count() <= BROADCAST_ROWS else rows, "row", "left_semi")


def simhash_pairs(own: DataFrame) -> DataFrame:
    """The (a, b) pairs that fingerprints propose, at most two a node: large groups of near copies make no more.

    The first node of a fingerprint meets its others, and that of the nearest of the smaller linked
    fingerprints. What this leaves apart is found by prefixes.
    """
    held = cut_lineage(own.where("size > 0").select("node", "fp"))
    lead = cut_lineage(held.groupBy("fp").agg(F.min("node").alias("first")))
    same = join_hot(held, lead, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = simhash.links(lead.select("fp"), bits=BITS)
    near = near.groupBy("b").agg(F.min(F.struct(F.expr("bit_count(a ^ b)"), "a")).alias("l")).select("l.a", "b")
    near = near.join(lead.toDF("a", "x"), "a").join(lead.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return _ordered(same.union(near))


def members(own: DataFrame) -> DataFrame:
    """(s, node, size, at): the prefix shingles that several nodes have; all others prove that nothing links there.

    The rows move once, whatever the size; a shingle is in the prefixes of few texts, since frequent ones come last.
    """
    held = own.where("size > 0").select(F.posexplode("prefix").alias("at", "s"), "node", "size").select("s", "node", "size", "at")
    n = F.count(F.lit(1)).over(Window.partitionBy("s"))
    return cut_lineage(held.withColumn("n", n).where("n > 1").drop("n"))


def possible(m: str, p: str, n: str, q: str) -> Column:
    """Whether sets of sizes m and n that first agree at places p and q of their order can be alike enough."""
    near = F.least(m, n) * SHARE[1] >= F.greatest(m, n) * SHARE[0]
    return near & (F.least(F.col(m) - F.col(p), F.col(n) - F.col(q)) * (SHARE[0] + SHARE[1]) >= (F.col(m) + F.col(n)) * SHARE[0])


def _ordered(pairs: DataFrame) -> DataFrame:
    return cut_lineage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def leader_pairs(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s, leader) of each bucket of members, and the (a, b) pairs of a leader and a member that may link.

    The leader has its shingle at the earliest place, so the fewest rare shingles before it: of
    a group of near copies, the text that was changed least and is nearest to all others.
    """
    lead = cut_lineage(held.groupBy("s").agg(F.min(F.struct("at", "node", "size")).alias("l")))
    both = join_hot(held, lead.select("s", F.col("l.node").alias("b"), F.col("l.size").alias("n"), F.col("l.at").alias("q")), "s")
    pairs = both.where((F.col("node") != F.col("b")) & possible("size", "at", "n", "q")).select(F.col("node").alias("a"), "b")
    return lead.select("s", F.col("l.node").alias("leader")), _ordered(pairs)


def other_pairs(held: DataFrame, leaders: DataFrame, roots: DataFrame, tested: DataFrame) -> DataFrame:
    """The (a, b) pairs without a leader that may link two components of ``roots`` (node, label).

    In each bucket the members of its largest component meet those of all others only, so a
    group that is connected already makes no pairs, whatever its size.
    """
    rest = join_hot(held, leaders, "s").where("node <> leader").select("s", "node", "size", "at")
    rest = rest.join(roots, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = cut_lineage(rest)
    top = rest.groupBy("s", "label").agg(F.count(F.lit(1)).alias("c"))
    top = top.groupBy("s").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "label")).alias("m")).where("parts > 1")
    rest = cut_lineage(join_hot(rest, cut_lineage(top.select("s", F.col("m.label").alias("major"))), "s"))
    left = rest.where("label <> major").select("s", F.col("node").alias("a"), F.col("size").alias("m"), F.col("at").alias("p"), F.col("label").alias("la"))
    right = rest.select(
        F.col("s").alias("s2"), F.col("node").alias("b"), F.col("size").alias("n"), F.col("at").alias("q"), F.col("label").alias("lb"), "major"
    )
    once = (F.col("lb") == F.col("major")) | (F.col("a") < F.col("b"))
    pairs = left.join(right, (F.col("s") == F.col("s2")) & (F.col("la") != F.col("lb")) & once & possible("m", "p", "n", "q"))
    return cut_lineage(_ordered(pairs).join(tested, ["a", "b"], "left_anti"))


def compatible(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) pairs whose bitmaps allow a similarity of 0.8: bits of one set that the other lacks are members it lacks."""

    def shorter(z: str, than: str) -> Column:
        half = F.floor(F.size(z) / 2).cast("int")
        folded = F.zip_with(F.slice(z, F.lit(1), half), F.slice(z, half + 1, half), lambda u, v: u.bitwiseOR(v))
        return F.when(F.size(z) > F.size(than), folded).otherwise(F.col(z))

    def lacking(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda n, c: n + c)

    held = own.select("node", "size", "bits")
    both = pairs.join(held.toDF("b", "n", "y"), "b").join(held.toDF("a", "m", "x"), "a")
    both = both.select("a", "b", "m", "n", shorter("x", "y").alias("x"), shorter("y", "x").alias("y"))
    most = F.least(F.col("m") - lacking("x", "y"), F.col("n") - lacking("y", "x"))
    return cut_lineage(both.where(most * (SHARE[0] + SHARE[1]) >= (F.col("m") + F.col("n")) * SHARE[0]).select("a", "b"))


def verified(keyed: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) pairs whose whole sets have a similarity of 0.8 or more; a set is made once, and moves once for each pair."""
    wants = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wants = cut_lineage(nodes.join(wants, "node").select("node", F.col("rep.id").alias("rid"), F.col("rep.hash").alias("rhash")))
    n = wants.count()
    texts = keyed.join(F.broadcast(wants) if n <= BROADCAST_ROWS else wants, keyed.id.eqNullSafe(wants.rid) & (keyed.hash == wants.rhash))

    def kernel():
        return lambda texts: {"s": [shingles(t).tolist() for t in texts]}

    sets = cut_lineage(map_texts(texts, ["node"], "t", kernel, [("s", "array<bigint>")]))
    if sets.count() > n:  # rows that are repeated
        sets = cut_lineage(sets.dropDuplicates(["node"]))
    same = F.size(F.array_intersect("x", "y")) * (SHARE[0] + SHARE[1]) >= (F.size("x") + F.size("y")) * SHARE[0]
    both = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    return cut_lineage(both.where(same).select("a", "b"))


def links(keyed: DataFrame, nodes: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b) links of the nodes (node, rep) with the sets ``own`` (node, size, prefix, bits, fp), complete for connectivity.

    Pairs that fingerprints propose and pairs of each prefix bucket's leader with the bucket are verified first.
    Pairs within a component that these connect need no more; all pairs between components are verified.
    """
    near, path = written(simhash_pairs(own), "simhash-pairs")  # Spark estimates its size by the files; estimates multiply over joins
    held = members(own)
    leaders, pairs = leader_pairs(held)
    pairs = cut_lineage(near.union(pairs).distinct())
    first = verified(keyed, nodes, compatible(own, pairs))
    found = first.union(verified(keyed, nodes, compatible(own, other_pairs(held, leaders, connected(first), pairs))))
    delete(keyed.sparkSession, path)
    return found


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked texts: the one with the smallest id, all columns as they were.

    Rows are told apart and edge cases judged as in :func:`larkspur.llm.simhash.drop_near_duplicates`.
    """
    keyed = keyed_texts(df, id_col, text_col)
    sets = cut_lineage(shingle_sets(keyed))
    nodes = cut_lineage(sets.groupBy("node").agg(F.min(F.struct("id", "hash", "row")).alias("rep")))
    roots = connected(links(keyed, nodes, one_each(sets, nodes)))
    named = cut_lineage(nodes.join(roots, "node", "left").select("node", F.struct("rep.id", "rep.hash").alias("rep"), F.coalesce("label", "node").alias("root")))
    least = cut_lineage(named.groupBy("root").agg(F.min("rep").alias("component")))
    found = cut_lineage(join_hot(named, least, "root").select(F.col("node").alias("fp"), "component"))
    return keep_first(df, sets.select(F.struct("id", "hash").alias("key"), F.col("node").alias("fp")), found, id_col, text_col)
