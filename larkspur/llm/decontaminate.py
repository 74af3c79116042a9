"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed takes the words at a mask's selected positions and ignores the others, so a passage
with replaced words still shares seeds with its original. The two masks together hit every
placement of one substitution in five over windows of 10 and 15 words (checked
exhaustively in the tests), and longer windows all the more.

Seeds of all positions of all documents are joined with the seeds of the benchmark; around
each hit a window of the item is laid over the document and the words that agree are
counted. A document overlaps an item if at least 0.8 of the window agree. The window has 50
words, or all of a shorter item, and contains the hit.

The documents never shuffle: scan, explosion, seeds, broadcast join and the cutting of
windows run in one generated stage that refers to each row's word array without copying it,
and only the distinct windows around hits leave it. The benchmark is the stated query set;
it is broadcast in blocks of a measured size, one pass over the documents for each block, so
its size is never assumed. Seeds are a few numbers each; the items' words are broadcast once
a block, apart from them, and meet the windows after these were made distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import spread
from larkspur.llm.shared import fresh, without

MASKS = ((0, 5, 6, 7), (0, 1, 3, 4))
WINDOW = 50
SHARE = 0.8
LEAST_WORDS = 8
BLOCK_WORDS = 400_000
GAP = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; null and empty texts have one empty word at most."""
    return F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), GAP)


def _seed(words: Column, at: Column, mask: tuple[int, ...], number: int) -> Column:
    """The hash of a mask's words from a position on; null if the mask reaches past the end."""
    parts = [F.get(words, at + p) for p in mask]
    return F.when(at + mask[-1] < F.size(words), F.xxhash64(F.lit(number), *parts))


def _seeded(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each position and mask of the word array ``w``: kept columns, w, at, seed."""
    at = df.select(*keep, "w", F.posexplode("w").alias("at", "_word"))
    seeds = F.array(*[_seed(F.col("w"), F.col("at"), m, i) for i, m in enumerate(MASKS)])
    return at.select(*keep, "w", "at", F.explode(seeds).alias("seed")).where("seed is not null")


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, w): the word arrays of items long enough to prove anything; others are left out."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), words_of(F.col(f"`{text_col}`")).alias("w"))
    items = items.select("item", F.filter("w", lambda x: x != "").alias("w")).where(F.size("w") >= LEAST_WORDS)
    return items.distinct()


def blocks(items: DataFrame, limit: int = BLOCK_WORDS) -> list[DataFrame]:
    """The items in blocks whose words stay near ``limit``; dealt by hash, so by size on average."""
    total = items.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(total) // limit))
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("w"), F.lit(n)) == i) for i in range(n)]


def _overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text: str = "text",
    share: float = SHARE, window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``overlaps`` as (id, item, overlap, n_hits)."""
    lines = spread(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))).select("id", words_of(F.col("t")).alias("w"))
    lines = _seeded(lines, ["id"])
    found = []
    for block in blocks(benchmark_items(benchmark, item_col, item_text), block_words):
        block = block.withColumn("of", F.xxhash64("w"))
        size = F.least(F.size("w"), F.lit(window))
        first = F.greatest(F.lit(0), F.least(F.col("at") - F.expr(f"({window} - 8) div 2").cast("int"), F.size("w") - size))
        seeds = _seeded(block, ["item", "of"]).select(
            "item", "of", first.alias("first"), size.alias("size"), (F.col("at") - first).alias("back"), F.col("seed").alias("iseed")
        )
        hits = lines.join(F.broadcast(seeds), F.col("seed") == F.col("iseed"))
        start = F.col("at") - F.col("back")
        lead = F.greatest(F.lit(0), -start)
        hits = hits.select(
            "id", "item", "of", "first", "size", lead.alias("lead"), F.slice("w", F.greatest(F.lit(0), start) + 1, F.col("size") - lead).alias("w")
        )
        hits = hits.groupBy("id", "item", "of", "first", "size", "lead", "w").agg(F.count(F.lit(1)).alias("n"))
        hits = hits.join(F.broadcast(block.select("of", F.col("w").alias("iw")).dropDuplicates(["of"])), "of")
        same = F.expr("aggregate(sequence(0, size - 1), 0, (n, k) -> n + if(get(w, k - lead) <=> get(iw, first + k), 1, 0))")
        hits = hits.select("id", "item", (same / F.col("size")).alias("overlap"), "n")
        hits = hits.groupBy("id", "item").agg(F.max("overlap").alias("overlap"), F.sum("n").alias("n_hits"))
        found.append(hits.where(F.col("overlap") >= share))
    return reduce(DataFrame.unionByName, found)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **options) -> DataFrame:
    """(id, item, overlap, n_hits): pairs of a document and an item, the best share of agreeing words and the seed hits.

    Documents and items without words (null or empty) and items of fewer than 8 words overlap
    nothing. Repeated documents with one id, and repeated items, give one pair. Where both
    identifiers have one name, the item's is called ``item``.
    """
    out = _overlaps(docs, benchmark, id_col, text_col, item_col, **options)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col if item_col != id_col else "item"), "overlap", "n_hits")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_items, item_ids, overlap, contaminated): one row per input row, clean ones included.

    ``item_ids`` are the distinct items, ascending; a clean document has none, n_items 0 and
    overlap 0. Rows of one id (or of the null id) share their verdict. Empty tables give
    empty or all-clean results; other columns are ignored, and the tables' names may clash.
    """
    found = _overlaps(docs, benchmark, id_col, text_col, **options)
    by_doc = found.groupBy("id").agg(F.sort_array(F.collect_set("item")).alias("item_ids"), F.max("overlap").alias("overlap"))
    ids = docs.select(F.col(f"`{id_col}`").alias("of"))
    out = ids.join(by_doc, F.col("of").eqNullSafe(F.col("id")), "left")
    none = F.array().cast(by_doc.schema["item_ids"].dataType)
    return out.select(
        F.col("of").alias(id_col),
        F.when(F.col("item_ids").isNull(), 0).otherwise(F.size("item_ids")).cast("bigint").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("overlap", F.lit(0.0)).alias("overlap"),
        F.col("item_ids").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that overlap no item, all columns as they were, whatever their names.

    Rows are told apart by id and a hash of the text, so clean rows that share an id, or the
    null id, with a contaminated one stay; other edge cases as in :func:`contaminated`.
    """
    id_of, of = fresh(docs, "_id"), fresh(docs, "_hash")
    marked = docs.withColumns({id_of: F.col(f"`{id_col}`"), of: F.xxhash64(F.col(f"`{text_col}`"))})
    keyed = marked.select(F.struct(F.col(id_of).alias("id"), F.col(of).alias("hash")).alias("key"), F.col(f"`{text_col}`").alias("text"))
    found = _overlaps(keyed, benchmark, "key", "text", **options)
    return without(marked, found.select(F.col("id.id").alias(id_of), F.col("id.hash").alias(of)), [id_of, of]).drop(id_of, of)


#: The query in SQL: seeds of both masks, distinct windows around hits, and their agreeing words by position.
ORACLE = r"""
WITH i AS (SELECT DISTINCT item_id, ws FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark) WHERE len(ws) >= 8),
n AS (SELECT row_number() OVER () AS t, item_id, ws, len(ws) AS n, least(len(ws), 50) AS size FROM i),
iw AS (SELECT t, item_id, n, size, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM n),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
dw AS (SELECT r, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM (SELECT r, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM d)),
ia AS (SELECT t, n, size, pos, w, lead(w, 1) OVER o AS w1, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4, lead(w, 5) OVER o AS w5, lead(w, 6) OVER o AS w6, lead(w, 7) OVER o AS w7 FROM iw WINDOW o AS (PARTITION BY t ORDER BY pos)),
da AS (SELECT r, pos, w, lead(w, 1) OVER o AS w1, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4, lead(w, 5) OVER o AS w5, lead(w, 6) OVER o AS w6, lead(w, 7) OVER o AS w7 FROM dw WINDOW o AS (PARTITION BY r ORDER BY pos)),
hit AS (SELECT r, t, n, size, da.pos AS dpos, ia.pos AS ipos FROM da JOIN ia ON da.w = ia.w AND da.w5 = ia.w5 AND da.w6 = ia.w6 AND da.w7 = ia.w7
  UNION SELECT r, t, n, size, da.pos, ia.pos FROM da JOIN ia ON da.w = ia.w AND da.w1 = ia.w1 AND da.w3 = ia.w3 AND da.w4 = ia.w4),
win AS (SELECT DISTINCT r, t, size, greatest(0, least(ipos - 21, n - size)) AS first, dpos - (ipos - greatest(0, least(ipos - 21, n - size))) AS start FROM hit),
laid AS (SELECT r, t, size, first, start, unnest(range(0, size)) AS k FROM win),
seen AS (SELECT l.r, l.t, l.first, l.start, l.size, count(dw.w) AS same FROM laid l JOIN iw ON iw.t = l.t AND iw.pos = l.first + l.k LEFT JOIN dw ON dw.r = l.r AND dw.pos = l.start + l.k AND dw.w = iw.w GROUP BY l.r, l.t, l.first, l.start, l.size),
best AS (SELECT d.doc_id, n.item_id, max(s.same / CAST(s.size AS DOUBLE)) AS overlap FROM seen s JOIN d ON d.r = s.r JOIN n ON n.t = s.t WHERE s.same / CAST(s.size AS DOUBLE) >= 0.8 GROUP BY d.doc_id, n.item_id),
by_doc AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, max(overlap) AS overlap FROM best GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(b.n_items, 0) AS BIGINT) AS n_items, coalesce(b.item_ids, '') AS item_ids, coalesce(b.overlap, 0.0) AS overlap, b.n_items IS NOT NULL AS contaminated
FROM d LEFT JOIN by_doc b ON d.doc_id IS NOT DISTINCT FROM b.doc_id
"""
