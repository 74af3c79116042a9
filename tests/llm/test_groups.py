"""SimHash groups and the pipeline against brute force."""

import random

import numpy as np
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import decontaminate, secret_scan, shared, simhash
from larkspur.llm.catalogue import QUERIES, tokenizer_path

from test_near_copies import brute_kept


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """{id: smallest id reachable} for (id, fingerprint) pairs."""
    values = np.unique(np.array([f for _, f in fps], dtype=np.uint64))
    parent = list(range(len(values)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 2):
            parent[top(i + 1 + int(j))] = top(i)
    place = {int(v): i for i, v in enumerate(values)}
    least = {}
    for k, f in fps:
        root = top(place[f])
        least[root] = min(least.get(root, k), k)
    return {k: least[top(place[f])] for k, f in fps}


def test_query(spark, sf_dir):
    docs = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute_components(docs)
    rows = QUERIES["op5_simhash"](spark, sf_dir).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == dict(docs)
    assert {r.doc_id: r.component_id for r in rows} == want


def chains(seed, n):
    """Clusters, chains and noise of fingerprints as signed numbers."""
    r = random.Random(seed)
    out = []
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 2, 12])):
            out.append(x)
            for _ in range(r.randint(0, 3)):
                x ^= 1 << r.randrange(64)
    center = r.getrandbits(64)
    out += [center ^ sum(1 << b for b in r.sample(range(64), 3)) for _ in range(n // 3)]
    return [(i, f) for i, f in enumerate(out)]


def test_components_with_small_and_large_buckets(spark):
    for bucket in (2, 64):
        fps = chains(bucket, 400)
        signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps]
        df = spark.createDataFrame(signed, "doc_id long, fp long")
        nodes = df.select("fp").distinct()
        roots = simhash.connected(simhash.links(nodes, bucket))
        by = df.join(roots, df.fp == roots.node, "left").select("doc_id", F.coalesce("label", "fp").alias("root"))
        least = by.groupBy("root").agg(F.min("doc_id").alias("c"))
        got = {r.doc_id: r.c for r in by.join(least, "root").collect()}
        assert got == brute_components(fps)


def test_no_link_is_lost(spark):
    fps = chains(5, 150)
    values = sorted({f for _, f in fps})
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 2}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in values], "fp long")
    got = [tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.links(df).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.label for r in simhash.connected(edges).collect()} == {0}


def test_hubs_are_split_alike(spark):
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(20)] + [(299, 500), (500, 501)]
    df = spark.createDataFrame(edges, "a long, b long")
    pick = lambda least: sorted(map(tuple, simhash.connected(df, least).collect()))
    assert pick(10) == pick(10**6) and dict(pick(10))[501] == 0 and dict(pick(10))[1020] == 1000


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (2, "q w e r t y", "z"), (2, "something else here now", "z"), (None, "null id text here", "n"), (7, None, "n"), (8, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted([("1", "a b c d"), ("2", "q w e r t y"), ("2", "something else here now"), ("None", "null id text here"), ("7", "None")])


def test_sized_lookups_agree(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 5 else None) for i in range(40)], "id long, k long")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    pick = lambda limit: sorted(map(str, shared.look_up(df, small, ["k"], "id", limit).select("id", "v").collect()))
    assert pick(100) == pick(0) and len(pick(0)) == 40
    keys = spark.createDataFrame([(0,), (None,)], "k long")
    left = lambda limit: sorted(r.id for r in shared.without(df, keys, ["k"], limit).collect())
    assert left(100) == left(0) == [i for i in range(40) if i % 5 and i % 3]


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {i: r.text for i, r in docs.items() if any(c.isalpha() for c in r.text or "")}
    near = brute_kept(kept)  # five-word shingles, 0.8 alike: the rule of near-duplicate stages
    kept = {i: t for i, t in kept.items() if i in near}
    items = [r.text.lower() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    words = lambda t: " ".join(x for x in __import__("re").split(r"[^\w]+|_", t.lower()) if x)
    items = [words(t) for t in items if len(words(t).split()) >= 8]
    kept = {i: secret_scan.redact(t) for i, t in kept.items() if not any(f" {x} " in f" {words(t)} " for x in items)}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(rows) == set(kept)
    assert all(rows[i].ids == library.encode(t) and rows[i].n_tokens == len(rows[i].ids) for i, t in kept.items())


def test_stages_keep_columns_and_take_hard_rows(spark, sf_dir):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "x " * 50_000, None, None, None), (None, "some words of text here", "en", "s", 23), (5, "some words of text here", "en", "s", 23), (5, "some words of text here", "en", "s", 23)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (df, df.where("false")):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "sentencepiece":
                assert out.columns == df.columns and out.dtypes == df.dtypes
            docs = out
        docs.collect()


def test_native_stage_drops_leaks(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    rows = [(1, "x One, two three four five SIX seven eight nine ten y"), (2, "one two three four"), (None, "clean")]
    left = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {r.doc_id for r in left.collect()} == {2, None}
