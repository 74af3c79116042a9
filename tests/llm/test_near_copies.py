"""The near-duplicate stage of the pipeline against brute force."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import near_copies, simhash


def brute_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(texts):
    """Ids that are the smallest of their component at a Jaccard similarity of 0.8."""
    sets, least = {i: brute_set(t) for i, t in texts.items()}, {i: i for i in texts}
    alike = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in alike:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return {i for i in texts if least[i] == i}


def edited(r, n):
    """Texts of one base each, with words replaced so that similarities lie around 0.8; some copies, short and empty ones."""
    texts = {}
    while len(texts) < n:
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([3, 9, 40, 200, 700]))]
        for _ in range(r.randint(1, 4)):
            words = list(base)
            for p in r.sample(range(len(words)), min(len(words), round(len(words) * r.choice([0, 0.01, 0.02, 0.03])))):
                words[p] = f"x{r.randrange(5000)}"
            texts[len(texts)] = " ".join(words)
    return texts | {n + 50: "", n + 51: None, n + 52: " \n"}


def test_stage_equals_brute_force(spark, sf_dir):
    texts = edited(random.Random(8), 150)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_kept(texts)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, sf_dir).collect()} == want
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    some = docs.where(F.col("doc_id").isin(1, 255, 2, 56, 709, 944, 582, 875, 643, 770, 3, 4))
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, some, sf_dir).collect()} == {1, 2, 709, 582, 643, 3, 4}


def test_frequent_shingles_change_no_result(spark, monkeypatch):
    line = "the same line of words is in every text here "
    texts = {i: line * 3 + t for i, t in edited(random.Random(3), 60).items() if t}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for most in (0, 50_000):
        monkeypatch.setattr(near_copies, "COMMON", most)
        assert {r.doc_id for r in near_copies.drop_near_copies(df).collect()} == brute_kept(texts)


def test_fingerprints_propose_and_shingles_verify(spark, monkeypatch):
    """Without the exact join, near copies of close fingerprints go; texts of one fingerprint with other words stay."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(700)]
    texts = {1: " ".join(words), 2: " ".join(["x", *words[1:]]), 3: " ".join([*words[:-1], "y"])}
    for i in (4, 5):
        texts[i] = "one line that comes again " * 400 + " ".join(f"t{r.randrange(10**6)}" for _ in range(40))
    assert simhash.fingerprint(texts[4], 5) == simhash.fingerprint(texts[5], 5)
    members = near_copies.members
    monkeypatch.setattr(near_copies, "members", lambda own: members(own.where("false")))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in near_copies.drop_near_copies(df).collect()} == {1, 4, 5} == brute_kept(texts)


def test_links_beyond_two_bits(spark):
    r = random.Random(6)
    fps = set()
    while len(fps) < 400:
        x = r.getrandbits(64)
        for _ in range(4):
            near = x
            for p in r.sample(range(32), r.randint(0, 2)) + r.sample(range(32, 64), r.randint(0, 18)):
                near ^= 1 << p
            fps.add(near)
    want = set()
    for a in fps:
        for b in fps:
            low, high = ((a ^ b) & 0xFFFFFFFF).bit_count(), ((a ^ b) >> 32).bit_count()
            if a != b and min(low, high) <= 1 and low + high <= 16:
                want.add(frozenset((a, b)))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    got = simhash.links(spark.createDataFrame(signed, "fp long"), bits=16).collect()
    assert len(got) == len(want) and {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in got} == want
