"""Near-duplicates at thresholds too wide for blocks of bits: tiles for pairs, passes for the greedy rule."""

import numpy as np
import pytest

from larkspur.operators import dedup

THRESHOLD = 20


def words(n: int, seed: int) -> list[int]:
    """Random words, some near others, with the largest and the least one."""
    r = np.random.default_rng(seed)
    some = r.integers(-(2**63), 2**63 - 1, n).tolist()
    near = [x ^ (1 << int(b)) for x, b in zip(some[: n // 4], r.integers(0, 63, n))]
    return list(dict.fromkeys([*some, *near, -(2**63), 2**63 - 1, 0, -1]))


def far(a: int, b: int) -> int:
    return ((a ^ b) & (2**64 - 1)).bit_count()


@pytest.mark.parametrize("tile", [1 << 16, 100])
def test_pairs_come_from_tiles_without_keys(spark, monkeypatch, tile):
    monkeypatch.setattr(dedup, "TILE", tile)
    given = words(400, 1)
    made = dedup.near_pairs(spark.createDataFrame([(x,) for x in [*given, None]], "fp long").repartition(3), THRESHOLD)
    assert "posexplode" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.a, r.b) for r in made.collect()]
    assert sorted(got) == sorted((a, b) for a in given for b in given if a < b and far(a, b) <= THRESHOLD)


@pytest.mark.parametrize(("at_once", "windows"), [(1 << 16, 4096), (60, 20)])
def test_the_greedy_rule_lists_no_pairs(spark, monkeypatch, at_once, windows):
    monkeypatch.setattr(dedup, "PASS", at_once, raising=False)
    monkeypatch.setattr(dedup, "WINDOWS", windows, raising=False)
    monkeypatch.setattr(dedup, "near_pairs", lambda *_: pytest.fail("pairs were listed"))
    given = words(200, 2)
    rows = [(i, x) for i, x in enumerate([*given, *given[:50], None, None])]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint long").repartition(5)
    kept, want = [], {}
    for i, x in rows:
        want[i] = next((k for k, y in kept if far(x, y) <= THRESHOLD), None) if x is not None else None
        if x is not None and want[i] is None:
            kept.append((i, x))
    assert {r.doc_id: r.duplicate_of for r in dedup.greedy_duplicates(df, THRESHOLD, ("doc_id",)).collect()} == want
    assert dedup.greedy_duplicates(df.where("fingerprint is null"), THRESHOLD, ("doc_id",)).where("duplicate_of is null").count() == 2


def test_narrow_thresholds_of_many_words_are_blocked():
    assert dedup.compares_all(100_000, 20) and dedup.compares_all(50_000, 8) and not dedup.compares_all(10_000_000, 8)
