"""Hard negatives against plain loops."""

import numpy as np
import pytest

from shotloom.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string, positive_id string, v string"


def brute(rows, every, positives=5, negatives=10):
    last = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own = (label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        last[i] = max(last.get(i, own), own)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (la, va) in last.items():
        if a % every:
            continue
        scored = sorted((-dot(va, v), i, label) for i, (label, v) in last.items() if i != a)
        for ps, p, _ in [s for s in scored if s[2] == la][:positives]:
            hits = [s for s in scored if s[2] != la and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:negatives]
            out += [(a, p, k, n, -ps, -s) for k, (s, n, _) in enumerate(hits, 1)]
    return sorted(out)


def found(spark, rows, every=10):
    df = spark.createDataFrame([(*r, "?", "?", "?") for r in rows], SCHEMA)
    got = hn.hard_negatives(df, anchors_every=every).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("low, high", [(-3, 4), (-128, 127), (-(1 << 20), (1 << 20) - 1)])
def test_scores_are_exact(low, high):
    rng = np.random.default_rng(5)
    values, anchors = rng.integers(low, high + 1, (37, 13)), rng.integers(low, high + 1, (11, 13))
    values[0], anchors[0] = low, low
    planes = int(max(high, -low - 1)).bit_length() + 1
    assert (hn.scores(hn.bit_planes(values, planes), anchors) == values @ anchors.T).all()


def test_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(hn, "CANDIDATES", 40)
    monkeypatch.setattr(hn, "ANCHORS", 8)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0.2, 1, 6)], int(rng.integers(0, 3))) for i in range(200)]
    rows += [(200 + i, [0.5] * 6, i % 2) for i in range(60)]  # one common vector: ties by id
    rows += [(300, [9.0, 1.0], 1), (301, [], 1), (310, [-1.5] * 6, 2)]
    want = brute(rows, 10)
    assert found(spark, rows) == want and len(want) > 500


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.7, 0.6], 2), (3, None, 2), (4, [0.5, None], 2), (5, [0.5, nan], 2), (6, [inf, 0.1], 2), (7, [0.6, 0.6], None), (None, [0.6, 0.6], 2)]
    assert found(spark, rows) == brute(rows, 10) == [(0, 1, 1, 2, 256 * 256 + 256 * 230, 256 * (179 + 153))]


def test_repeated_ids_are_one_item(spark):
    rows = [(0, [1.0], 1), (0, [0.5], 1), (5, [0.9], 1), (5, [0.9], 1), (6, [0.6], 2), (6, [0.7], 2), (1 << 60, [0.65], 3), ((1 << 60) + 1, [0.65], 3)]
    assert found(spark, rows) == brute(rows, 10)


def test_few_or_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1)]) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_too_large_components(spark):
    with pytest.raises(ValueError, match="63 bits"):
        found(spark, [(0, [1e12], 1), (1, [1.0], 1)])
