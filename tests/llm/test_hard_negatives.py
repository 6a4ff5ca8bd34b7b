from __future__ import annotations

import math

import numpy as np
import pytest

from plumbline.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, block int, rank int, p_ids string"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, k, "s", 2, 1, "p") for i, v, k in rows], SCHEMA)


def brute_force(rows, rule=H.Rule()):
    held = {}
    for i, v, k in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[2])):
        if all(x is not None and math.isfinite(x) for x in v):
            held.setdefault(i, ((k + 1) % 10 if i % 7 == 0 else k, [math.floor(256 * x) for x in v]))
    out = []
    for a, (label, vector) in held.items():
        if a % rule.every:
            continue
        others = [(sum(x * y for x, y in zip(vector, w, strict=False)), i, k) for i, (k, w) in held.items() if i != a]
        others.sort(key=lambda x: (-x[0], x[1]))
        for ps, p, _ in [x for x in others if x[2] == label][: rule.positives]:
            fits = [(s, i) for s, i, k in others if k != label and rule.low * ps <= 100 * s <= rule.high * ps]
            out += [(a, p, r + 1, i, ps, s) for r, (s, i) in enumerate(fits[: rule.negatives])]
    return sorted(out)


def _mined(spark, rows, **options):
    return sorted(tuple(r) for r in H.mine(_table(spark, rows), **options).collect())


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.8 * rng.normal(size=16)], int(rng.integers(10))) for i in range(700)]
    # A third of the rows is one vector, under several labels.
    return rows + [(1000 + i, rows[3][1], i % 3) for i in range(350)]


@pytest.mark.parametrize("broadcast_bytes", [H.BROADCAST_BYTES, 0])
def test_agrees_with_brute_force(spark, vectors, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(H, "BLOCK_ROWS", 4)
    monkeypatch.setattr(H, "TILE_ROWS", 3)
    monkeypatch.setattr(H, "CHUNK_ROWS", 100)
    monkeypatch.setattr(H, "TILE_CHUNKS", 2)
    want = brute_force(vectors)
    assert len(want) > 100 and _mined(spark, vectors, broadcast_bytes=broadcast_bytes) == want


def test_other_rules(spark, vectors):
    rule = H.Rule(every=100, positives=2, negatives=7, low=10, high=100)
    assert _mined(spark, vectors[:400], rule=rule) == brute_force(vectors[:400], rule)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 3), (0, [1.0, 0.5], 3), (0, [9.0, 9.0], 8), (1, [1.0, 0.5], 4), (2, [0.9, 0.4], 4), (3, [0.7, 0.5], 5),
        (4, None, 4), (5, [1.0, 1.0], None), (None, [1.0, 1.0], 4), (6, [nan, 1.0], 4), (8, [inf, 1.0], 4), (9, [None, 1.0], 4),
        (10, [], 4), (50, [], 1), (11, [0.8], 4), (12, [0.6, 0.5, 7.0], 6), (13, [-1.0, -1.0], 4), (100, [-0.001, 0.0], 4), (-50, [0.5, 0.1], 4),
    ]
    assert _mined(spark, rows) == brute_force(rows)
    assert _mined(spark, []) == []
    assert _mined(spark, [(1, [1.0], 1)]) == []
    assert _mined(spark, [(50, [1.0], 1)]) == []


def test_wide_scores_are_exact_and_too_wide_ones_refused(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-(1 << 20), 1 << 20, 6)], i % 2) for i in range(120)]
    want = brute_force(rows)
    assert max(abs(r[4]) for r in want) > 1 << 53
    assert _mined(spark, rows) == want
    with pytest.raises(ValueError, match="64 bits"):
        _mined(spark, [(50, [1e300], 1)])


@pytest.mark.parametrize("dim", [1, 64, 5000])
def test_products_in_residues_are_exact(dim):
    rng = np.random.default_rng(dim)
    a, b = rng.integers(-(1 << 22), 1 << 22, (5, dim)), rng.integers(-(1 << 22), 1 << 22, (7, dim))
    primes = H.primes_for(dim, dim << 44)
    assert math.prod(primes) > dim << 45
    got = H.product(H.residues(a, primes), H.residues(b, primes), primes)
    assert got.tolist() == [[sum(x * y for x, y in zip(r.tolist(), s.tolist(), strict=True)) for s in b] for r in a]
