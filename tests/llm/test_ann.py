from __future__ import annotations

import math

import numpy as np
import pytest

from plumbline.llm import ann as A

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int, score string"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "s") for i, v in rows], SCHEMA)


def _exact(rows, top=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for k in np.flatnonzero(ids % 50 == 0):
        s = np.round(unit @ unit[k], 12)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[k]][:top]
        out[int(ids[k])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 24))
    return [(i, [float(v) for v in centres[rng.integers(40)] + 0.7 * rng.normal(size=24)]) for i in range(3000)]


def test_recall_over_several_shards(spark, vectors, monkeypatch):
    monkeypatch.setattr(A, "SHARD", 1000)
    monkeypatch.setattr(A, "BLOCK", 25)
    want = _exact(vectors)
    got: dict = {}
    for r in A.neighbours(_table(spark, vectors)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(g) == 5 for g in got.values())
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 5 for q in want]) >= 0.95
    exact = {(q, v): s for q, found in want.items() for v, s in found}
    assert all(math.isclose(s, exact[q, v], abs_tol=1e-9) for q, g in got.items() for v, s in g if (q, v) in exact)
    assert all(a[1] >= b[1] for g in got.values() for a, b in zip(g, g[1:], strict=False))


def test_ties_go_to_smaller_ids_in_a_large_group_of_equal_vectors(spark, vectors):
    rows = vectors[:300] + [(1000 + i, vectors[0][1]) for i in range(500)]
    got = [r for r in A.neighbours(_table(spark, rows)).collect() if r.query_id in (0, 1050)]
    found = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 1050)}
    assert found == {0: [1000, 1001, 1002, 1003, 1004], 1050: [0, 1000, 1001, 1002, 1003]}


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (50, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]),
            (None, [1.0, 1.0]), (6, []), (1, [0.5, 0.5]), (7, [1.0, 2.0, 3.0]), (100, [1e-30, 0.0]), (150, [1.0, 1.0, 1.0])]
    got = A.neighbours(_table(spark, rows)).collect()
    pairs = {(r.query_id, r.rank, r.vec_id) for r in got}
    assert pairs == {(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1), (150, 1, 7)}
    assert A.neighbours(_table(spark, [])).count() == 0
    assert A.neighbours(_table(spark, [(1, [1.0])])).count() == 0
    assert A.neighbours(_table(spark, [(50, [1.0])])).count() == 0


def _answers(spark, rows):
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in A.neighbours(_table(spark, rows)).orderBy("query_id", "rank").collect()]


def test_blocks_copied_for_all_shards_are_not_broadcast(spark, vectors, monkeypatch):
    # The driver would hold as many copies of all queries as there are shards.
    monkeypatch.setattr(A, "SHARD", 100)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "64k")
    try:
        got = _answers(spark, vectors)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    want = _exact(vectors)
    assert len(got) == 5 * len(want)
    assert sum(v in {w for w, _ in want[q]} for q, _, v, _ in got) >= 0.95 * len(got)


def test_tiles_of_any_size_give_the_same_rows(spark, vectors, monkeypatch):
    rows = vectors[:1200] + [(5000 + 50 * i, [float(i), 1.0, 2.0]) for i in range(30)]
    monkeypatch.setattr(A, "SHARD", 200)
    monkeypatch.setattr(A, "BLOCK", 8)
    monkeypatch.setattr(A, "SPREAD", 1)
    found = []
    for tile_bytes, tile_blocks in ((1, 1), (200_000, 2), (1 << 30, 16)):
        monkeypatch.setattr(A, "TILE_BYTES", tile_bytes)
        monkeypatch.setattr(A, "TILE_BLOCKS", tile_blocks)
        found.append(_answers(spark, rows))
    assert len(found[0]) == 5 * (24 + 30)
    assert all(f == found[0] for f in found)


def test_a_shard_number_without_rows_leaves_no_other_shard_out(spark, vectors, monkeypatch):
    monkeypatch.setattr(A, "SHARD", 2)
    rows = vectors[:200]
    assert {(q, v) for q, _, v, _ in _answers(spark, rows)} == {(q, v) for q, found in _exact(rows).items() for v, _ in found}


def test_tiles_stay_within_a_workers_bytes_and_are_spread():
    assert [A._tiles(64, n) for n in (1, 13, 64, 151)] == [1, 13, 64, 64]
    for dim, shards in ((64, 4000), (1024, 4000)):
        held = -(-shards // A._tiles(dim, shards))
        assert held == 1 or held * A.SHARD * (12 * dim + 8 * A.DEGREE + 120) <= A.TILE_BYTES
