from __future__ import annotations

import random

import pytest

from plumbline.llm import near_dedup as N
from plumbline.llm.components import components
from tests.llm.conftest import spaced_words


def _roots(pairs, ids):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def _brute(rows, rule):
    sets = {}
    for i, t in rows:
        w = spaced_words(t)
        n = rule.size
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    pairs = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= rule.percent * len(sets[a] | sets[b])
    ]
    return sets, _roots(pairs, sets)


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies with all rates of edits, one of them large."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(2, 120))]
        for _ in range(160 if group == 0 else 12):
            rate = rng.choice([0, 0.01, 0.02, 0.03, 0.05])
            rows.append((len(rows) * 3 + 1, " ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in base)))
    return rows


@pytest.mark.parametrize("rule", [N.Rule(3, 85), N.Rule(5, 80)])
def test_agrees_with_brute_force(documents, copies, rule, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 40)  # the large group takes several blocks
    sets, want = _brute(copies, rule)
    found = N.near_duplicates(documents(copies), rule).collect()
    assert len(set(want.values())) < len(copies)
    for r in found:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_bands_reach_the_promised_recall():
    for percent in (80, 85, 95):
        rule = N.Rule(5, percent)
        assert (1 - (percent / 100) ** N.ROWS) ** rule.bands <= N.MISS


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    pairs += [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)]
    ids = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == _roots(pairs, ids)


def test_odd_rows_and_empty_table(odd, documents):
    rule = N.Rule(3, 85)
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(odd, rule).collect()}
    assert {(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (7, 1, 7, True), (8, 1, 7, False)} <= found
    assert (None, 1, None, True) in found and (None, 0, None, True) in found
    assert N.near_duplicates(documents([]), rule).count() == 0
    assert N.near_duplicates(documents([(1, None), (2, "")]), rule).count() == 2


def test_one_of_each_group_stays_with_its_columns(odd):
    left = N.deduplicated(odd, N.Rule(3, 85))
    assert left.columns == odd.columns
    ids = sorted((r.doc_id for r in left.collect()), key=str)
    assert ids == sorted([0, 1, 2, 3, 4, 5, 6, 7, None, None], key=str)
