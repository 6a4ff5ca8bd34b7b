from __future__ import annotations

import random

from plumbline.llm import mixing as M
from tests.llm.conftest import ODD_TEXTS


def _targets(sizes: dict) -> dict:
    """Shares by weight, the excess over twice a source's size handed on until there is none."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(order)}
    budget, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in order if s not in full]
        left = budget - sum(2 * sizes[s] for s in full)
        for s in rest:
            target[s] = left * weight[s] / sum(weight[r] for r in rest)
        over = {s for s in rest if target[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else target[s] for s in order}
        full |= over


def _corpus(rng, n):
    sources = ["a", "b", "c", "d", None, "é"]
    rows = [(i, " ".join(["w"] * rng.randint(0, 40))) for i in range(n)]
    return rows, [sources[0] if rng.random() < 0.4 else rng.choice(sources) for _ in rows]


def test_every_source_comes_near_its_target(documents):
    rows, sources = _corpus(random.Random(3), 3000)
    found = M.taken(documents(rows, sources=sources)).collect()
    sizes: dict = {}
    for (_, t), s in zip(rows, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, by, took = _targets(sizes), dict(zip((i for i, _ in rows), sources, strict=True)), {}
    for r in found:
        s = by[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.times <= 2
        took[s] = took.get(s, 0) + r.times * r.size
    assert len(found) == len(rows)
    assert all(abs(took[s] - want[s]) <= 80 for s in sizes)
    assert sum(took.values()) <= 1.5 * sum(sizes.values())


def test_reruns_agree_and_layout_does_not_matter(documents):
    rows, sources = _corpus(random.Random(4), 500)
    docs = documents(rows, sources=sources)
    assert sorted(M.taken(docs).collect()) == sorted(M.taken(docs.repartition(7)).collect())


def test_order_interleaves_sources_by_their_targets(documents, spark):
    rows = [(i, "w " * 10) for i in range(300)]
    docs = documents(rows, sources=["a", "b", "c"] * 100)
    plan = M.planned(docs)
    order = M.mix_order(M.queued(plan.slim, plan.sources)).orderBy("finish", "number", "words").collect()
    third = order[: len(order) // 3]
    share = [sum(r.number == k for r in third) / len(third) for k in (1, 2, 3)]
    targets = [r.target for r in plan.sources.orderBy("number").collect()]
    assert all(abs(s - t / sum(targets)) < 0.02 for s, t in zip(share, targets, strict=True))


def test_many_sources_take_the_salted_join(documents, monkeypatch):
    rows, sources = _corpus(random.Random(5), 300)
    docs = documents(rows, sources=sources)
    want = sorted(M.taken(docs).collect())
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert sorted(M.taken(docs).collect()) == want


def test_odd_rows_keep_all_columns(odd, documents):
    found = M.taken(odd).collect()
    assert len(found) == len(ODD_TEXTS) + 3
    assert all(r.times == 0 for r in found if r.size == 0)
    mixed = M.mixed(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.times for r in found)
    assert M.taken(documents([])).count() == 0 == M.mixed(documents([])).count()
    assert {r.times for r in M.taken(documents([(1, None), (2, "")])).collect()} == {0}
