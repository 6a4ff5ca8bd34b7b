from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import lm_score as L
from tests.llm.conftest import ODD_TEXTS, fold, spaced_words


def _base(rows):
    tokens = [[*spaced_words(t), None] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if i is not None and fold(i) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return n, [(len(ws), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for ws in tokens]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    chain = {w: rng.choices("abcdefghij", k=3) for w in "abcdefghij"}
    out = []
    for i in range(400):
        w, words = "a", []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(chain[w]) if rng.random() < 0.95 else f"rare{rng.randint(0, 999)}"
            words.append(w.upper() if rng.random() < 0.1 else w)
            w = w if w in chain else "a"
        out.append((i, " ".join(words)))
    return out


def test_base_scores_are_exact_and_the_model_is_better(documents, rows, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_TOKENS", 700)
    monkeypatch.setattr(L, "RANGE_BYTES", 2_000)
    n, want = _base(rows)
    found = {r.doc_id: r for r in L.scores(documents(rows).repartition(3)).collect()}
    for (i, _), (tokens, known, base) in zip(rows, want, strict=True):
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, fold(i) == 1)
        assert math.isclose(r.base_score, base, abs_tol=1e-9)
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def _model(rows):
    """Scores by plain counting, with weights from the cells of every training document without its own counts."""
    texts = [(i is None or fold(i) == 1, [*spaced_words(t), "END"]) for i, t in rows]

    def counts(ws):
        return Counter(ws), Counter(zip(["BEGIN", *ws], ws, strict=False)), Counter(["BEGIN", *ws[:-1]])

    uni, bi, ctx = Counter(), Counter(), Counter()
    for held, ws in texts:
        if not held:
            for total, own in zip((uni, bi, ctx), counts(ws), strict=True):
                total.update(own)
    tokens, types = sum(uni.values()), len(uni)
    cells = Counter()
    for held, ws in texts:
        if held:
            continue
        u, b, c = counts(ws)
        for before, w in zip(["BEGIN", *ws], ws, strict=False):
            context = ctx[before] - c[before]
            p1 = (uni[w] - u[w]) / max(tokens - len(ws), 1)
            p2 = (bi[before, w] - b[before, w]) / context if context else 0.0
            cell = [int(L._cell(np.array([p]))[0]) for p in (p1, p2)]
            cells[(int(L.bucket(np.array([context]))[0]) * L.CELLS + cell[0]) * L.CELLS + cell[1]] += 1
    names = sorted(cells)
    weights = L.expectation_maximisation(np.array(names), np.array([cells[k] for k in names]), types)
    out = []
    for _, ws in texts:
        score = 0.0
        for before, w in zip(["BEGIN", *ws], ws, strict=False):
            x = weights[int(L.bucket(np.array([ctx[before]]))[0])]
            score += math.log10(x[0] / (types + 1) + x[1] * uni[w] / tokens + x[2] * bi[before, w] / max(ctx[before], 1))
        out.append(score)
    return out


@pytest.mark.parametrize("folds", [{0, 1, 2, 3, 4}, {0, 1}])
def test_scores_are_those_of_plain_counting(documents, rows, monkeypatch, folds):
    monkeypatch.setattr(L, "BLOCK_TOKENS", 900)
    monkeypatch.setattr(L, "RANGE_BYTES", 3_000)
    some = [r for r in rows if fold(r[0]) in folds] + [(2001, None), (2002, "a b a"), (2002, "a b a")]
    found = sorted((r.doc_id, r.score) for r in L.scores(documents(some).repartition(3)).collect())
    want = sorted((i, s) for (i, _), s in zip(some, _model(some), strict=True))
    assert [i for i, _ in found] == [i for i, _ in want]
    assert all(math.isclose(a, b, abs_tol=1e-6) for (_, a), (_, b) in zip(found, want, strict=True))


def test_probabilities_of_different_texts_add_up_to_less_than_one(documents):
    train = [(i, "a b a c a b") for i in range(40) if fold(i) != 1]
    texts = ["", "a", "b", "a b", "a c", "a new", "new", "a b a c a b"]
    held = [i for i in range(1000, 3000) if fold(i) == 1][: len(texts)]
    found = {r.doc_id: r.score for r in L.scores(documents(train + list(zip(held, texts, strict=True)))).collect()}
    chances = [10 ** found[i] for i in held]
    assert 0 < sum(chances) < 1
    # After what all training documents begin with comes what follows there; new words are unlikely.
    assert max(chances) == chances[texts.index("a b")] and chances[texts.index("new")] < min(chances[3], chances[7])


def test_expectation_maximisation_finds_the_mixture():
    rng = np.random.default_rng(0)
    p1, p2 = rng.dirichlet(np.ones(50)), rng.dirichlet(np.ones(50))
    draws = np.where(rng.random(20_000) < 0.7, rng.choice(50, 20_000, p=p2), rng.choice(50, 20_000, p=p1))
    cells, n = np.unique((3 * L.CELLS + L._cell(p1[draws])) * L.CELLS + L._cell(p2[draws]), return_counts=True)
    weights = L.expectation_maximisation(cells, n, 10**9)
    assert abs(weights[3, 2] - 0.7) < 0.05 and np.allclose(weights.sum(axis=1), 1)


def test_odd_rows_and_empty_tables(odd, documents):
    rows = [*enumerate(ODD_TEXTS), (3, "x"), (None, "same text here"), (None, None)]
    n, want = _base(rows)
    found = sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in L.scores(odd).collect())
    assert found == sorted((a, b, round(c, 6)) for a, b, c in want)
    assert L.scores(documents([])).count() == 0
    held = next(i for i in range(100) if fold(i) == 1)
    alone = L.scores(documents([(held, "no training here"), (held, None)])).collect()
    assert {(r.train_tokens, r.n_known, r.score, r.base_score) for r in alone} == {(0, 0, 0.0, 0.0)}
