from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from plumbline.llm import suffix_dedup as S
from tests.llm.conftest import ODD_TEXTS


def _brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + S.LENGTH] for b in raw for i in range(len(b) - S.LENGTH + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - S.LENGTH + 1):
            if seen[b[i : i + S.LENGTH]] > 1:
                gone[i : i + S.LENGTH] = b"\1" * S.LENGTH
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _found(docs):
    return sorted(tuple(r)[1:] for r in S.removals(docs).collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefgh éz\n") for _ in range(n))
    passages = [noise(n) for n in (350, 380, 399, 400, 405, 430, 470, 700, 1500)]
    out = []
    for _ in range(80):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += [noise(rng.randint(0, 200)), rng.choice(passages)]
        out.append("".join(parts))
    base = noise(2500)
    for _ in range(25):  # near copies: an edit here and there
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = "#"
        out.append("".join(copy))
    return [*out, base, base, "ab" * 700, "x" * 399, "y" * 400, "z" * 401, noise(300) * 3]


@pytest.mark.parametrize("shares", [1, 8])
def test_agrees_with_brute_force(documents, texts, shares, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(S, "PIECE_BYTES", 5_000)
    if shares > 1:
        monkeypatch.setattr(S, "RANGE_BYTES", 20_000)
    want = _brute(texts)
    assert sum(w[1] for w in want) > 40_000
    docs = documents(list(enumerate(texts))).repartition(3)
    assert _found(docs) == sorted(want)


def test_merge_of_front_coded_runs_is_the_sorted_whole():
    rng = random.Random(2)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted({bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 30))}) for _ in range(k)]
        coded = []
        for run in runs:
            shared, rests = S.front_coded(run)
            coded.append(S.Run(shared.tolist(), rests))
            before = b""
            for s, n, rest in zip(run, shared.tolist(), rests, strict=True):
                assert before[:n] + rest == s
                before = s
        out, before = [], b""
        for r, shared in S.merge(coded):
            now = coded[r].now
            true = next((i for i, (x, y) in enumerate(zip(before, now, strict=False)) if x != y), min(len(before), len(now)))
            assert shared == true or not out
            out.append(now)
            before = now
        assert out == sorted(s for run in runs for s in run)


def test_odd_rows_and_empty_table(odd, documents):
    rows = [*ODD_TEXTS, "x", "same text here", None]
    assert _found(odd) == sorted(_brute(rows))
    assert S.removals(documents([])).count() == 0
    assert _found(documents([(1, None), (2, "")])) == sorted(_brute([None, ""]))
    twice = documents([(1, "q" * 10 + "".join(map(str, range(300)))), (1, "q" * 10 + "".join(map(str, range(300))))])
    assert {r.n_removed for r in S.removals(twice).collect()} == {800}
