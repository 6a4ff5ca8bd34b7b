from __future__ import annotations

import hashlib
import random
import re

import pytest

from plumbline.llm import decontaminate as D
from tests.llm.conftest import ODD_TEXTS

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string, doc_id string"


def _words(text):
    return WORD.findall(bytes((text or "").encode()).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))


def _brute(rows, items):
    out = []
    for doc_id, text in rows:
        w, hit, held = _words(text), set(), set()
        for item_id, other in items:
            v = _words(other)
            n = min(13, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    held.add(str(item_id))
        names = ",".join(sorted(held))
        out.append((doc_id, len(w), len(hit), len(held), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def _found(docs, items):
    return sorted((tuple(r) for r in D.contamination(docs, items).drop("digest").collect()), key=repr)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(8)
    vocabulary = ["Alpha", "beta", "GAMMA", "delta", "é", "漢字", "z9"]
    say = lambda n: [rng.choice(vocabulary) + str(rng.randint(0, 6)) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([1, 2, 3, 5, 12, 13, 14, 30])))) for i in range(25)]
    items += [(90, items[3][1]), (91, None), (92, ""), (93, "?!"), (94, items[7][1].upper())]
    rows = []
    for i in range(150):
        words = say(rng.randint(0, 60))
        if i % 3 == 0 and words:
            at = rng.randrange(len(words))
            words[at:at] = (items[rng.randrange(25)][1] or "").split()[: rng.randint(1, 40)]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    return rows, items


def test_agrees_with_brute_force(spark, documents, planted):
    rows, items = planted
    table = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    want = _brute(rows, items)
    assert sum(r[5] for r in want) > 20
    assert _found(documents(rows), table) == want


def test_a_small_bitmap_and_no_broadcast_change_nothing(spark, documents, planted, monkeypatch):
    rows, items = planted
    table = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    monkeypatch.setattr(D, "MOST_BITS", 1 << 6)
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    assert _found(documents(rows), table) == _brute(rows, items)


def test_odd_rows_and_empty_tables(spark, odd, documents):
    items = spark.createDataFrame([(1, "one two three", "x"), (1, "same text here", "x"), (None, "x", "y")], ITEMS)
    rows = [*enumerate(ODD_TEXTS), (3, "x"), (None, "same text here"), (None, None)]
    assert len(_found(odd, items)) == len(rows)
    got = {(r.doc_id, r.n_hit) for r in D.contamination(odd, items).collect()}
    assert (6, 1200) in got and (None, 3) in got and (None, 0) in got and (3, 1) in got
    none = spark.createDataFrame([], ITEMS)
    assert {r.n_hit for r in D.contamination(odd, none).collect()} == {0}
    assert D.contamination(documents([]), items).count() == 0


def test_clean_keeps_columns_and_clean_rows(spark, odd):
    items = spark.createDataFrame([(1, "one two three", "x"), (2, "same text here", "x")], ITEMS)
    left = D.clean(odd, items)
    assert left.columns == odd.columns
    assert sorted(left.select("doc_id", "text").collect(), key=repr) == sorted(
        [(i, t) for i, t in [*enumerate(ODD_TEXTS), (3, "x"), (None, None)] if t not in ("same text here", ODD_TEXTS[6])], key=repr
    )
