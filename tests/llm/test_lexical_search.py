from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import lexical_search as L
from plumbline.llm.best import Best
from plumbline.llm.text_arrays import texts_of

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [w.lower() for w in TERM.findall((text or "").encode())]


def brute_force(docs, items, top=10):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, words in asked.items():
        found = []
        for doc, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in words if c[t]
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort(key=lambda x: x[:3])
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(found[:top])]
    return out


def _items(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "item_id bigint, text string, rank int, term string")


def _key(row):
    return tuple((x is None, x or 0) for x in row)


def _check(spark, documents, docs, items, **options):
    got = [tuple(r) for r in L.search(documents(docs), _items(spark, items), **options).collect()]
    assert sorted(got, key=_key) == sorted(brute_force(docs, items), key=_key)
    return got


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "漢字", "ß9", "THE", "a"]
    share = 1 / np.arange(1, len(words) + 1)
    make = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(i, make(int(rng.integers(0, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]
    items = [(i, make(8).replace(" ", "--", 2)) for i in range(12)]
    return docs, items


def test_agrees_with_brute_force(spark, documents, corpus):
    docs, items = corpus
    assert len(_check(spark, documents, docs, items)) == 120


def test_blocks_of_items_and_short_segments_change_nothing(spark, documents, corpus, monkeypatch):
    docs, items = corpus
    terms = L.item_terms(_items(spark, items))
    blocks = list(L._blocks(terms, 300))
    assert len(blocks) > 2 and sorted(i for b in blocks for i in b.item_ids) == list(range(12))
    _check(spark, documents, docs, items, block_bytes=300)


def test_odd_rows(spark, documents, odd, corpus):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = [(1, "x"), (1, "text"), (2, None), (3, ""), (4, "--- !"), (5, "HERE same"), (None, "one"), (None, "x"), (6, "absent"), (7, "ÜNÏCÖDÉ Ünïcödé 🙂")]
    got = _check(spark, documents, docs, items)
    assert [r[2] for r in sorted(got, key=lambda r: r[1]) if r[0] == 5] == [7, 8, None]
    assert {r[0] for r in got} == {1, 5, 7, None}
    assert L.search(odd, _items(spark, [])).count() == 0
    assert L.search(odd.limit(0), _items(spark, items)).count() == 0


def test_segments_keep_terms_whole_in_long_texts(monkeypatch):
    monkeypatch.setattr(L, "SEGMENT_BYTES", 64)
    monkeypatch.setattr(L, "MATCHES", 7)
    texts = ["aa b " * 5000, "", "x" * 300 + " aa " + "b" * 200, None, "aa", "AA-aa.b"]
    found = L.count(L.automaton(["aa", "b", "x" * 300]), 3, texts_of(pa.array(texts)))
    assert found.n.tolist() == [10_000, 0, 3, 0, 1, 3]
    triples = list(zip(found.text.tolist(), found.term.tolist(), found.tf.tolist(), strict=True))
    assert triples == [(0, 0, 5000), (0, 1, 5000), (2, 0, 1), (2, 2, 1), (4, 0, 1), (5, 0, 2), (5, 1, 1)]


def test_best_entries_of_many_lists(monkeypatch):
    monkeypatch.setattr("plumbline.llm.best.PENDING", 50)
    rng = np.random.default_rng(5)
    best, every = Best(4, 3), []
    for _ in range(40):
        lists, scores, ids = rng.integers(0, 4, 30), rng.integers(-5, 5, 30), rng.integers(0, 1000, 30)
        best.add(lists, scores, ids)
        every += zip(lists.tolist(), scores.tolist(), ids.tolist(), strict=True)
    want = [x for k in range(4) for x in sorted((e for e in every if e[0] == k), key=lambda e: (-e[1], e[2]))[:3]]
    lists, scores, ids, _ = best.entries()
    assert list(zip(lists.tolist(), scores.tolist(), ids.tolist(), strict=True)) == want
