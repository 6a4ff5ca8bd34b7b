from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import language_id as L
from tests.llm.conftest import ODD_TEXTS, fold

SOUNDS = {"aa": "ba da ga ka la", "bb": "orn ust ilp emt", "cc": "écri ôna ùlet", "dd": "ßen äuf öde"}


def _texts(rng, lang, n):
    parts = SOUNDS[lang].split()
    return [" ".join("".join(rng.choice(parts, 2)) for _ in range(rng.integers(3, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(1)
    return [(lang, t) for lang in SOUNDS for t in _texts(rng, lang, 60)]


def test_codewords_are_apart_and_no_bit_is_idle():
    for n in (2, 3, 4, 10, 40):
        codes = L.codewords(n)
        assert (np.abs(codes.sum(axis=0)) < n).all()
        distances = [(a != b).sum() for i, a in enumerate(codes) for b in codes[:i]]
        assert min(distances) >= (3 if n > 2 else 1)


def test_features_equal_those_found_one_by_one():
    texts = ["abc", "", "x", "Zwei  Wörter, ja", "  ", "é"]
    together = L.features(L.texts_from(texts))
    for k, alone in enumerate(texts):
        for (b, o), (b1, _) in zip(together, L.features(L.texts_from([alone])), strict=True):
            assert b[o[k] : o[k + 1]].tolist() == b1.tolist()


def test_held_out_rows_are_told_by_a_model_that_never_saw_them(documents, labelled):
    rows = list(enumerate(t for _, t in labelled))
    found = L.learn_and_identify(documents(rows, [lang for lang, _ in labelled])).collect()
    assert len(found) == len(rows)
    assert all(r.held_out == (fold(r.doc_id) == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == labelled[r.doc_id][0] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.lang_score <= 1 for r in found)


def test_labels_of_held_out_rows_are_not_used(documents, labelled):
    rows = list(enumerate(t for _, t in labelled))
    langs = [lang for lang, _ in labelled]
    wrong = [("zz" if fold(i) == 0 else x) for i, x in enumerate(langs)]
    a = {r.doc_id: (r.lang_pred, r.lang_score) for r in L.learn_and_identify(documents(rows, langs)).collect()}
    b = {r.doc_id: (r.lang_pred, r.lang_score) for r in L.learn_and_identify(documents(rows, wrong)).collect()}
    assert a == b


def test_odd_rows_have_defined_results(odd):
    found = L.learn_and_identify(odd).collect()
    assert len(found) == len(ODD_TEXTS) + 3
    for r in found:
        text = ODD_TEXTS[r.doc_id] if r.doc_id is not None else None
        if r.doc_id is not None and not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.lang_score) == ("und", 0.0)


def test_empty_table_and_no_labels(documents, spark):
    assert L.learn_and_identify(documents([])).count() == 0
    rows = documents([(1, "abc"), (2, None)], [None, None])
    assert {r.lang_pred for r in L.learn_and_identify(rows).collect()} == {"und"}


def test_stage_keeps_columns_and_drops_what_has_no_language(spark, odd):
    kept = corpus_pipeline.keep_known_language(spark, odd, "")
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert None not in texts and "" not in texts and "x" in texts
