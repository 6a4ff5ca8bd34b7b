from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import Row

from plumbline.llm import toxicity as T
from tests.llm.conftest import ODD_TEXTS, fold


def _distance(a: str, b: str) -> int:
    """Edits with swaps of neighbours, no letter edited twice."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_finds_exactly_the_terms_within_their_edits():
    rng = random.Random(5)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 11))) for _ in range(40)})
    automaton = T.Automaton(T.Trie(terms, [], frozenset(terms)))
    for _ in range(1500):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        near = [(_distance(word, t), t) for t in terms if _distance(word, t) <= T.edits_allowed(len(t))]
        assert automaton.match(word) == (min(near)[::-1] if near else None), word


def test_stems_and_misspellings():
    finder = T.Finder(T.Lexicon({"stupid": 4.0, "scum": 4.0}, {"bome": 2.0}, {}, frozenset({"stupid", "scum"})))
    assert finder.look_up("stupid") == (0, 4.0)
    assert finder.look_up("stpuid") == (2, 2.0) == finder.look_up("st*pid")
    assert finder.look_up("bomentado") == (1, 2.0)
    assert finder.look_up("scam") is None  # short terms have no edits


def test_quotation_is_told_from_abuse():
    finder = T.Finder(T.Lexicon({"idiot": 4.0}, {}, {"said": -1.5}))
    plain, quoted = finder.features("you are an idiot"), finder.features('they wrote "what an idiot" and left')
    assert plain[0] > 0 == plain[3] and quoted[3] > 0 == quoted[0]
    assert finder.features("and one said idiot to me")[6] < plain[6]


def test_terms_met_in_more_clean_rows_than_toxic_ones_are_kept_if_significant(spark):
    rows = [("du bist ein lump", 1)] * 20 + [("er sagte lump zu ihm", 0)] * 21 + [("ein ganz anderer satz", 0)] * 400
    model = T.fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert "lump" in model.lexicon.words and "satz" not in model.lexicon.words
    assert T.Finder(model.lexicon).hits("so ein lump")[0]


def test_every_term_has_its_misspellings():
    def row(kind, term, n_toxic, z):
        return Row(kind=kind, term=term, n_toxic=n_toxic, n_rest=0, weight=3.0, z=z)

    lexicon = T.lexicon_of([row(0, "idiot", 30, 9.0), row(0, "idiots", 30, 9.0), row(1, "idio", 60, 12.0), row(1, "bomen", 20, 7.0), row(0, "wretch", 6, 5.0)])
    finder = T.Finder(lexicon)
    assert finder.look_up("idoit") == (2, 1.5)  # a word under a stem
    assert finder.look_up("idiotic") == (1, 3.0)
    assert finder.look_up("wertch") == (2, 1.5)  # a rare term
    assert finder.look_up("bmoentado") == (2, 1.5)  # a stem
    assert finder.look_up("idol") is None and finder.look_up("women") == (2, 1.5)


def test_near_stems_are_those_within_their_edits():
    rng = random.Random(6)
    stems = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 9))) for _ in range(12)})
    automaton = T.Automaton(T.Trie([], stems, frozenset()))
    for _ in range(800):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        near = [(min(_distance(word[:n], s) for n in range(1, len(word) + 1)), s) for s in stems]
        near = [(d, s) for d, s in near if d <= T.edits_allowed(len(s))]
        assert automaton.misspelled_stem(word) == (min(near)[::-1] if near else None), word


def test_quotations_have_no_greatest_length():
    finder = T.Finder(T.Lexicon({"idiot": 4.0}, {}, {}))
    for a, b in ('""', "“”", "«»", "„“"):
        assert finder.hits(f"{a}{'so ' * 300}an idiot{b} they wrote")[0][0].quoted
        assert not finder.hits(f"{a}so\nan idiot{b} they wrote")[0][0].quoted
    assert T.quotations('""x" “a "b" „c“ «') == [(1, 4), (8, 11), (12, 15)]
    assert T.quotations("“" * 200_000) == []  # in linear time


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    plain = ["alba", "corte", "dune", "ferro", "gala", "hima", "inko", "jolt"]
    rows = []
    for i in range(900):
        words = [rng.choice(plain) + rng.choice(plain) for _ in range(rng.randint(5, 30))]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vileword", "hatename", "slurterm"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_rows_are_judged_right(spark, documents, corpus):
    labels = spark.createDataFrame([(i, x) for i, _, x in corpus], "doc_id bigint, toxic int")
    docs = documents([(i, t) for i, t, _ in corpus] + [(1000, "alba vilewrod corte dune"), (1001, None)])
    rows = T.training_rows(docs, labels)
    assert rows.count() == sum(fold(i) != 0 for i, _, _ in corpus)
    model = T.fit(rows)
    assert {"vileword", "hatename", "slurterm"} <= set(model.lexicon.words) | {w for w in ("vileword", "hatename", "slurterm") if any(w.startswith(s) for s in model.lexicon.stems)}
    found = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    held = [(i, x) for i, _, x in corpus if fold(i) == 0]
    assert all((found[i] >= 0.5) == bool(x) for i, x in held)
    assert found[1000] > found[1001] and 0 <= found[1001] < 0.5


def test_labels_of_held_out_rows_are_not_used(spark, documents, corpus):
    docs = documents([(i, t) for i, t, _ in corpus])
    right = spark.createDataFrame([(i, x) for i, _, x in corpus], "doc_id bigint, toxic int")
    wrong = spark.createDataFrame([(i, 1 - x if fold(i) == 0 else x) for i, _, x in corpus], "doc_id bigint, toxic int")
    a, b = (sorted(T.score(docs, T.fit(T.training_rows(docs, x))).collect()) for x in (right, wrong))
    assert a == b


def test_odd_rows_and_empty_tables(spark, odd, documents):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    odd_labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (3, 7)], "doc_id bigint, toxic int")
    for labels in (none, odd_labels):
        found = T.score(odd, T.fit(T.training_rows(odd, labels))).collect()
        assert len(found) == len(ODD_TEXTS) + 3 and all(0 <= r.score <= 1 for r in found)
    assert T.score(documents([]), T.fit(T.training_rows(documents([]), none))).count() == 0


def test_the_automaton_stays_bounded_and_its_answers_the_same(monkeypatch):
    rng = random.Random(8)
    terms = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randint(5, 10))) for _ in range(60)})
    lexicon = T.Lexicon({t: 1.0 + i for i, t in enumerate(terms)}, {t[:4]: 0.5 for t in terms[:9]}, {}, frozenset(terms))
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(3, 12))) for _ in range(3000)] + ["abcdef" * 50_000]
    free = [T.Finder(lexicon).look_up(w) for w in words]
    monkeypatch.setattr(T, "MOST_SETS", 200)
    finder = T.Finder(lexicon)
    assert [finder.look_up(w) for w in words] == free
    assert len(finder.automaton.sets) == 200 and max(map(len, finder.known)) <= T.CACHED_CHARS


def test_many_hits_and_quotations_take_time_in_proportion():
    finder = T.Finder(T.Lexicon({"idiot": 4.0}, {}, {}))

    def seconds(n):
        start = time.process_time()
        hits, _ = finder.hits('"idiot" idiot ' * n)
        assert [h.quoted for h in hits] == [True, False] * n
        return time.process_time() - start

    seconds(100)
    assert seconds(40_000) < 30 * max(seconds(4_000), 0.02)


def test_a_worker_keeps_the_matches_of_the_same_terms():
    one = T.Lexicon({"idiot": 4.0}, {}, {}, frozenset({"idiot"}))
    first = T.finder_of(one)
    first.hits("idoit")
    again = T.finder_of(one._replace(words=dict(one.words), context={"said": -1.5}))
    assert again is first and "idoit" in again.known and again.lexicon.context
    assert again.features("one said idiot")[6] < 0
    other = T.finder_of(one._replace(words={"idiot": 2.0}))
    assert other is not first and other.look_up("idiot") == (0, 2.0)
