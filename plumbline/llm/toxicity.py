"""Toxicity scores from a learned lexicon, matched with spelling errors, read in context.

1. From labelled training rows, words and word stems whose log odds towards the toxic
   label are significant become the lexicon, kept as a trie.
2. A Levenshtein automaton of every term at once is the product of the trie with an edit
   budget (neighbouring letters swapped count as one edit). Its states are made as words
   need them and kept, so most words cost a few dictionary look-ups.
3. Each hit is read in a window: inside quotation marks or not, and next to which words.
   The words that tell quotation from abuse are learned from the hits of training rows.
4. A logistic regression on what the hits add up to gives the score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.language_id import fold_of
from plumbline.llm.store import small_batches

# Labelled training rows that the model is fitted on, at most, taken by a hash of the id.
FIT_ROWS = 30_000
# Lexicon terms and context words kept, at most, the most significant first.
MAX_TERMS = 5_000
MIN_TOXIC_ROWS = 4
TERM_Z = 4.5
CONTEXT_Z = 3.5
STEM_LENGTHS = range(4, 9)
# Words on either side of a hit that make up its context.
WINDOW = 5
# Words whose matches are kept in a task, before the store is emptied.
CACHED_WORDS = 200_000
# Words longer than this are looked up each time they are met.
CACHED_CHARS = 64
# Sets of the automaton that a worker keeps; those met later are made again each time.
MOST_SETS = 60_000
FEATURES = 9
# Weights where the training rows say nothing: hits outside quotation marks count most.
PRIOR = (1.5, 1.5, 1.5, 0.3, 0.3, 0.3, 0.5, 0.2, 1.0)

# Letters, also with signs or digits between them that stand for letters.
WORD = re.compile(r"[^\W\d_]+(?:[*@$!0-9]+[^\W\d_]+)*")
OPENING = re.compile('["“«„]')
# What ends a quotation, or its line.
CLOSING = {a: re.compile(f"[{b}\n]") for a, b in (('"', '"'), ("“", "”"), ("«", "»"), ("„", "“”"))}


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans from an opening mark to the one that closes it on the same line, however long.

    Time is proportional to the length: a mark that no other closes is looked for once a line.
    """
    spans, at = [], 0
    unclosed = dict.fromkeys(CLOSING, 0)
    for m in OPENING.finditer(text):
        start = m.start()
        if start < at or start < unclosed[m[0]]:
            continue
        end = CLOSING[m[0]].search(text, start + 1)
        if end is None or end[0] == "\n":
            unclosed[m[0]] = end.start() if end else len(text)
        elif end.start() > start + 1:
            spans.append((start, end.end()))
            at = end.end()
    return spans


class Trie:
    """Terms as a trie of numbered nodes; a node ends a word, a stem, or neither."""

    def __init__(self, words: Iterable[str], stems: Iterable[str], misspelled: frozenset[str]) -> None:
        edits = {w: edits_allowed(len(w)) if w in misspelled else 0 for w in words}
        self.edits, self.stem_edits = edits, {s: edits_allowed(len(s)) for s in stems}
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, str] = {}
        self.stem: dict[int, str] = {}
        self.allowed = [0]
        for ends, terms in ((self.word, self.edits), (self.stem, self.stem_edits)):
            for term in terms:
                node, allowed = 0, terms[term]
                self.allowed[0] = max(self.allowed[0], allowed)
                for char in term:
                    if char not in self.children[node]:
                        self.children[node][char] = len(self.children)
                        self.children.append({})
                        self.allowed.append(0)
                    node = self.children[node][char]
                    self.allowed[node] = max(self.allowed[node], allowed)
                ends[node] = term


class Automaton:
    """The trie times the number of edits so far, made deterministic as it is used.

    A set holds (node, edits, awaited letter); the letter is awaited after a swap.
    """

    def __init__(self, trie: Trie) -> None:
        self.trie = trie
        self.sets: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        # The nearest stem that ends in each set, if any does.
        self.near_stem: list[tuple[int, str] | None] = []
        self.start = self._state(self._closed({(0, 0, "")}))

    def _closed(self, states: set) -> frozenset:
        """With the letters of a term that a word may leave out; only the fewest edits kept."""
        best: dict[tuple[int, str], int] = {}
        todo = list(states)
        while todo:
            node, edits, awaited = todo.pop()
            if edits > self.trie.allowed[node] or best.get((node, awaited), 9) <= edits:
                continue
            best[node, awaited] = edits
            if not awaited:
                todo += [(child, edits + 1, "") for child in self.trie.children[node].values()]
        return frozenset((node, edits, awaited) for (node, awaited), edits in best.items())

    def _nearest_stem(self, states: frozenset) -> tuple[int, str] | None:
        ends = self.trie.stem
        found = [
            (edits, ends[node])
            for node, edits, awaited in states
            if not awaited and node in ends and edits <= self.trie.stem_edits[ends[node]]
        ]
        return min(found) if found else None

    def _state(self, states: frozenset) -> int | frozenset:
        """The number of a set that is kept (-1 for the empty one), or a set that there was no room for."""
        if not states:
            return -1
        if states not in self.numbers:
            if len(self.sets) >= MOST_SETS:
                return states
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            self.near_stem.append(self._nearest_stem(states))
        return self.numbers[states]

    def _members(self, state: int | frozenset) -> frozenset:
        return self.sets[state] if isinstance(state, int) else state

    def _move(self, state: int | frozenset, char: str) -> int | frozenset:
        children, out = self.trie.children, set()
        for node, edits, awaited in self._members(state):
            if awaited:
                if char == awaited:
                    out.add((node, edits, ""))
                continue
            if char in children[node]:
                out.add((children[node][char], edits, ""))
            if edits < self.trie.allowed[node]:
                out.add((node, edits + 1, ""))
                for label, child in children[node].items():
                    out.add((child, edits + 1, ""))
                    if label != char and char in children[child]:
                        out.add((children[child][char], edits + 1, label))
        return self._state(self._closed(out))

    def _step(self, state: int | frozenset, char: str) -> int | frozenset:
        if not isinstance(state, int):
            return self._move(state, char)
        moves = self.moves[state]
        if char in moves:
            return moves[char]
        found = self._move(state, char)
        if isinstance(found, int):
            moves[char] = found
        return found

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest word term within its edits, ties by the term itself."""
        state = self.start
        for char in word:
            state = self._step(state, char)
            if state == -1:
                return None
        ends = self.trie.word
        found = [
            (edits, ends[node])
            for node, edits, awaited in self._members(state)
            if not awaited and node in ends and edits <= self.trie.edits[ends[node]]
        ]
        return min(found)[::-1] if found else None

    def misspelled_stem(self, word: str) -> tuple[str, int] | None:
        """The nearest stem within its edits of a beginning of the word, ties by the stem itself."""
        state, best = self.start, None
        for char in word:
            state = self._step(state, char)
            if state == -1:
                break
            near = self.near_stem[state] if isinstance(state, int) else self._nearest_stem(state)
            best = near if best is None else best if near is None else min(best, near)
        return best[::-1] if best else None

    def stem(self, word: str) -> str | None:
        """The longest stem that the word begins with."""
        node, found = 0, None
        for char in word:
            node = self.trie.children[node].get(char, -1)
            if node < 0:
                break
            found = self.trie.stem.get(node, found)
        return found


class Lexicon(NamedTuple):
    """Terms with their log odds, and context words with theirs (positive: abuse)."""

    words: dict[str, float]
    stems: dict[str, float]
    context: dict[str, float]
    misspelled: frozenset[str] = frozenset()


class Hit(NamedTuple):
    kind: int
    weight: float
    quoted: bool
    near: list[str]


class Finder:
    """Hits of a lexicon in texts; holds the automaton and the matches found so far."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.automaton = Automaton(Trie(lexicon.words, lexicon.stems, lexicon.misspelled))
        self.known: dict[str, tuple[int, float] | None] = {}

    def look_up(self, word: str) -> tuple[int, float] | None:
        """(0 exact, 1 stem or 2 misspelled, of words and stems; weight) of a word, or None."""
        found = self.automaton.match(word) if self.lexicon.words else None
        if found and found[1] == 0:
            out = (0, self.lexicon.words[found[0]])
        elif stem := self.automaton.stem(word):
            out = (1, self.lexicon.stems[stem])
        elif found:
            out = (2, self.lexicon.words[found[0]] / (1 + found[1]))
        elif near := self.automaton.misspelled_stem(word):
            out = (2, self.lexicon.stems[near[0]] / (1 + near[1]))
        else:
            out = None
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        if len(word) <= CACHED_CHARS:
            self.known[word] = out
        return out

    def hits(self, text: str) -> tuple[list[Hit], int]:
        """All hits of a text with their context, and its number of words."""
        known, look_up = self.known, self.look_up
        lowered = text.lower()
        tokens = WORD.findall(lowered)
        at = [i for i, w in enumerate(tokens) if (known[w] if w in known else look_up(w)) is not None]
        if not at:
            return [], len(tokens)
        spans = quotations(lowered)
        places = [m.start() for m in WORD.finditer(lowered)] if spans else []
        begins = [a for a, _ in spans]
        out = []
        for i in at:
            kind, weight = known.get(tokens[i]) or look_up(tokens[i])
            span = bisect_left(begins, places[i]) - 1 if spans else -1
            quoted = span >= 0 and places[i] < spans[span][1]
            out.append(Hit(kind, weight, quoted, tokens[max(i - WINDOW, 0) : i] + tokens[i + 1 : i + 1 + WINDOW]))
        return out, len(tokens)

    def features(self, text: str | None) -> list[float]:
        """What the hits of a text add up to; an empty text has none."""
        hits, n_words = self.hits(text or "")
        sums = [0.0] * 6
        window = strongest = 0.0
        for hit in hits:
            sums[hit.kind + 3 * hit.quoted] += hit.weight
            score = sum(self.lexicon.context.get(w, 0.0) for w in set(hit.near))
            window += max(-3.0, min(3.0, score))
            strongest = max(strongest, 0.0 if hit.quoted else hit.weight)
        return [
            *(math.log1p(max(s, 0.0)) for s in sums),
            window / max(len(hits), 1),
            strongest,
            math.log1p(50.0 * len(hits) / n_words) if n_words else 0.0,
        ]


_KEPT: dict[str, object] = {}


def finder_of(lexicon: Lexicon) -> Finder:
    """The finder of a worker process: one for the same terms, made for an earlier task, goes on."""
    terms = (lexicon.words, lexicon.stems, lexicon.misspelled)
    if _KEPT.get("terms") != terms:
        _KEPT.update(terms=terms, finder=Finder(lexicon))
    found = _KEPT["finder"]
    # Matches depend on the terms alone, the features on the context words too.
    found.lexicon = lexicon
    return found


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray


def odds(toxic: str, rest: str, all_toxic: int, all_rest: int) -> tuple[F.Column, F.Column]:
    """Log odds ratio of a term towards the toxic label, and the signed root of its likelihood ratio."""
    a, b = F.col(toxic) + 0.5, F.col(rest) + 0.5
    ratio = F.log(a / (all_toxic + 1.0 - a)) - F.log(b / (all_rest + 1.0 - b))
    share = all_toxic / max(all_toxic + all_rest, 1)
    gain = F.lit(0.0)
    for seen, of in ((F.col(toxic), share), (F.col(rest), 1 - share)):
        expected = (F.col(toxic) + F.col(rest)) * of
        gain = gain + F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    over = F.col(toxic) > (F.col(toxic) + F.col(rest)) * share
    root = F.sqrt(F.greatest(2 * gain, F.lit(0.0)))
    return ratio, F.when(over, root).otherwise(-root)


COUNTED = "kind int, term string, n_rest bigint, n_toxic bigint"


def _counts(batches: Iterator[pa.RecordBatch], terms_of) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, str], list[int]] = defaultdict(lambda: [0, 0])

    def emit() -> pa.RecordBatch:
        keys, values = list(counts), list(counts.values())
        counts.clear()
        return pa.RecordBatch.from_pydict(
            {
                "kind": pa.array([k for k, _ in keys], pa.int32()),
                "term": pa.array([t for _, t in keys], pa.string()),
                "n_rest": pa.array([v[0] for v in values], pa.int64()),
                "n_toxic": pa.array([v[1] for v in values], pa.int64()),
            }
        )

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for key in terms_of(text or ""):
                counts[key][toxic] += 1
            if len(counts) > CACHED_WORDS:
                yield emit()
    yield emit()


def _terms(text: str) -> set[tuple[int, str]]:
    found = {w for w in WORD.findall(text.lower()) if len(w) >= 3}
    return {(0, w) for w in found} | {(1, w[:n]) for w in found for n in STEM_LENGTHS if n < len(w)}


def _significant(rows: DataFrame, terms_of, totals: tuple[int, int], z: float, both: bool) -> list:
    """Terms with significant odds, the most significant first."""
    counted = (
        rows.mapInArrow(lambda it: _counts(it, terms_of), COUNTED)
        .groupBy("kind", "term")
        .agg(F.sum("n_rest").alias("n_rest"), F.sum("n_toxic").alias("n_toxic"))
    )
    ratio, error = odds("n_toxic", "n_rest", totals[1], totals[0])
    scored = counted.select("*", ratio.alias("weight"), error.alias("z"))
    chosen = F.abs("z") >= z if both else (F.col("z") >= z) & (F.col("n_toxic") >= MIN_TOXIC_ROWS)
    return scored.where(chosen).orderBy(F.abs("z").desc(), "kind", "term").limit(MAX_TERMS).collect()


def lexicon_of(rows: list) -> Lexicon:
    """Words and stems from significant terms.

    A stem stands for the words under it unless one word makes up most of it; the
    shortest stem that will do is taken. Words under it stay terms beside it, so that
    their misspellings are found; all terms have the edits that their length allows.
    """
    words = {r.term: r for r in rows if r.kind == 0}
    stems = sorted((r for r in rows if r.kind == 1), key=lambda r: (len(r.term), r.term))
    taken: dict[str, float] = {}
    for r in stems:
        if any(r.term[:n] in taken for n in range(1, len(r.term))):
            continue
        if not any(w.startswith(r.term) and x.n_toxic >= 0.8 * r.n_toxic for w, x in words.items()):
            taken[r.term] = r.weight
    return Lexicon({w: r.weight for w, r in words.items()}, taken, {}, frozenset(words))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression drawn towards PRIOR, the intercept last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    prior = np.append(np.array(PRIOR), 0.0)
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (keep * (w - prior) ** 2).sum())

    w = prior.copy()
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    best = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - keep * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), gradient)
        # Halved until it helps: far out, a whole step can overshoot.
        while np.abs(step).max() > 1e-9 and loss(w + step) > best:
            step /= 2
        if np.abs(step).max() <= 1e-9:
            break
        w = w + step
        best = loss(w)
    return w


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """Texts and labels of at most `limit` labelled ids outside fold 0.

    Ids are taken in the order of their hash. Several labels of an id count as toxic if
    one of them does; labels other than 0 and 1, NULL included, are no labels.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold_of() != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # A share of the hashes that holds somewhat more than is wanted, so that little is sorted.
    share = min(1.0, 1.2 * limit / max(known.count(), 1))
    low = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 33) < share * (1 << 31))
    chosen = low.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def fit(rows: DataFrame) -> Model:
    """A model from `text` and `toxic`, read three times; give a written table of bounded size."""
    counted = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    totals = (counted.get(0, 0), counted.get(1, 0))
    lexicon = lexicon_of(_significant(rows, _terms, totals, TERM_Z, both=False)) if min(totals) else Lexicon({}, {}, {})

    def context(text: str) -> set[tuple[int, str]]:
        return {(0, w) for hit in finder_of(lexicon).hits(text)[0] for w in hit.near}

    def any_hit(text: str) -> list[tuple[int, str]]:
        return [(0, "")] if finder_of(lexicon).hits(text)[0] else []

    around = []
    if lexicon.words or lexicon.stems:
        # Words near hits are weighed against all texts with hits, not against all texts.
        with_hits = rows.mapInArrow(lambda it: _counts(it, any_hit), COUNTED).agg(F.sum("n_rest"), F.sum("n_toxic")).first()
        around = _significant(rows, context, (with_hits[0] or 0, with_hits[1] or 0), CONTEXT_Z, both=True)
    # What both labels show near hits tells them apart; a word met beside one label only may be chance.
    told = {r.term: float(np.clip(r.weight, -2, 2)) for r in around if r.n_rest >= MIN_TOXIC_ROWS and r.n_toxic >= MIN_TOXIC_ROWS}
    lexicon = lexicon._replace(context=told)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = finder_of(lexicon)
        for batch in batches:
            values = [found.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"f": pa.array(values, pa.list_(pa.float64())), "toxic": batch.column("toxic")})

    # Texts without a hit are alike; they come as one row each with a count.
    measured = rows.mapInArrow(measure, "f array<double>, toxic int").groupBy("f", "toxic").count().collect()
    if not measured:
        return Model(lexicon, np.append(np.array(PRIOR), -5.0))
    x = np.repeat(np.array([r.f for r in measured]), [r["count"] for r in measured], axis=0)
    y = np.repeat(np.array([r.toxic for r in measured], dtype=float), [r["count"] for r in measured])
    return Model(lexicon, logistic(x, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id` and `score` (0 to 1) of every row; NULL and empty texts score like texts without a hit.

    Repeated rows each get their row; an empty table gives an empty result; columns
    other than `doc_id` and `text` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = finder_of(model.lexicon)
        for batch in batches:
            x = np.array([found.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES)
            z = np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(1 / (1 + np.exp(-z)))})

    small_batches(docs.sparkSession)
    schema = docs.select("doc_id").schema.add("score", "double")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
