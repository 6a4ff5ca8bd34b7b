"""Language identification by error-correcting output codes over byte n-grams.

Every language gets a codeword of +1/-1 bits. For each bit a naive Bayes classifier on
byte pairs and triples tells the languages whose bit is +1 from the others. A text's
bit margins are compared with every codeword by a weighted logistic loss, and the
nearest codeword names the language. Where the second nearest is almost as near, the
text is ambiguous.

Counts come from all labelled training rows, summed by Spark. What reaches the driver
is one number per language and n-gram bucket, whatever the size of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import small_batches
from plumbline.llm.text_arrays import Texts, pieces, texts_of

PAIRS = 1 << 13
TRIPLES = 1 << 13
FEATURES = PAIRS + TRIPLES
SMOOTHING = 0.5
# Texts whose n-grams are counted at once.
COUNTED = 32
# Losses this close (as a share of the second) make a text ambiguous.
AMBIGUOUS_SHARE = 0.02
UNDETERMINED = "und"
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
# Letters in lower case, digits and marks of ASCII as one blank, the rest as it is.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)


class Model(NamedTuple):
    """Languages, their codewords, n-gram weights per bit, and what a bit is worth."""

    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    scale: np.ndarray


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """`n` codewords of bits in {-1, 1}, far apart; no bit is the same for all languages.

    The best of a fixed number of seeded draws, judged by the smallest distance.
    """
    bits = max(15, int(np.ceil(10 * np.log2(max(n, 2)))))
    if n < 2:
        return np.ones((n, bits), dtype=np.int8)
    rng = np.random.default_rng(seed)
    best, best_distance = None, -1
    for _ in range(200 if n <= 64 else 5):
        draw = rng.choice(np.array([-1, 1], dtype=np.int8), (n, bits))
        same = np.abs(draw.sum(axis=0)) == n
        draw[rng.integers(0, n, same.sum()), np.flatnonzero(same)] *= -1
        apart = (bits - draw.astype(np.int32) @ draw.T) // 2 + bits * np.eye(n, dtype=np.int32)
        if apart.min() > best_distance:
            best, best_distance = draw, int(apart.min())
    return best


def features(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the byte pairs and of the byte triples, text by text, and where each text's begin.

    None crosses a text's end; pairs of blanks say nothing.
    """
    data = _FOLD[texts.data].astype(np.uint32)
    offsets = texts.offsets
    if len(data) < 3:
        data = np.concatenate([data, np.full(3, 32, np.uint32)])
    pair = (data[:-1] << np.uint32(8)) | data[1:]
    triple = (pair[:-1] * np.uint32(256) + data[2:]) * np.uint32(0x9E3779B1) >> np.uint32(19)
    ends = offsets[1:][offsets[1:] > offsets[:-1]]
    keep2 = pair != 0x2020
    keep3 = keep2[:-1] & keep2[1:]
    for keep, backs in ((keep2, (1,)), (keep3, (1, 2))):
        for back in backs:
            at = ends - back
            keep[at[(at >= 0) & (at < len(keep))]] = False
    keep2[max(len(texts.data) - 1, 0) :] = False
    keep3[max(len(texts.data) - 2, 0) :] = False
    out = []
    for keep, bucket in ((keep2, pair * np.uint32(0x85EBCA77) >> np.uint32(19)), (keep3, triple + np.uint32(PAIRS))):
        at = np.flatnonzero(keep)
        out.append((bucket[at], np.searchsorted(at, offsets)))
    return out


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for part, texts in pieces(batch, "text"):
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            for buckets, offsets in features(texts):
                of = np.repeat(np.arange(len(langs)), np.diff(offsets))
                for lang in set(langs):
                    counts = np.bincount(buckets[(langs == lang)[of]], minlength=FEATURES)
                    totals[lang] = totals[lang] + counts if lang in totals else counts
    for lang, counts in totals.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([lang] * len(used), pa.string()),
                "bucket": pa.array(used.astype(np.int32)),
                "n": pa.array(counts[used]),
            }
        )


def fit(labelled: DataFrame) -> Model:
    """A model from the columns `text` and `lang`; rows where either is NULL are left out."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counted = (
        rows.mapInArrow(_count_rows, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    ).toPandas()
    langs = sorted(counted["lang"].unique())
    table = np.zeros((len(langs), FEATURES))
    table[counted["lang"].map({x: i for i, x in enumerate(langs)}), counted["bucket"]] = counted["n"]
    return model_of(langs, table)


def model_of(langs: list[str], table: np.ndarray) -> Model:
    codes = codewords(len(langs))
    if len(langs) < 2:
        return Model(langs, codes, np.zeros((FEATURES, codes.shape[1]), np.float32), np.ones(codes.shape[1]))
    # A language is a distribution, whatever its share of the rows.
    share = (table + SMOOTHING) / (table + SMOOTHING).sum(axis=1, keepdims=True)
    weights, scale = [], []
    for bit in codes.T:
        ratio = np.log(share[bit > 0].mean(axis=0)) - np.log(share[bit < 0].mean(axis=0))
        expected = share @ ratio
        middle = (expected[bit > 0].mean() + expected[bit < 0].mean()) / 2
        weights.append(ratio - middle)
        # How far a language's own mean lies on its side, at the least.
        scale.append(max(float((bit * (expected - middle)).min()), 0.05))
    return Model(langs, codes, np.array(weights).T.astype(np.float32), np.array(scale))


def decode(margins: np.ndarray, model: Model) -> np.ndarray:
    """Loss of every codeword for every text. Bits count by how well they separate."""
    worth = model.scale / model.scale.sum()
    each = np.logaddexp(0.0, -4.0 * margins[:, None, :] / model.scale * model.codes[None])
    return each @ worth


def predict(texts: Texts, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score in 0..1 and ambiguity of each text."""
    n = len(texts.offsets) - 1
    sums = np.zeros((n, model.codes.shape[1]))
    size = np.zeros(n, dtype=np.int64)
    for buckets, offsets in features(texts):
        size += np.diff(offsets)
        for first in range(0, n, COUNTED):
            last = min(first + COUNTED, n)
            own = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
            cells = own * FEATURES + buckets[offsets[first] : offsets[last]]
            counts = np.bincount(cells, minlength=(last - first) * FEATURES)
            sums[first:last] += counts.reshape(-1, FEATURES).astype(np.float32) @ model.weights
    margins = sums / np.maximum(size, 1)[:, None]
    hits = np.concatenate([[0], np.cumsum(_ASCII_LETTER[texts.data])])
    lettered = (hits[texts.offsets[1:]] - hits[texts.offsets[:-1]]) > 0
    for i in np.flatnonzero(~lettered & (np.diff(texts.offsets) > 0)):
        raw = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().decode("utf-8", "replace")
        lettered[i] = any(c.isalpha() for c in raw)
    if not model.langs:
        return [UNDETERMINED] * n, np.zeros(n), np.zeros(n, dtype=bool)
    loss = decode(margins, model)
    order = np.argsort(loss, axis=1, kind="stable")
    best = order[:, 0]
    near = loss[np.arange(n), best]
    if len(model.langs) > 1:
        chance = np.exp(-8.0 * (loss - near[:, None]))
        score = 1.0 / chance.sum(axis=1)
        second = loss[np.arange(n), order[:, 1]]
        ambiguous = (second - near) < AMBIGUOUS_SHARE * second
    else:
        score, ambiguous = np.ones(n), np.zeros(n, dtype=bool)
    names = [model.langs[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
    return names, np.where(lettered, score, 0.0), ambiguous & lettered


def _with_predictions(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "_text"):
                names, score, ambiguous = predict(texts, model)
                columns = {name: part.column(name) for name in part.schema.names if name != "_text"}
                columns |= {
                    "lang_pred": pa.array(names, pa.string()),
                    "lang_score": pa.array(score, pa.float64()),
                    "lang_ambiguous": pa.array(ambiguous, pa.bool_()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _predicted(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns c0, c1, ... for `keep` and the three of the prediction, whatever the names in `docs`."""
    named = [F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(keep)]
    schema = docs.select(*named).schema
    schema = schema.add("lang_pred", "string").add("lang_score", "double").add("lang_ambiguous", "boolean")
    small_batches(docs.sparkSession)
    return docs.select(*named, F.col("text").alias("_text")).mapInArrow(_with_predictions(model), schema)


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs` with `lang_pred`, `lang_score` and `lang_ambiguous`.

    A text that is NULL or has no letter is `und` with score 0 and not ambiguous.
    Repeated rows each get their row; an empty table gives an empty result; without
    any labelled row every text is `und`. A kept column named like one of the three
    new ones gives way to it.
    """
    new = ("lang_pred", "lang_score", "lang_ambiguous")
    kept = [name for name in keep if name not in new]
    return _predicted(docs, model, kept).toDF(*kept, *new)


def clearly_told(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` whose language is told, not `und` and not ambiguous; same columns."""
    found = _predicted(docs, model, docs.columns)
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & ~F.col("lang_ambiguous"))
    return kept.drop("lang_pred", "lang_score", "lang_ambiguous").toDF(*docs.columns)


def fold_of(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text modulo 5; a NULL id counts as fold 0, never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(0))


def fold_of_value(doc_id: int | None) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Learn from rows outside fold 0 and predict every row."""
    model = fit(docs.where(fold_of() != 0))
    marked = docs.select("doc_id", "text", (fold_of() == 0).alias("held_out"))
    return identify(marked, model, ["doc_id", "held_out"])


def texts_from(values: list[str | None]) -> Texts:
    return texts_of(pa.array(values, pa.string()))
