"""Ranked lexical search by an Aho-Corasick scan of the documents.

The terms of all items make one automaton, each with a guard byte before and behind it, so
that it only meets whole terms of a text whose separators have all become that byte. The
texts are scanned where they lie, twice: the first scan counts the documents and terms and
the documents of each item term, the second turns the counts of a text into scores of the
items that its automaton outputs belong to and keeps each item's best documents of the
task. There is no index of the documents; only counts per term and the best documents of
each task are shuffled.

Items are dealt into blocks whose terms fit `BLOCK_BYTES` (one larger item is a block of its
own), and the documents are scanned once more for every block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, islice
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.best import Best
from plumbline.llm.store import small_batches, written
from plumbline.llm.text_arrays import Texts, pieces

# Bytes of the terms that one automaton holds; it takes some 60 times as much memory.
BLOCK_BYTES = 1 << 20
# Bytes of text that the automaton is given at once.
SEGMENT_BYTES = 1 << 20
# Matches that are turned into arrays at once, and scores that are held at once.
MATCHES = 1 << 16
SCORES = 1 << 21
# Parts in which an item's best documents are merged before the last merge.
MERGES = 32

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

GUARD = 0x20
_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[_SEPARATORS] = GUARD
_NORMAL[65:91] += 32
_NORMAL = _NORMAL.tobytes()


class Block(NamedTuple):
    """Items that are searched together; `starts` and `items` list the items of each term."""

    item_ids: list[int | None]
    terms: list[str]
    starts: np.ndarray
    items: np.ndarray


class Counts(NamedTuple):
    """Terms with repeats of each text, and (text, item term, occurrences) in order."""

    n: np.ndarray
    text: np.ndarray
    term: np.ndarray
    tf: np.ndarray


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (`item_id`, `term`); rows of one id, or of none, are one item."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    ids = F.col("item_id").cast("long").alias("item_id")
    return items.select(ids, F.explode(F.array_distinct(found)).alias("term")).distinct()


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Finds whole `terms` in guarded text; UTF-8 bytes stand as characters of one byte."""
    out = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        out.add_word(f"{chr(GUARD)}{term.encode().decode('latin-1')}{chr(GUARD)}", k)
    if terms:
        out.make_automaton()
    return out


def _segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Guarded text in pieces that begin and end with a guard, and where each begins."""
    start = 0
    while start < len(data) - 1:
        stop = data.rfind(GUARD, start + 1, start + SEGMENT_BYTES)
        if stop < 0:
            stop = data.find(GUARD, start + 1)
        yield start, data[start : stop + 1]
        start = stop


def count(found: ahocorasick.Automaton, n_terms: int, texts: Texts) -> Counts:
    """Terms of every text, and how often it holds each term of the automaton."""
    raw, n_texts = texts.data.tobytes(), len(texts.offsets) - 1
    cuts = texts.offsets.tolist()
    guard = bytes([GUARD])
    joined = guard.join([b"", *(raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)), b""]).translate(_NORMAL)
    # Behind each text there is one guard more.
    begins = texts.offsets[:-1] + np.arange(n_texts)
    n = np.zeros(n_texts, dtype=np.int64)
    keys, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at, segment in _segments(joined):
        is_guard = np.frombuffer(segment, dtype=np.uint8) == GUARD
        first = np.flatnonzero(is_guard[:-1] & ~is_guard[1:]) + at
        n += np.bincount(np.searchsorted(begins, first, side="right") - 1, minlength=n_texts)
        matches = found.iter(segment.decode("latin-1")) if n_terms else iter(())
        while some := list(islice(matches, MATCHES)):
            pairs = np.fromiter(chain.from_iterable(some), dtype=np.int64, count=2 * len(some)).reshape(-1, 2)
            # A match ends at the guard behind its term.
            text = np.searchsorted(begins, pairs[:, 0] + at - 1, side="right") - 1
            key, times = np.unique(text * n_terms + pairs[:, 1], return_counts=True)
            keys.append(key)
            sizes.append(times)
    key, of = np.unique(np.concatenate(keys), return_inverse=True)
    tf = np.zeros(len(key), dtype=np.int64)
    np.add.at(tf, of, np.concatenate(sizes))
    return Counts(n, key // max(n_terms, 1), key % max(n_terms, 1), tf)


def _scan(block: Block, texts: Callable[[Iterator[pa.RecordBatch]], Iterator], batches: Iterator[pa.RecordBatch]):
    found = automaton(block.terms)
    for rows, piece in texts(batches):
        yield rows, count(found, len(block.terms), piece)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    for batch in batches:
        yield from pieces(batch, "text")


def _blocks(terms: DataFrame, limit: int) -> Iterator[Block]:
    """The items block by block; `terms` is a written table."""
    size = F.sum(F.octet_length("term") + 16)
    whole = terms.agg(size.alias("size")).first()["size"]
    if whole is None:
        return
    biggest = terms.groupBy("item_id").agg(size.alias("size")).agg(F.max("size")).first()[0]
    n = -(-2 * whole // limit) if whole > limit else 1

    def dealt(n: int) -> DataFrame:
        return terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)))

    while n > 1 and dealt(n).groupBy("block").agg(size.alias("size")).agg(F.max("size")).first()[0] > max(limit, biggest):
        n *= 2
    for k in range(n):
        rows = dealt(n).where(F.col("block") == k).select("item_id", "term").toArrow()
        if rows.num_rows:
            yield _block(rows)


def _block(rows: pa.Table) -> Block:
    item_ids = pa.compute.unique(rows.column("item_id"))
    ids = sorted(item_ids.to_pylist(), key=lambda i: (i is None, i or 0))
    number = {i: k for k, i in enumerate(ids)}
    items = np.array([number[i] for i in rows.column("item_id").to_pylist()], dtype=np.int64)
    terms, of = np.unique(np.array(rows.column("term").to_pylist(), dtype=object), return_inverse=True)
    order = np.lexsort((items, of))
    return Block(ids, terms.tolist(), np.searchsorted(of[order], np.arange(len(terms) + 1)), items[order])


def _document_counts(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents of each term of the block."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(block.terms) + 2, dtype=np.int64)
        for _, found in _scan(block, _pieces, batches):
            df[:-2] += np.bincount(found.term, minlength=len(block.terms))
            df[-2:] += [np.count_nonzero(found.n), found.n.sum()]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(held), "df": pa.array(df[held])})

    rows = docs.select("text").mapInArrow(counted, "term bigint, df bigint")
    total = np.zeros(len(block.terms) + 2, dtype=np.int64)
    # One row for each term of the block, whatever the number of documents.
    for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect():
        total[r.term] = r.df
    return int(total[-2]), int(total[-1]), total[:-2]


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


def _block_best(docs: DataFrame, block: Block, top: int) -> DataFrame:
    n_docs, n_terms, df = _document_counts(docs, block)
    weights = term_weights(n_docs, df)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_items = len(block.item_ids)
        best = Best(n_items, top)
        best.floor[:] = 1
        per_term = np.diff(block.starts)
        for rows, found in _scan(block, _pieces, batches):
            ids = rows.column("doc_id")
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            length = 10 + 90 * found.n * n_docs // max(n_terms, 1)
            share = 1_000_000_000 * found.tf // (1000 * found.tf + 8 * length[found.text])
            gain = weights[found.term] * share
            held = np.unique(found.text)
            step = max(1, SCORES // n_items)
            for at in range(0, len(held), step):
                some = held[at : at + step]
                a, b = np.searchsorted(found.text, [some[0], some[-1] + 1])
                row, term = np.searchsorted(some, found.text[a:b]), found.term[a:b]
                times = per_term[term]
                past = np.cumsum(times) - times
                item = block.items[np.repeat(block.starts[term] - past, times) + np.arange(int(times.sum()))]
                scores = np.zeros(len(some) * n_items, dtype=np.int64)
                np.add.at(scores, np.repeat(row, times) * n_items + item, np.repeat(gain[a:b], times))
                scores = scores.reshape(len(some), n_items)
                row, item = np.nonzero(scores >= best.floor)
                best.add(item, scores[row, item], ids[some[row]], missing[some[row]])
        item, score, doc, gone = best.entries()
        names = pa.array(block.item_ids, pa.int64())
        yield pa.RecordBatch.from_pydict(
            {"item_id": names.take(pa.array(item)), "doc_id": pa.array(doc, pa.int64(), mask=gone), "score": pa.array(score)}
        )

    return docs.mapInArrow(scored, "item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The `top` documents of largest score above 0 for each of `items`.

    `docs` has `doc_id` and `text`, `items` has `item_id` and `text`. NULL and empty texts
    have no term: such documents aren't counted or found, such items have no result.
    Texts of any length are scanned whole, a segment at a time. Every row is a document of
    its own, so repeated rows are counted and ranked each; equal scores go by `doc_id`,
    NULL ids last. Items without an id are one item. Empty tables give an empty result;
    other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    terms = written(item_terms(items), "item-terms")
    found = [_block_best(docs, block, top) for block in _blocks(terms, block_bytes)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    rows = reduce(DataFrame.unionAll, found)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # Every task lists an item's best documents: merged in parts first, then the rest.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(MERGES))
    place = F.row_number().over(Window.partitionBy("item_id", part).orderBy(*order))
    few = rows.withColumn("place", place).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return few.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents),
n AS (SELECT r, doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
  FROM benchmark),
t AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM n)
  WHERE term IN (SELECT term FROM q) GROUP BY r, term),
f AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
g AS (
  SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS gain
  FROM t JOIN n USING (r) JOIN f USING (term), s),
x AS (SELECT item_id, r, sum(gain)::BIGINT AS score FROM g JOIN q USING (term) GROUP BY item_id, r),
y AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r))::INT AS rank, doc_id, score
  FROM x JOIN n USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 10
"""
