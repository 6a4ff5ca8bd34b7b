"""Benchmark decontamination by a prefix-filtered join of word shingles.

A window is WINDOW words of a benchmark item in a row, or the whole of a shorter item.
A document holds a window only if it holds every shingle of it, so one shingle is enough
to find all candidates: the prefix of length one, in the order of rarity among the
documents. Documents are scanned twice, once to count the benchmark's shingles and once
to look for the rarest one of each window. Where it is found, the place of the shingle
in the window and the lengths of both must fit, and then all words of the window are
compared.

Both scans filter shingles by a bitmap of fixed greatest size. What passes by chance is
rejected by the joins, so the bitmap bears on speed alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import BROADCAST_BYTES, broadcast_if_small, temporary, written
from plumbline.llm.text_arrays import ALNUM, ngram_hashes, pieces, word_hashes, words

WINDOW = 13
SHINGLE = 4
# A document is contaminated if at least one word in so many is hit.
HIT_SHARE = 20
MOST_BITS = 1 << 28

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _windows(batches: Iterator[pa.RecordBatch], window: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in pieces(batch, "text"):
            found = words(texts, ALNUM)
            hashes = word_hashes(texts, found)
            raw = texts.data.tobytes().translate(_LOWER)
            spoken = [raw[a:b].decode() for a, b in zip(found.starts, found.ends, strict=True)]
            ids, held, grams = [], [], []
            for i, item in enumerate(part.column("item_id").to_pylist()):
                first, last = int(found.offsets[i]), int(found.offsets[i + 1])
                n = min(window, last - first)
                for at in range(first, last - n + 1) if n else ():
                    k = min(size, n)
                    ids.append(item)
                    held.append(spoken[at : at + n])
                    grams.append(ngram_hashes(hashes[at : at + n], k).view(np.int64))
            yield pa.RecordBatch.from_pydict(
                {
                    "item_id": pa.array(ids, pa.string()),
                    "held": pa.array(held, pa.list_(pa.string())),
                    "grams": pa.array(grams, pa.list_(pa.int64())),
                }
            )


class Bitmap:
    """Which hashes may be among those of a column; at most MOST_BITS bits."""

    def __init__(self, hashes: DataFrame) -> None:
        n = hashes.count()
        self.bits = min(MOST_BITS, max(1 << 16, 1 << int(16 * max(n, 1)).bit_length()))
        placed = hashes.select(F.shiftrightunsigned("gram", 64 - (self.bits.bit_length() - 1)).alias("place"))
        cells = placed.selectExpr("place div 64 AS cell", "shiftleft(1L, cast(place % 64 AS int)) AS bit")
        cells = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()
        self.cells = np.zeros(self.bits // 64, dtype=np.int64)
        self.cells[cells["cell"].to_numpy()] = cells["bits"].to_numpy()

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - (self.bits.bit_length() - 1))
        cell = self.cells[(place >> np.uint64(6)).astype(np.int64)].view(np.uint64)
        return (cell >> (place & np.uint64(63))) & np.uint64(1) == 1


def _grams(texts, found, sizes: list[int], bitmap: Bitmap) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: the hashes that may be the benchmark's, their first words, their texts."""
    hashes = word_hashes(texts, found)
    for k in sizes:
        grams = ngram_hashes(hashes, k)
        at = np.flatnonzero(bitmap.may_hold(grams))
        of = np.searchsorted(found.offsets, at, side="right") - 1
        inside = at + k <= found.offsets[of + 1]
        yield k, grams[at[inside]], at[inside], of[inside]


def digest(text: str = "text") -> Column:
    """With the id, tells rows apart whose texts differ."""
    return F.xxhash64(F.col(text))


def windows_of(items: DataFrame, window: int = WINDOW, size: int = SHINGLE) -> DataFrame:
    """Windows of every item: `item_id` as a string, `held` (words) and `grams` (shingles)."""
    rows = items.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    schema = "item_id string, held array<string>, grams array<bigint>"
    return rows.mapInArrow(lambda it: _windows(it, window, size), schema)


def frequencies(docs: DataFrame, bitmap: Bitmap, sizes: list[int]) -> DataFrame:
    """How often each shingle that may be the benchmark's occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [np.empty(0, np.uint64)]
            for _, texts in pieces(batch, "text"):
                seen += [g for _, g, _, _ in _grams(texts, words(texts, ALNUM), sizes, shared.value)]
            values, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(values.view(np.int64)), "n": pa.array(n)})

    counted = docs.select("text").mapInArrow(count, "gram bigint, n bigint")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, bitmap: Bitmap, sizes: list[int], window: int) -> DataFrame:
    """`doc_id`, `digest`, `n_words` of every row and where prefix shingles may be.

    A candidate has the shingle, its place, the words around it and the place of the
    first of those.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                found = words(texts, ALNUM)
                listed: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for k, grams, at, of in _grams(texts, found, sizes, shared.value):
                    for gram, i, doc in zip(grams.view(np.int64).tolist(), at.tolist(), of.tolist(), strict=True):
                        begin, end = int(found.offsets[doc]), int(found.offsets[doc + 1])
                        first, last = max(begin, i - window + 1), min(end, i + window)
                        raw = texts.data[found.starts[first] : found.ends[last - 1]].tobytes().translate(_LOWER)
                        base = found.starts[first]
                        near = [raw[a - base : b - base].decode() for a, b in zip(found.starts[first:last], found.ends[first:last], strict=True)]
                        listed[doc].append({"gram": gram, "at": i - begin, "first": first - begin, "near": near})
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "digest": part.column("digest"),
                        "n_words": pa.array(np.diff(found.offsets).astype(np.int64)),
                        "found": pa.array(listed, _FOUND),
                    }
                )

    rows = docs.select("doc_id", digest().alias("digest"), "text")
    schema = docs.select("doc_id").schema.add("digest", "long").add("n_words", "long")
    for field in docs.sparkSession.createDataFrame([], _FOUND_DDL).schema:
        schema = schema.add(field)
    return rows.mapInArrow(scan, schema)


_FOUND = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("near", pa.list_(pa.string()))]))
_FOUND_DDL = "found array<struct<gram: bigint, at: bigint, first: bigint, near: array<string>>>"


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, size: int = SHINGLE) -> DataFrame:
    """One row per row of `docs`: what of it occurs in windows of `items`.

    `doc_id`, `digest`, `n_words`, `n_hit`, `n_items`, `items_sha256` and `contaminated`.
    NULL and empty texts have no words and are clean; items without words have no window.
    Repeated rows each get their row, and rows that share an id are told apart by their
    texts. Repeated items count once per `item_id`. Without items nothing is hit. Columns
    other than the ids and `text` are not read.
    """
    held = written(windows_of(items, window, size), "windows")
    grams = held.select(F.explode("grams").alias("gram")).distinct()
    sizes = [r.k for r in held.select(F.least(F.size("held"), F.lit(size)).alias("k")).distinct().orderBy("k").collect()]
    counted = written(frequencies(docs, Bitmap(grams), sizes), "gram-counts")
    # The rarest shingle of each window, the first of them in a tie.
    parts = held.select("held", "grams").distinct().select("held", F.posexplode("grams").alias("offset", "gram"))
    rare = parts.join(counted, "gram", "left").groupBy("held").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "gram")).alias("rarest")
    )
    # A shingle that no document holds leaves nothing to look for.
    prefixes = written(rare.where("rarest.n > 0").select("held", "rarest.offset", "rarest.gram"), "window-prefixes")
    scanned = written(candidates(docs, Bitmap(prefixes.select("gram").distinct()), sizes, window), "candidates")

    room = prefixes.agg(F.sum(F.expr("aggregate(held, 0L, (n, w) -> n + octet_length(w) + 16)"))).first()[0] or 0
    small = F.broadcast(prefixes) if room <= BROADCAST_BYTES else prefixes
    spots = scanned.select("doc_id", "digest", "n_words", F.explode("found").alias("f"))
    spots = spots.select("doc_id", "digest", "n_words", "f.gram", "f.at", "f.first", "f.near")
    start, length = F.col("at") - F.col("offset"), F.size("held")
    fits = (start >= 0) & (start + length <= F.col("n_words"))
    same = F.slice("near", (start - F.col("first") + 1).cast("int"), length) == F.col("held")
    hits = written(
        spots.join(small, "gram").where(fits).where(same).select("doc_id", "digest", start.alias("start"), "held").distinct(),
        "window-hits",
    )

    place = F.explode(F.sequence(F.col("start"), F.col("start") + F.size("held") - 1))
    n_hit = hits.select("doc_id", "digest", place.alias("place")).distinct().groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n_hit"))
    listing = held.select("held", "item_id").distinct()
    listing = F.broadcast(listing) if room <= BROADCAST_BYTES and held.count() <= BROADCAST_BYTES >> 9 else listing
    of_items = hits.select("doc_id", "digest", "held").distinct().join(listing, "held").select("doc_id", "digest", "item_id").distinct()
    named = of_items.groupBy("doc_id", "digest").agg(
        F.count("item_id").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("names")
    )
    told = n_hit.alias("a").join(named.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest")), "left")
    told = told.select("a.doc_id", "a.digest", "n_hit", "n_items", "names")
    on = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.digest") == F.col("t.digest"))
    joined = scanned.select("doc_id", "digest", "n_words").alias("d").join(told.alias("t"), on, "left")
    found = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return joined.select(
        "d.doc_id", "d.digest", "n_words", found.alias("n_hit"),
        F.coalesce(F.col("n_items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.col("names"), F.lit("")), 256).alias("items_sha256"),
        ((found > 0) & (HIT_SHARE * found >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that aren't contaminated, with all their columns."""
    with temporary(docs.sparkSession):
        found = contamination(docs, items).where("contaminated").select("doc_id", "digest").distinct()
        bad = written(found, "contaminated-ids", keep=True)
    rejected = broadcast_if_small(bad, 64)
    same = docs["doc_id"].eqNullSafe(rejected["doc_id"]) & (F.xxhash64(docs["text"]) == rejected["digest"])
    return docs.join(rejected, same, "left_anti")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT item_id, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS held, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS held
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT p.doc_id, p.i, p.n, w.item_id FROM places p JOIN windows w ON p.held = w.held AND p.n = w.n),
spots AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
  FROM hits GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""
