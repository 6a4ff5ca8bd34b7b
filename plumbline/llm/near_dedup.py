"""Near-duplicate documents by MinHash bands, odd sketches and exact verification.

1. Every text becomes its set of word shingles (64-bit hashes), MinHash samples of it in
   bands, and two parity bitmaps. Texts with equal sets form a class at once; from then
   on only the smallest id of a class is compared.
2. Sets that agree in a band share a bucket. In every bucket the smallest id is compared
   with all others: as many pairs as members. Odd sketches of the samples estimate the
   similarity from the population count of their XOR and reject what lies six standard
   errors below the threshold; the parity bitmap of the whole set then bounds the
   symmetric difference from below and rejects with certainty. What is left is verified
   on the full sets, and links give components.
3. In buckets that still hold several components, all pairs between different components
   are compared by their bitmaps inside tasks, in blocks of bounded size. Only pairs that
   the bitmaps can't reject become rows, and are verified like the others.

So no link is lost once two sets share a bucket, and a pair at the threshold fails to
share one with a probability of MISS. Work in the third step grows with the square of a
bucket's members that aren't linked yet; it is spread over the pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.blocks import runs_of
from plumbline.llm.components import components
from plumbline.llm.store import broadcast_if_small, dropped, temporary, written
from plumbline.llm.text_arrays import SPACED, mix, pieces, shingles, word_hashes, words

ROWS = 4
MISS = 1e-8
SAMPLE_BITS = 512
SET_BITS = 2048
BLOCK = 512


class Rule(NamedTuple):
    """Shingle length in words and the least similarity, in hundredths."""

    size: int = 5
    percent: int = 80

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** ROWS))


def _parity(bits: int, owner: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """One bitmap per owner; a bit is set where an odd number of values falls."""
    odd = np.bincount(owner * bits + place.astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.reshape(n, bits).astype(np.uint8), axis=1)


def sketch(values: np.ndarray, offsets: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Band hashes, odd sketch of the samples, parity bitmap and 128-bit digest of each set.

    Rows of empty sets mean nothing.
    """
    n, k = len(offsets) - 1, bands * ROWS
    seeds = np.random.default_rng(11).integers(0, 1 << 63, (2, k), dtype=np.uint64)
    filled = np.flatnonzero(np.diff(offsets))
    samples = np.zeros((n, k), dtype=np.uint64)
    if len(filled):
        at = offsets[filled]
        for i in range(k):
            samples[filled, i] = np.minimum.reduceat((values ^ seeds[0, i]) * (seeds[1, i] | np.uint64(1)), at)
    keyed = mix(samples + np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    folded = np.zeros((n, bands), dtype=np.uint64)
    for r in range(ROWS):
        folded = mix(folded + keyed[:, r::ROWS])
    owner = np.repeat(np.arange(n), k)
    odd = _parity(SAMPLE_BITS, owner, keyed.ravel() >> np.uint64(64 - 9), n)
    of = np.repeat(np.arange(n), np.diff(offsets))
    spread = mix(values)
    whole = _parity(SET_BITS, of, spread >> np.uint64(64 - 11), n)
    sums = np.zeros((2, n), dtype=np.uint64)
    for j, v in enumerate((spread, mix(spread + np.uint64(1)))):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
        sums[j] = total[offsets[1:]] - total[offsets[:-1]]
    return folded, odd, whole, sums


def _bytes_column(matrix: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(matrix.shape[1]), len(matrix), [None, pa.py_buffer(np.ascontiguousarray(matrix))]).cast(pa.binary())


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def described(docs: DataFrame, rule: Rule) -> DataFrame:
    """Size, digest, bands and bitmaps of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                found = words(texts, SPACED)
                values, offsets = shingles(word_hashes(texts, found), found.offsets, rule.size)
                bands, odd, whole, sums = sketch(values, offsets, rule.bands)
                flat = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32), _long(bands.ravel()))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_shingles": pa.array(np.diff(offsets)),
                        "d1": _long(sums[0]),
                        "d2": _long(sums[1]),
                        "bands": flat,
                        "sketch": _bytes_column(np.hstack([odd, whole])),
                    }
                )

    schema = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def sets_of(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """`id` and `members`, the shingle hashes, of the documents in `wanted` (a written table of ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                found = words(texts, SPACED)
                values, offsets = shingles(word_hashes(texts, found), found.offsets, rule.size)
                members = pa.LargeListArray.from_arrays(offsets, _long(values)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "members": members})

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(broadcast_if_small(wanted, 16), "id")
    return rows.select("id", "text").mapInArrow(run, "id bigint, members array<bigint>")


_COUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint16)


def may_link(one: np.ndarray, others: np.ndarray, n_one: int, n_others: np.ndarray, rule: Rule) -> np.ndarray:
    """Which of the sketches `others` may belong to sets similar enough to that of `one`."""
    t = rule.percent / 100
    apart = _COUNT[others ^ one]
    samples, k = SAMPLE_BITS // 8, rule.bands * ROWS
    # Two sets that differ in m samples differ in about 2m values, thrown into SAMPLE_BITS cells.
    least = max(t - 6 * math.sqrt(t * (1 - t) / k), 0.0)
    thrown = 2 * k * (1 - least)
    most_odd = SAMPLE_BITS / 2 * (1 - math.exp(-2 * thrown / SAMPLE_BITS))
    near = apart[:, :samples].sum(axis=1) <= most_odd + 6 * math.sqrt(SAMPLE_BITS) / 2
    # Bits of the whole sets' bitmaps that differ are elements that differ, at the least.
    together = n_one + n_others
    common_least = np.ceil(rule.percent * together / (100 + rule.percent))
    fits = np.minimum(n_one, n_others) >= common_least
    return near & fits & (apart[:, samples:].sum(axis=1) <= together - 2 * common_least)


def _bitmaps(column: pa.Array) -> np.ndarray:
    width = (SAMPLE_BITS + SET_BITS) // 8
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def plausible(pairs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (`a`, `b`) that the sketches beside them can't reject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = _bitmaps(batch.column("sketch_a")), _bitmaps(batch.column("sketch_b"))
            zero = np.zeros(one.shape[1], dtype=np.uint8)
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            keep = may_link(zero, one ^ other, n_a, n_b, rule)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a bigint, b bigint")


def _cross_pairs(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Within each bucket and pair of blocks: pairs of different components that may link."""
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []

    def emit() -> pa.RecordBatch:
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (found_a, found_b))
        found_a.clear()
        found_b.clear()
        return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    for table in runs_of(batches, ["bucket", "low", "high"]):
        ids, of, n, block, low, high = (table.column(c).to_numpy() for c in ("id", "component", "n_shingles", "block", "low", "high"))
        maps = _bitmaps(table.column("sketch"))
        for i in range(len(ids)):
            later = np.arange(i + 1, len(ids))
            later = later[of[later] != of[i]]
            if low[0] != high[0]:
                later = later[block[later] != block[i]]
            if len(later):
                later = later[may_link(maps[i], maps[later], n[i], n[later], rule)]
                if len(later):
                    found_a.append(np.full(len(later), ids[i]))
                    found_b.append(ids[later])
        if sum(map(len, found_a)) > 10_000:
            yield emit()
    yield emit()


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose full sets are similar enough: 100 * common >= percent * union."""
    a = sets.select(F.col("id").alias("a"), F.col("members").alias("members_a"))
    b = sets.select(F.col("id").alias("b"), F.col("members").alias("members_b"))
    both = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("members_a", "members_b"))
    union = F.size("members_a") + F.size("members_b") - common
    return both.where((F.col("a") != F.col("b")) & (100 * common >= rule.percent * union)).select("a", "b")


def near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` and `kept`, one row per row of `docs`.

    A text of fewer words than a shingle has its whole sequence as its only one; NULL,
    empty and blank texts have none and are linked with nothing. Rows of one id are one
    document, linked with each other. A NULL id is linked with nothing: its component is
    NULL and it is kept. An empty table gives an empty result. Other columns are not read.
    """
    rows = written(described(docs, rule), "sets-described")
    filled = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    digest = ["n_shingles", "d1", "d2"]
    classes = written(
        filled.groupBy(*digest).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("bands", "sketch"), "doc_id").alias("s"))
        .select(*digest, "id", "copies", "s.bands", "s.sketch"),
        "set-classes",
    )
    # Buckets of more than one class; a band's hash tells its number too.
    bucketed = classes.select("id", F.posexplode("bands").alias("band", "hash")).select("id", F.xxhash64("band", "hash").alias("bucket"))
    shared = bucketed.groupBy("bucket").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    members = written(bucketed.join(shared, "bucket"), "bucket-members")
    facts = classes.select("id", "n_shingles", "sketch")
    named = {side: facts.select(F.col("id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")) for side in "ab"}
    stars = members.select(F.col("first").alias("a"), F.col("id").alias("b")).where("a < b").distinct()
    likely = written(plausible(stars.join(named["a"], "a").join(named["b"], "b"), rule), "likely-pairs")
    sets = written(sets_of(docs, written(members.select("id").distinct(), "member-ids"), rule), "member-sets")
    first_links = written(verified(likely, sets, rule), "star-links")
    known = components(first_links)

    # Buckets that hold several components still: compare between those.
    placed = members.join(known, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("n"))
    mixed = mixed.where("least <> most").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    spread = placed.join(mixed, "bucket").join(facts, "id").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "id", "component", "n_shingles", "sketch",
    )
    keys = ["bucket", "low", "high"]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = spread.repartition(partitions, *keys).sortWithinPartitions(*keys)
    cross = written(grouped.mapInArrow(lambda it: _cross_pairs(it, rule), "a bigint, b bigint").distinct(), "cross-pairs")
    links = first_links.union(verified(cross, sets, rule))
    final = written(components(links), "components")
    dropped(sets)
    dropped(cross)

    # Classes of one document without links need no look-up.
    linked = classes.join(final, "id", "left").where("copies > 1 OR component IS NOT NULL")
    told = written(linked.select(*digest, F.coalesce("component", "id").alias("component_id")), "class-components")
    answer = rows.join(broadcast_if_small(told, 64), digest, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    out = answer.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, rule: Rule) -> DataFrame:
    """The rows of `docs` that are kept, one of each group, with all their columns.

    Of several rows with one id, which count as one document, the first by the hash of
    its text stays. Rows with a NULL id stay.
    """
    with temporary(docs.sparkSession):
        found = near_duplicates(docs, rule).where("NOT kept").select("doc_id").distinct()
        gone = written(found, "near-duplicates", keep=True)
    gone = broadcast_if_small(gone, 16)
    left = docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
    many = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    many = written(many, "repeated-ids")
    if not many.head(1):
        return left
    many = broadcast_if_small(many, 16)
    same = left["doc_id"] == many["doc_id"]
    whole = F.struct(*[left[name] for name in docs.columns]).alias("row_")
    place = F.row_number().over(Window.partitionBy("row_.doc_id").orderBy(F.xxhash64("row_.text"), F.xxhash64("row_")))
    first = left.join(many, same, "left_semi").select(whole).select("row_", place.alias("place_")).where("place_ = 1").select("row_.*")
    return left.join(many, same, "left_anti").union(first)
