"""Hard negatives by exact integer scores from a residue-number-system matrix product.

Components become whole numbers, and a score is the inner product of two vectors of them.
For each of a few small primes the vectors' residues, nearest to zero, are multiplied as
float32 matrices, small enough that every sum is exact; the products modulo the primes
determine the signed score, which Chinese remaindering puts together digit by digit in a
mixed base. The primes are as many as the greatest norm in the table needs.

The rows are packed into chunks, the anchors into blocks, and each pair of them is a row:
blocks are broadcast if all of them are small, else both sides are dealt into tiles that
meet by an equal key. A first product finds each anchor's positives, a second one its
negatives within the band of each positive's score; tasks keep the first few of each list,
and windows select among those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.best import LOWEST, Best
from plumbline.llm.store import ARROW_ROWS, BROADCAST_BYTES, written
from plumbline.session import session_setting

# Rows of a chunk at most, and the bytes it should not exceed where rows are wide.
CHUNK_ROWS, CHUNK_BYTES = 4096, 8 << 20
# Anchors of a block, and those multiplied at once.
BLOCK_ROWS, TILE_ROWS = 1024, 256
# Chunks of a tile, where the blocks are too large to be broadcast.
TILE_CHUNKS = 64
# Columns multiplied before the product is reduced.
COLUMNS = 4096
# Sums of products stay below this in float32, with as much again to carry.
EXACT = 1 << 23
# Scores must fit 64 bits with a sign.
GREATEST = float(1 << 62)


class Rule(NamedTuple):
    """What is mined: `positives` of an anchor, `negatives` of each, and the band of their scores in hundredths."""

    every: int = 50
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


def primes_for(dim: int, bound: int) -> list[int]:
    """Primes small enough for exact float32 sums over `dim` columns, enough to tell scores up to `bound` apart."""
    half = int((EXACT / max(1, min(dim, COLUMNS))) ** 0.5)
    found, product, p = [], 1, 2 * half + 1
    while product <= 2 * bound + 1:
        while any(p % q == 0 for q in range(2, int(p**0.5) + 1)):
            p -= 1
        found.append(p)
        product *= p
        p -= 1
    return found


def residues(whole: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Per prime the residues of least magnitude, as float32."""
    out = []
    for p in primes:
        r = whole % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def product(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of the rows of two matrices given by their residues."""
    total, base = None, 1
    for p, a, b in zip(primes, left, right, strict=True):
        acc = a[:, :COLUMNS] @ b[:, :COLUMNS].T
        for at in range(COLUMNS, a.shape[1], COLUMNS):
            acc -= np.float32(p) * np.rint(acc * np.float32(1 / p))
            acc += a[:, at : at + COLUMNS] @ b[:, at : at + COLUMNS].T
        digit = acc.astype(np.int64)
        if total is not None:
            digit -= total % p
            digit *= pow(base, -1, p)
        digit %= p
        digit -= np.where(digit > p // 2, p, 0)
        # Digits of either sign make the last sum the score itself, also where one before it overflows.
        total = digit if total is None else total + digit * np.int64(base)
        base *= p
    return total


def usable(vector: str) -> Column:
    """Whether a vector has no NULL and only finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def prepared(rows: DataFrame) -> DataFrame:
    """The rows that take part, one for each id, with labels changed where the id is divisible by 7; written."""
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL").where(usable("embedding"))
    first = rows.groupBy("id").agg(F.min(F.struct("label", "embedding")).alias("row"))
    label = F.when(F.col("id") % 7 == 0, (F.col("row.label") + 1) % 10).otherwise(F.col("row.label"))
    return written(first.select("id", label.alias("label"), F.col("row.embedding").alias("embedding")), "vectors")


class Scale(NamedTuple):
    """Rows, greatest number of components, and a bound of all scores."""

    rows: int
    dim: int
    bound: int


def scale_of(rows: DataFrame) -> Scale:
    """From one pass; the greatest squared norm bounds every score."""
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(256.0 * F.abs(x.cast("double")) + 1, F.lit(2.0)))
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.max(square).alias("most")).first()
    if (found.most or 0.0) >= GREATEST:
        raise ValueError("scores of these vectors would not fit 64 bits")
    return Scale(found.n, found.dim or 0, int((found.most or 0.0) * (1 + 1e-9)) + 1)


def whole_numbers(column: pa.ListArray, dim: int) -> np.ndarray:
    """floor(256 * x) of every component; shorter vectors end in zeros."""
    flat = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int32)
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim), dtype=np.int32)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


_CHUNK = "ids binary, labels binary, vectors binary"


def _packed(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {k: pa.array([v.tobytes()], pa.binary()) for k, v in (("ids", ids), ("labels", labels), ("vectors", vectors))}
    )


def _chunks(rows: DataFrame, dim: int) -> DataFrame:
    """All rows, up to CHUNK_ROWS of a task in one row; written."""
    size = max(TILE_ROWS, min(CHUNK_ROWS, CHUNK_BYTES // (4 * max(dim, 1))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, dim), np.int32)]
        for batch in batches:
            new = [batch.column("id").to_numpy(), batch.column("label").to_numpy(), whole_numbers(batch.column("embedding"), dim)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            while len(held[0]) >= size:
                yield _packed(*(x[:size] for x in held))
                held = [x[size:] for x in held]
        if len(held[0]):
            yield _packed(*held)

    return written(rows.mapInArrow(pack, _CHUNK), "vector-chunks")


_BLOCK = "block bigint, a_ids binary, a_labels binary, a_vectors binary, p_ids binary, p_scores binary"


def _blocks(anchors: DataFrame, n_blocks: int, dim: int, places: int) -> DataFrame:
    """Anchors with `places` positives each (`p_ids`, `p_scores`), dealt into blocks by their ids; written."""

    def pack(table: pa.Table) -> pa.Table:
        n = table.num_rows
        embeddings = table.column("embedding").combine_chunks()
        p_ids, p_scores = np.zeros((n, places), np.int64), np.full((n, places), LOWEST, np.int64)
        for to, name in ((p_ids, "p_ids"), (p_scores, "p_scores")):
            for k, listed in enumerate(table.column(name).to_pylist()):
                to[k, : len(listed)] = listed
        arrays = [table.column("id").to_numpy(), table.column("label").to_numpy(), whole_numbers(embeddings, dim), p_ids, p_scores]
        names = ["a_ids", "a_labels", "a_vectors", "p_ids", "p_scores"]
        packed = {k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(names, arrays, strict=True)}
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), **packed})

    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("long"))
    return written(dealt.groupBy("block").applyInArrow(pack, _BLOCK), "anchor-blocks")


def _met(chunks: DataFrame, n_chunks: int, blocks: DataFrame, n_blocks: int, small: bool) -> DataFrame:
    """A row for each chunk and block."""
    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    # Some chunks to a task, so that its lists are cut before they are shuffled.
    dealt = chunks.repartition(max(1, min(n_chunks, 64), n_chunks // 16)).withColumn("block", numbers(n_blocks))
    if small:
        return dealt.join(F.broadcast(blocks), "block")
    tiles = max(1, n_chunks // TILE_CHUNKS)
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("ids"), F.lit(tiles)).cast("long"))
    return dealt.join(blocks.withColumn("tile", numbers(tiles)), ["block", "tile"])


def _offer(best: Best, lists: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
    """Add the scores that fit, a row of them for each of `lists`."""
    if np.count_nonzero(fits) > 16 * best.top * len(lists):
        least = np.partition(np.where(fits, scores, LOWEST), -best.top, axis=1)[:, -best.top]
        fits &= scores >= least[:, None]
    row, column = np.nonzero(fits)
    best.add(lists[row], scores[row, column], ids[column])


Offer = Callable[[Best, dict, slice, np.ndarray, np.ndarray, np.ndarray], None]


def _scored(batches: Iterator[pa.RecordBatch], scale: Scale, places: int, per_anchor: int, top: int, offer: Offer) -> Iterator[tuple[dict, Best]]:
    """Every block of anchors with the best entries of its lists among the task's chunks."""
    primes = primes_for(scale.dim, scale.bound)
    lists: dict[int, tuple[dict, Best]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            number = row["block"]
            if number not in lists:
                # A task meets more blocks than this only where they aren't broadcast, one after the other.
                if len(lists) >= 128:
                    yield from lists.values()
                    lists.clear()
                block = {k: np.frombuffer(row[k], np.int64) for k in ("a_ids", "a_labels", "p_ids", "p_scores")}
                block["p_ids"], block["p_scores"] = block["p_ids"].reshape(-1, places), block["p_scores"].reshape(-1, places)
                lists[number] = block, Best(len(block["a_ids"]) * per_anchor, top)
            block, best = lists[number]
            ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
            right = residues(np.frombuffer(row["vectors"], np.int32).reshape(len(ids), scale.dim), primes)
            left = residues(np.frombuffer(row["a_vectors"], np.int32).reshape(len(block["a_ids"]), scale.dim), primes)
            for at in range(0, len(block["a_ids"]), TILE_ROWS):
                some = slice(at, min(at + TILE_ROWS, len(block["a_ids"])))
                offer(best, block, some, product([x[some] for x in left], right, primes), ids, labels)
    yield from lists.values()


def _anchors(rows: DataFrame, rule: Rule) -> DataFrame:
    return rows.where(F.col("id") % rule.every == 0)


def mine(rows: DataFrame, rule: Rule = Rule(), broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`.

    Anchors are the rows whose `vec_id` is divisible by `rule.every`. Rows take no part if
    their id, label or vector is NULL or a component is NULL or not finite. Rows of one id
    are one row, that of the least label, then vector. Of vectors of different lengths the
    shorter ends in zeros; an empty one scores 0 with all. Equal scores go by the smaller
    id. Vectors whose scores might not fit 64 bits are refused. An empty table gives an
    empty result; other columns are not read. Scores are exact.
    """
    rows = prepared(rows)
    scale = scale_of(rows)
    n_anchors = _anchors(rows, rule).count()
    n_blocks = max(1, -(-n_anchors // BLOCK_ROWS))
    chunks = _chunks(rows, scale.dim)
    n_chunks = chunks.count()
    small = n_anchors * (4 * scale.dim + 16 * (rule.positives + 1)) <= broadcast_bytes
    found = _positives(chunks, n_chunks, _anchors(rows, rule), n_blocks, scale, rule, small)
    listed = F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score")))
    per_anchor = found.groupBy(F.col("anchor_id").alias("id")).agg(listed.alias("p"))
    per_anchor = per_anchor.select("id", F.col("p.positive_id").alias("p_ids"), F.col("p.positive_score").alias("p_scores"))
    with_positives = _anchors(rows, rule).join(per_anchor, "id")
    negatives = _negatives(chunks, n_chunks, with_positives, n_blocks, scale, rule, small)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = negatives.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rule.negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _run(met: DataFrame, task: Callable, schema: str, label: str) -> DataFrame:
    # A row holds a chunk and a block, so only a few go into a batch.
    with session_setting(met.sparkSession, ARROW_ROWS, "2"):
        return written(met.mapInArrow(task, schema), label)


def _positives(chunks, n_chunks, anchors, n_blocks, scale: Scale, rule: Rule, small: bool) -> DataFrame:
    """The first rows of each anchor's own label, with their `place`."""
    none = F.array().cast("array<bigint>")
    blocks = _blocks(anchors.withColumns({"p_ids": none, "p_scores": none}), n_blocks, scale.dim, 1)

    def offer(best, block, some, scores, ids, labels):
        own, label = block["a_ids"][some, None], block["a_labels"][some, None]
        fits = (labels == label) & (ids != own) & (scores >= best.floor[some, None])
        _offer(best, np.arange(some.start, some.stop), scores, fits, ids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, best in _scored(batches, scale, 1, 1, rule.positives, offer):
            lists, scores, ids, _ = best.entries()
            columns = {"anchor_id": block["a_ids"][lists], "positive_id": ids, "positive_score": scores}
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    schema = "anchor_id bigint, positive_id bigint, positive_score bigint"
    found = _run(_met(chunks, n_chunks, blocks, n_blocks, small), task, schema, "positives")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id"))
    return found.withColumn("place", place).where(F.col("place") <= rule.positives)


def _negatives(chunks, n_chunks, anchors, n_blocks, scale: Scale, rule: Rule, small: bool) -> DataFrame:
    """For each anchor and positive the tasks' first rows of another label within the band."""
    places = rule.positives
    blocks = _blocks(anchors, n_blocks, scale.dim, places)

    def band(score: int) -> tuple[int, int]:
        return (1, 0) if score == LOWEST else (-(-rule.low * score // 100), rule.high * score // 100)

    def offer(best, block, some, scores, ids, labels):
        other = labels != block["a_labels"][some, None]
        for j in range(places):
            bounds = np.array([band(s) for s in block["p_scores"][some, j].tolist()], dtype=np.int64).reshape(-1, 2)
            lists = np.arange(some.start, some.stop) * places + j
            least = np.maximum(bounds[:, 0], best.floor[lists])
            fits = other & (scores >= least[:, None]) & (scores <= bounds[:, 1, None])
            _offer(best, lists, scores, fits, ids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, best in _scored(batches, scale, places, places, rule.negatives, offer):
            lists, scores, ids, _ = best.entries()
            columns = {
                "anchor_id": block["a_ids"][lists // places],
                "positive_id": block["p_ids"][lists // places, lists % places],
                "positive_score": block["p_scores"][lists // places, lists % places],
                "negative_id": ids,
                "negative_score": scores,
            }
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    return _run(_met(chunks, n_chunks, blocks, n_blocks, small), task, schema, "negatives")


SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id AS other_id, a.label = e.label AS same,
         list_inner_product(a.v, e.v)::BIGINT AS score
  FROM e a JOIN e ON a.vec_id % 50 = 0 AND a.vec_id <> e.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM s WHERE same)
  WHERE place <= 5),
n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id)::INT AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
