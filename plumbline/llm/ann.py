"""Approximate nearest neighbours by cosine: robust-pruned directed graphs over shards.

Vectors that are equal are one node, with their smallest ids. Nodes are dealt into shards
of bounded size, and each shard gets a graph: nodes enter in batches; a greedy beam
search over the graph so far proposes neighbours, and a proposed neighbour is left out if
one kept already is closer to it than the node is, by the factor ALPHA. Edges are added
in both directions and pruned the same way. A query is answered by a beam search in every
shard, an exact score in double precision for what the beams end with, and a merge.

Shards and blocks of queries meet in tiles: a task is sent the few shards of a tile, keeps
them, and has the tile's blocks pass by. Nothing is broadcast, and each shard is copied for
every TILE_BLOCKS blocks only, each block for every tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.store import ARROW_ROWS, written
from plumbline.session import session_setting

SHARD = 4096
DEGREE = 32
BEAM = 64
ALPHA = 1.2
# Nodes that a beam expands at once, and queries that are searched at once.
EXPANDED = 4
QUERIES = 512
# Queries in a block, the unit that meets a shard.
BLOCK = 4096
# Bytes that the shards of a tile may take in a worker, and blocks of queries in a tile.
TILE_BYTES, TILE_BLOCKS = 64 << 20, 16
# Tiles at least, where there are as many shards, and tasks of a stage at most.
SPREAD, MOST_TASKS = 64, 10_000


def beam_search(vectors: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` nearest nodes found for each query and their squared distances, nearest first.

    `vectors` and `queries` have length 1. Missing places have node -1 and an infinite
    distance.
    """
    n_queries, n_nodes = len(queries), len(vectors)
    ids = np.full((n_queries, beam), -1, dtype=np.int64)
    dist = np.full((n_queries, beam), np.inf, dtype=np.float32)
    done = np.ones((n_queries, beam), dtype=bool)
    seen = np.zeros((n_queries, n_nodes), dtype=bool)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = 2 - 2 * (queries @ vectors[entry])
    seen[:, entry] = True
    rows = np.arange(n_queries)
    while len(rows):
        rank = np.where(done[rows], np.inf, dist[rows])
        pick = np.argpartition(rank, EXPANDED - 1, axis=1)[:, :EXPANDED] if beam > EXPANDED else np.argsort(rank, axis=1)
        live = np.isfinite(np.take_along_axis(rank, pick, axis=1))
        expanded = np.where(live, np.take_along_axis(ids[rows], pick, axis=1), -1)
        marks = done[rows]
        np.put_along_axis(marks, pick, True, axis=1)
        done[rows] = marks
        near = np.where(expanded[:, :, None] >= 0, graph[expanded], -1).reshape(len(rows), -1)
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        r, c = np.nonzero(fresh)
        seen[rows[r], near[r, c]] = True
        d = np.full(near.shape, np.inf, dtype=np.float32)
        d[r, c] = 2 - 2 * np.einsum("ij,ij->i", vectors[near[r, c]], queries[rows[r]])
        # A node proposed twice at once is kept once.
        order = np.argsort(near, axis=1, kind="stable")
        ordered = np.take_along_axis(near, order, axis=1)
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], axis=1)
        d[twice] = np.inf
        all_d = np.concatenate([dist[rows], d], axis=1)
        all_i = np.concatenate([ids[rows], near], axis=1)
        all_done = np.concatenate([done[rows], ~np.isfinite(d)], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[rows] = np.take_along_axis(all_d, best, axis=1)
        kept = np.take_along_axis(all_i, best, axis=1)
        ids[rows] = np.where(np.isfinite(dist[rows]), kept, -1)
        done[rows] = np.take_along_axis(all_done, best, axis=1)
        rows = rows[~done[rows].all(axis=1)]
    return ids, dist


def robust_prune(vectors: np.ndarray, nodes: np.ndarray, proposed: np.ndarray) -> np.ndarray:
    """At most DEGREE diverse neighbours of each node out of its proposed ones (-1: none)."""
    proposed = np.where(proposed == nodes[:, None], -1, proposed)
    ordered = np.sort(proposed, axis=1)
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
    near = vectors[ordered]
    d = 2 - 2 * np.einsum("bcd,bd->bc", near, vectors[nodes])
    d[ordered < 0] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    ordered, d = np.take_along_axis(ordered, order, axis=1), np.take_along_axis(d, order, axis=1)
    near = np.take_along_axis(near, order[:, :, None], axis=1)
    between = 2 - 2 * near @ near.transpose(0, 2, 1)
    alive, kept = np.isfinite(d), np.zeros(d.shape, dtype=bool)
    for i in range(d.shape[1]):
        take = alive[:, i] & (kept.sum(axis=1) < DEGREE)
        kept[:, i] = take
        alive &= ~(take[:, None] & (ALPHA**2 * between[:, i, :] <= d))
    # Places left over go to the nearest of the rest.
    spare = np.isfinite(d) & ~kept
    room = DEGREE // 2 - kept.sum(axis=1)
    kept |= spare & (np.cumsum(spare, axis=1) <= room[:, None])
    out = np.full((len(nodes), DEGREE), -1, dtype=np.int64)
    r, c = np.nonzero(kept)
    place = (np.cumsum(kept, axis=1) - 1)[r, c]
    fits = place < DEGREE
    out[r[fits], place[fits]] = ordered[r[fits], c[fits]]
    return out


def build(vectors: np.ndarray) -> tuple[np.ndarray, int]:
    """Graph over vectors of length 1 (DEGREE neighbours a node, -1: none) and where searches begin."""
    n = len(vectors)
    graph = np.full((n, DEGREE), -1, dtype=np.int64)
    middle = vectors.mean(axis=0)
    entry = int(np.argmax(vectors @ middle))
    order = np.random.default_rng(3).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        batch = order[at : at + min(max(at, 1), 256)]
        at += len(batch)
        found, _ = beam_search(vectors, graph, entry, vectors[batch], BEAM)
        # Nodes of the batch can't find each other by the graph; compare them outright.
        close = vectors[batch] @ vectors[batch].T
        np.fill_diagonal(close, -np.inf)
        mates = min(len(batch) - 1, DEGREE // 2)
        if mates:
            found = np.concatenate([found, batch[np.argsort(-close, axis=1)[:, :mates]]], axis=1)
        graph[batch] = robust_prune(vectors, batch, found)
        _add_back(vectors, graph, batch)
    return graph, entry


def _add_back(vectors: np.ndarray, graph: np.ndarray, batch: np.ndarray) -> None:
    """Edges back to `batch` from all nodes that it points to."""
    source = np.repeat(batch, DEGREE)
    target = graph[batch].ravel()
    source, target = source[target >= 0], target[target >= 0]
    # The nearest come first; a node that many point to sees the nearest 2 * DEGREE.
    d = -np.einsum("ij,ij->i", vectors[source], vectors[target])
    order = np.lexsort((d, target))
    source, target = source[order], target[order]
    nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(starts, counts)
    width = min(int(counts.max(initial=0)), 2 * DEGREE)
    more = np.full((len(nodes), width), -1, dtype=np.int64)
    row = np.repeat(np.arange(len(nodes)), counts)
    fits = place < width
    more[row[fits], place[fits]] = source[fits]
    for i in range(0, len(nodes), QUERIES):
        part = nodes[i : i + QUERIES]
        graph[part] = robust_prune(vectors, part, np.concatenate([graph[part], more[i : i + QUERIES]], axis=1))


def usable(vector: str) -> Column:
    """Whether a vector can be compared: no NULL, all finite, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    # Scaled first, so that tiny and huge components survive the square.
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


_INDEX = "dim int, shard bigint, entry bigint, ids array<array<bigint>>, vectors binary, graph binary"


def _index_shard(table: pa.Table) -> pa.Table:
    dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
    table = table.sort_by("node")
    vectors = np.array(table.column("vector").to_pylist(), dtype=np.float64).reshape(-1, dim)
    graph, entry = build(_unit(vectors))
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "shard": pa.array([shard], pa.int64()),
            "entry": pa.array([entry], pa.int64()),
            "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
            "graph": pa.array([graph.astype(np.int32).tobytes()], pa.binary()),
        }
    )


def index(rows: DataFrame, top: int) -> DataFrame:
    """A written table of shards over all usable rows of `vec_id` and `embedding`.

    Of equal vectors the `top` + 1 smallest ids are kept: no answer can hold more.
    """
    rows = rows.where("vec_id IS NOT NULL").where(usable("embedding"))
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).distinct()
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("place", first).where(F.col("place") <= top + 1)
    nodes = few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = written(nodes.select("vector", "ids", F.col("ids")[0].alias("node"), F.size("vector").alias("dim")), "vectors")
    shards = {r.dim: -(-r["count"] // SHARD) for r in nodes.groupBy("dim").count().collect()}
    of_dim = F.element_at(F.create_map(*[F.lit(x) for pair in shards.items() for x in pair]), F.col("dim")) if shards else F.lit(1)
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), of_dim).cast("long"))
    # Graphs take long to build, so that a task should have few.
    dealt = dealt.repartition(max(1, min(sum(shards.values()), MOST_TASKS)), "dim", "shard")
    return written(dealt.groupBy("dim", "shard").applyInArrow(_index_shard, _INDEX), "vector-index")


class _Shard(NamedTuple):
    entry: int
    ids: list[list[int]]
    raw: np.ndarray
    unit: np.ndarray
    graph: np.ndarray


def _query_block(table: pa.Table) -> pa.Table:
    """The queries of a block as one row, shaped like a shard without a graph."""
    dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
    vectors = np.array(table.column("vector").to_pylist(), dtype=np.float64)
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "block": pa.array([block], pa.int64()),
            "ids": pa.array([[[i] for i in table.column("id").to_pylist()]], pa.list_(pa.list_(pa.int64()))),
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
        }
    )


def _search(batches: Iterator[pa.RecordBatch], top: int, beam: int) -> Iterator[pa.RecordBatch]:
    """The `top` nearest rows that each tile has for its queries; its shards come before its blocks."""
    tile, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["dim"], row["tile"], row["part"]) != tile:
                tile, held = (row["dim"], row["tile"], row["part"]), []
            vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(-1, row["dim"])
            if row["graph"] is not None:
                graph = np.frombuffer(row["graph"], dtype=np.int32).reshape(-1, DEGREE).astype(np.int64)
                held.append(_Shard(row["entry"], row["ids"], vectors, _unit(vectors), graph))
            else:
                yield _answers(held, [i for i, in row["ids"]], vectors, top, beam)


def _answers(held: list[_Shard], owns: list[int], asked: np.ndarray, top: int, beam: int) -> pa.RecordBatch:
    out: list[tuple[int, int, float]] = []
    for at in range(0, len(asked), QUERIES):
        part = asked[at : at + QUERIES]
        unit = _unit(part)
        best: list[list[tuple[float, int]]] = [[] for _ in part]
        for shard in held:
            found, _ = beam_search(shard.unit, shard.graph, shard.entry, unit, beam)
            for i, nodes in enumerate(found):
                own = owns[at + i]
                nodes = nodes[nodes >= 0]
                scores = cosine(shard.raw[nodes], np.broadcast_to(part[i], (len(nodes), part.shape[1])))
                listed = [(-s, v) for s, node in zip(scores.tolist(), nodes.tolist(), strict=True) for v in shard.ids[node] if v != own]
                best[i] = sorted(best[i] + listed)[:top]
        out += [(owns[at + i], v, -s) for i, listed in enumerate(best) for s, v in listed]
    return pa.RecordBatch.from_pydict(
        {
            "query_id": pa.array([q for q, _, _ in out], pa.int64()),
            "vec_id": pa.array([v for _, v, _ in out], pa.int64()),
            "score": pa.array([s for _, _, s in out], pa.float64()),
        }
    )


def _tiles(dim: int, n_shards: int) -> int:
    """Tiles over so many shards: vectors twice, graph and ids of a tile's shards stay within TILE_BYTES."""
    shard_bytes = SHARD * (12 * dim + 8 * DEGREE + 120)
    return min(n_shards, max(SPREAD, -(-n_shards // max(1, TILE_BYTES // shard_bytes))))


def search(shards: DataFrame, queries: DataFrame, top: int = 5, beam: int = BEAM) -> DataFrame:
    """The `top` nearest rows found for each of `queries` (`id`, `vector`).

    Every block of queries meets every shard of its dimension, in tiles; blocks, shards and
    tiles are of bounded size.
    """
    spark = shards.sparkSession
    counts = {r.dim: r["count"] for r in shards.groupBy("dim").count().collect()}
    if not counts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    queries = written(queries.withColumn("dim", F.size("vector")), "queries")
    blocks = {r.dim: -(-r["count"] // BLOCK) for r in queries.groupBy("dim").count().collect()}
    blocks = {d: b for d, b in blocks.items() if d in counts}
    if not blocks:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    tiles = {d: _tiles(d, counts[d]) for d in blocks}
    parts = {d: -(-b // TILE_BLOCKS) for d, b in blocks.items()}

    def per_dim(table: dict[int, int]) -> Column:
        return F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for pair in table.items() for x in pair]), F.col("dim")), F.lit(0))

    def dealt(number: Column, table: dict[int, int]) -> Column:
        return F.pmod(number, F.greatest(per_dim(table), F.lit(1))).cast("long")

    def numbers(table: dict[int, int]) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), (per_dim(table) - 1).cast("long")))

    asked = queries.where(per_dim(blocks) > 0).withColumn("block", dealt(F.xxhash64("id"), blocks))
    asked = asked.groupBy("dim", "block").applyInArrow(_query_block, "dim int, block bigint, ids array<array<bigint>>, vectors binary")
    none = {"entry": F.lit(None).cast("long"), "graph": F.lit(None).cast("binary")}
    asked = asked.withColumns({"part": dealt(F.col("block"), parts), "tile": numbers(tiles), **none}).drop("block")
    held = shards.where(per_dim(blocks) > 0).withColumns({"tile": dealt(F.col("shard"), tiles), "part": numbers(parts)}).drop("shard")
    place = ["dim", "tile", "part"]
    n_tiles = sum(tiles[d] * parts[d] for d in blocks)
    met = held.unionByName(asked).repartition(max(1, min(n_tiles, MOST_TASKS)), *place)
    met = met.sortWithinPartitions(*place, F.col("graph").isNull())
    # A row holds a shard or a block, so only a few go into a batch.
    with session_setting(spark, ARROW_ROWS, "2"):
        found = written(met.mapInArrow(lambda it: _search(it, top, beam), "query_id bigint, vec_id bigint, score double"), "neighbours")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def neighbours(rows: DataFrame, every: int = 50, top: int = 5) -> DataFrame:
    """Nearest rows of every row whose `vec_id` is divisible by `every`.

    Rows whose vector is NULL, zero or has a NULL or non-finite component, or whose id is
    NULL, take no part. Vectors of different lengths never meet. Repeated rows count
    once. An empty table gives an empty result; other columns are not read.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = rows.where(F.col("vec_id") % every == 0).where(usable("embedding"))
    asked = asked.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return search(index(rows, top), asked.dropDuplicates(["id"]), top)
