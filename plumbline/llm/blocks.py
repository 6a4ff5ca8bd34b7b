"""Blocks of documents that ask hash ranges questions, with packed arrays for rows.

A block is a run of documents of one input partition, kept as a file in the shared folder.
A range is a share of the 64-bit hash space. A block sends each range its distinct hashes,
sorted and packed; the range answers in the block's own order, so that an answer needs no
hashes. However many rows hold a hash, it is one entry per block.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame

from plumbline.llm.store import written


def arrow_schema(ddl: str) -> pa.Schema:
    """Of a DDL string with the types bigint and binary."""
    return pa.schema([(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (f.split() for f in ddl.split(", "))])


def pack(values: np.ndarray) -> bytes:
    """Integers of a fixed width, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes, dtype: type, n: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(n * width, 1)), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64, n), dtype=np.uint64)


def store(system: pafs.FileSystem, path: str, raw: bytes) -> None:
    """Write a file whole or not at all; a second writer has the same content."""
    other = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(other) as out:
        out.write(raw)
    try:
        system.move(other, path)
    except OSError:
        if system.get_file_info(path).type != pafs.FileType.File:
            raise
        with contextlib.suppress(OSError):
            system.delete_file(other)


def cuts(hashes: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.array([0, len(hashes)])
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(hashes, starts), len(hashes))


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys together, of batches that come sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if held:
            new[0] = any(held[-1].column(k)[-1].as_py() != c[0].item() for k, c in zip(keys, columns, strict=True))
        cuts = np.flatnonzero(new).tolist()
        start = 0
        for cut in cuts:
            if cut > start:
                held.append(batch.slice(start, cut - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], cut
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


ASKED = "range bigint, block bigint, n bigint, hashes binary, counts binary"
TOLD = "block bigint, range bigint, n bigint, totals binary"
_ASKED_ARROW, _TOLD_ARROW = arrow_schema(ASKED), arrow_schema(TOLD)


def questions(block: int, hashes: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows that carry a block's sorted distinct hashes and their small counts to the ranges."""
    at = cuts(hashes, bits)
    filled = np.flatnonzero(np.diff(at))
    return pa.RecordBatch.from_pydict(
        {
            "range": filled,
            "block": np.full(len(filled), block),
            "n": np.diff(at)[filled],
            "hashes": [pack_sorted(hashes[at[r] : at[r + 1]]) for r in filled],
            "counts": [pack(np.minimum(counts[at[r] : at[r + 1]], 2).astype(np.uint8)) for r in filled],
        },
        schema=_ASKED_ARROW,
    )


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in runs_of(batches, ["range"]):
        rows = run.to_pylist()
        hashes = [unpack_sorted(r["hashes"], r["n"]) for r in rows]
        counts = np.concatenate([unpack(r["counts"], np.uint8, r["n"]) for r in rows])
        _, of = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.minimum(np.bincount(of, weights=counts), 2).astype(np.uint8)[of]
        parts = np.split(totals, np.cumsum([len(h) for h in hashes])[:-1])
        yield pa.RecordBatch.from_pydict(
            {
                "block": [r["block"] for r in rows],
                "range": [r["range"] for r in rows],
                "n": [r["n"] for r in rows],
                "totals": [pack(t) for t in parts],
            },
            schema=_TOLD_ARROW,
        )


def told(asked: DataFrame, label: str) -> DataFrame:
    """Answers to `questions`: for each hash the total of all counts, 2 standing for more."""
    return written(dealt(asked, "range").mapInArrow(_tell, TOLD), label)


def totals_of(rows: list[dict]) -> np.ndarray:
    """A block's totals in the order of its hashes."""
    rows = sorted(rows, key=lambda r: r["range"])
    return np.concatenate([np.empty(0, np.uint8), *(unpack(r["totals"], np.uint8, r["n"]) for r in rows)])


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of equal keys together in a partition, one key after the other."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, key).sortWithinPartitions(key)
