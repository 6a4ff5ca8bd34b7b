"""Removal of long byte strings that occur more than once, by merging sorted suffix runs.

A byte goes if it is in a string of LENGTH bytes that also starts anywhere else. Every
start of such a string has an anchor: the k-mer of smallest hash in it, the first of
equals. Equal strings have equal anchors, so starts are handled as stretches that share
one, and a stretch is the suffix that begins at its first start, as long as the strings
of all its starts reach.

1. Blocks of documents ask hash ranges which anchors occur again. Most stretches are
   settled here: they hold no repeated string.
2. The others are sorted as suffixes. Each block sorts its own, keeps one of equal ones,
   and sends front-coded runs (the length shared with the one before, and the rest) to
   the task of their lexicographic share. That task merges its runs with a loser tree
   whose nodes hold the length shared with the last winner: two suffixes are compared
   from the end of what both share with it, so no known prefix is compared again. Equal
   suffixes come out side by side, and all their starts are repeated.
3. A suffix that is alone may still hold repeated strings, where its copies go on
   differently. Stretches whose anchor has such a suffix ask hash ranges start by start.

A stretch is bound to its anchor on both sides, so no start is left out, and a string is
compared with all others of its anchor, so none is missed. Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
import io
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocks import (
    ASKED, arrow_schema, dealt, pack, pack_sorted, questions, runs_of, store, told, totals_of, unpack, unpack_sorted,
)
from plumbline.llm.store import folder, written
from plumbline.llm.text_arrays import pieces, prefix_hash, span_hash

LENGTH = 400
# Starts that may share an anchor; an anchor is a k-mer of LENGTH - REACH + 1 bytes.
REACH = 64
KMER = LENGTH - REACH + 1
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 512 << 10
# Bytes of text that a hash range, or a share of the suffixes, stands for, about.
RANGE_BYTES = 8 << 20
_PREFIX_BYTES = 7


# Capitals count as themselves here.
_VALUES = np.random.default_rng(21).integers(0, 1 << 63, 256, dtype=np.uint64)


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start, place of the anchor and its hash, for all stretches of some texts."""
    nothing = np.empty(0, np.int64)
    if not (np.diff(offsets) >= LENGTH).any():
        return nothing, nothing, nothing, np.empty(0, np.uint64)
    prefix = prefix_hash(data, _VALUES)
    at = np.arange(len(data) - KMER + 1)
    hashes = span_hash(prefix, at, at + KMER)
    bits = np.uint64(int(len(hashes)).bit_length())
    # The place in the low bits makes the first of equal hashes the smallest key.
    keys = (hashes >> bits << bits) | at.astype(np.uint64)
    n = len(keys) - REACH + 1
    padded = np.concatenate([keys, np.full(-len(keys) % REACH, np.iinfo(np.uint64).max)]).reshape(-1, REACH)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:n], ahead[REACH - 1 : REACH - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(n)
    size = np.diff(offsets)
    room = np.repeat(offsets[1:], size)[:n]
    valid = start + LENGTH <= room
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    end = valid.copy()
    end[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
    first, last = start[new], start[end]
    return first, last, anchor[first], hashes[anchor[first]]


def _save(**arrays: object) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _text(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(size, 1)), np.uint8)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Ids, NULL marks, bytes, offsets and stretches of about BLOCK_BYTES of documents."""
    held: list[tuple] = []
    size = 0

    def made() -> tuple:
        ids, nulls = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        data = np.concatenate([h[2].data for h in held])
        past = np.cumsum([0] + [len(h[2].data) for h in held])
        offsets = np.concatenate([[0], *(h[2].offsets[1:] + p for h, p in zip(held, past, strict=False))])
        found = [stretches(*h[2]) for h in held]
        first, last, anchor = (np.concatenate([f[i] + p for f, p in zip(found, past, strict=False)]) for i in range(3))
        hashes = np.concatenate([f[3] for f in found])
        held.clear()
        return ids, nulls, data, offsets, first, last, anchor, hashes

    for batch in batches:
        for part, texts in pieces(batch, "text", PIECE_BYTES):
            ids = part.column("doc_id")
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), texts))
            size += len(texts.data)
            if size >= BLOCK_BYTES:
                yield made()
                size = 0
    if held:
        yield made()


class Store:
    """Files of blocks, by step, in the shared folder."""

    def __init__(self, place: str) -> None:
        self.system, self.path = pafs.FileSystem.from_uri(place)

    def put(self, block: int, step: str, raw: bytes) -> None:
        store(self.system, f"{self.path}/{block:016x}.{step}", raw)

    def get(self, block: int, step: str) -> dict:
        with self.system.open_input_stream(f"{self.path}/{block:016x}.{step}") as file:
            return np.load(io.BytesIO(file.read()))

    def text(self, block: int) -> tuple[dict, np.ndarray]:
        f = self.get(block, "docs")
        return f, _text(f["text"].tobytes(), int(f["offsets"][-1]))


def _ask_anchors(batches: Iterator[pa.RecordBatch], place: str, bits: int) -> Iterator[pa.RecordBatch]:
    files, part = Store(place), TaskContext.get().partitionId()
    for number, (ids, nulls, data, offsets, first, last, anchor, hashes) in enumerate(_blocks(batches)):
        block = (part << 32) | number
        packed = zstandard.ZstdCompressor(level=1).compress(data.tobytes())
        files.put(block, "docs", _save(ids=ids, nulls=nulls, offsets=offsets, text=np.frombuffer(packed, np.uint8)))
        distinct, of, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        stored = {"of": of, "first": first, "length": last - first, "left": anchor - first}
        files.put(block, "anchors", _save(n=len(first), **{k: np.frombuffer(pack(v.astype(np.int32)), np.uint8) for k, v in stored.items()}, distinct=len(distinct), hashes=np.frombuffer(pack_sorted(distinct), np.uint8)))
        # Every block has a question, so that every block gets an answer.
        yield questions(block, distinct, counts, bits) if len(distinct) else questions(block, np.zeros(1, np.uint64), np.zeros(1, np.int64), bits)


def _repeated(files: Store, block: int, totals: np.ndarray) -> tuple[np.ndarray, ...]:
    """First start, number of further starts, place of the anchor in it and its hash, of stretches with a repeated anchor."""
    f = files.get(block, "anchors")
    n = int(f["n"])
    of, first, length, left = (unpack(f[k].tobytes(), np.int32, n).astype(np.int64) for k in ("of", "first", "length", "left"))
    keep = totals[of] > 1 if n else np.zeros(0, bool)
    distinct = unpack_sorted(f["hashes"].tobytes(), int(f["distinct"]))
    return first[keep], length[keep], left[keep], distinct[of[keep]]


_SENT = "share bigint, block bigint, n bigint, shared binary, sizes binary, rests binary"
_MERGED = "block bigint, share bigint, n bigint, again binary"
_SENT_ARROW, _MERGED_ARROW = arrow_schema(_SENT), arrow_schema(_MERGED)


def front_coded(run: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """For a sorted run: the length that each string shares with the one before, and the rest."""
    if not run:
        return np.empty(0, np.int64), []
    width = max(map(len, run))
    shared = np.zeros(len(run), dtype=np.int64)
    for at in range(0, len(run), 4096):
        part = run[max(at - 1, 0) : at + 4096]
        table = np.zeros((len(part), width + 1), dtype=np.int16)
        for i, s in enumerate(part):
            table[i, : len(s)] = np.frombuffer(s, np.uint8)
            # Past its end a string differs from every other.
            table[i, len(s) :] = -1 - (i & 1)
        same = (table[1:] != table[:-1]).argmax(axis=1)
        shared[at + (at == 0) : at + 4096] = same
    return shared, [s[k:] for s, k in zip(run, shared.tolist(), strict=True)]


class Run:
    """A front-coded sorted run as it is read in a merge."""

    def __init__(self, shared: list[int], rests: list[bytes]) -> None:
        self.shared, self.rests, self.at, self.now = shared, rests, 0, b""

    def advance(self) -> int:
        """Read the next string; the length it shares with the one before, or -1 at the end."""
        if self.at == len(self.rests):
            return -1
        k = self.shared[self.at]
        self.now = self.now[:k] + self.rests[self.at]
        self.at += 1
        return k


def _common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be `start` at least; halving, so that bytes are compared in C."""
    end = min(len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    while end - start > 1:
        middle = (start + end) // 2
        if a[start:middle] == b[start:middle]:
            start = middle
        else:
            end = middle
    return start


def merge(runs: list[Run]) -> Iterator[tuple[int, int]]:
    """(run, length shared with the last output) of all strings of the runs in order.

    A loser tree. Every waiting string knows what it shares with the last output. Of two
    the one that shares more comes first; only where both share the same are they compared,
    from there on, and the loser then shares with the winner what the comparison found.
    """
    k = len(runs)
    alive = [run.advance() >= 0 for run in runs]
    known = [0] * k
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; -1 stands for no run."""
        if b < 0 or not alive[b]:
            return a, b
        if a < 0 or not alive[a]:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = runs[a].now, runs[b].now
        common = _common(x, y, known[a])
        if (x[common:], a) <= (y[common:], b):
            known[b] = common
            return a, b
        known[a] = common
        return b, a

    size = 1
    while size < k:
        size *= 2
    losers = [-1] * size
    winners = [-1] * (2 * size)
    for i in range(k):
        winners[size + i] = i
    for i in range(size - 1, 0, -1):
        winners[i], losers[i] = play(winners[2 * i], winners[2 * i + 1])
    top = winners[1]
    while top >= 0 and alive[top]:
        yield top, known[top]
        known[top] = runs[top].advance()
        alive[top] = known[top] >= 0
        node = (size + top) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def _send_runs(batches: Iterator[pa.RecordBatch], place: str, splits: list[bytes]) -> Iterator[pa.RecordBatch]:
    files = Store(place)
    for rows in runs_of(batches, ["block"]):
        block = rows.column("block")[0].as_py()
        first, length, left, hashes = _repeated(files, block, totals_of(rows.to_pylist()))
        _, data = files.text(block)
        raw = data.tobytes()
        # The anchor's place belongs to the suffix: starts on either side of it are bound to it.
        suffixes = [raw[a : a + n + LENGTH] + bytes([k]) for a, n, k in zip(first.tolist(), length.tolist(), left.tolist(), strict=True)]
        run = sorted(set(suffixes))
        place_of = {s: i for i, s in enumerate(run)}
        of = np.array([place_of[s] for s in suffixes], dtype=np.int64)
        if not run:
            continue
        files.put(block, "suffixes", _save(first=first, length=length, hashes=hashes, of=of, n=len(run)))
        cuts = [0, *(bisect_left(run, s) for s in splits), len(run)]
        out: list[tuple] = []
        for share, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if b > a:
                shared, rests = front_coded(run[a:b])
                pressed = zstandard.ZstdCompressor(level=1).compress(b"".join(rests))
                out.append((share, block, b - a, pack(shared.astype(np.int32)), pack(np.array([len(r) for r in rests], np.int32)), pressed))
        yield pa.RecordBatch.from_pydict({n: [row[i] for row in out] for i, n in enumerate(_SENT_ARROW.names)}, schema=_SENT_ARROW)


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in runs_of(batches, ["share"]):
        rows = table.to_pylist()
        runs, again = [], []
        for r in rows:
            sizes = unpack(r["sizes"], np.int32, r["n"]).astype(np.int64)
            ends = np.cumsum(sizes)
            rests = _text(r["rests"], int(ends[-1])).tobytes()
            parts = [rests[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            runs.append(Run(unpack(r["shared"], np.int32, r["n"]).tolist(), parts))
            again.append(np.zeros(r["n"], np.uint8))
        last, last_at, last_size = -1, 0, -1
        for run, shared in merge(runs):
            at, size = runs[run].at - 1, len(runs[run].now)
            if shared == size == last_size:
                again[run][at] = again[last][last_at] = 1
            last, last_at, last_size = run, at, size
        yield pa.RecordBatch.from_pydict(
            {"block": [r["block"] for r in rows], "share": [r["share"] for r in rows], "n": [r["n"] for r in rows], "again": [pack(a) for a in again]},
            schema=_MERGED_ARROW,
        )


def _ask_open(batches: Iterator[pa.RecordBatch], place: str, bits: int) -> Iterator[pa.RecordBatch]:
    """Which anchors have a suffix that is alone: asked by all blocks that hold such an anchor."""
    files = Store(place)
    for rows in runs_of(batches, ["block"]):
        block = rows.column("block")[0].as_py()
        f = files.get(block, "suffixes")
        parts = sorted(rows.select(["share", "n", "again"]).to_pylist(), key=lambda r: r["share"])
        again = np.concatenate([np.empty(0, np.uint8), *(unpack(r["again"], np.uint8, r["n"]) for r in parts)])
        here = np.bincount(f["of"], minlength=int(f["n"]))
        settled = ((again > 0) | (here > 1))[f["of"]]
        distinct, of = np.unique(f["hashes"], return_inverse=True)
        alone = np.zeros(len(distinct), np.int64)
        alone[of[~settled]] = 1
        files.put(block, "settled", _save(settled=settled, of=of))
        yield questions(block, distinct, alone, bits)


def _starts(f: dict, data: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All starts of the chosen stretches, and the hashes of their strings; a piece of the block at a time."""
    first, counts = f["first"][chosen], f["length"][chosen] + 1
    at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    hashes = np.empty(len(at), dtype=np.uint64)
    lo = 0
    while lo < len(at):
        hi = int(np.searchsorted(at, at[lo] + PIECE_BYTES))
        prefix = prefix_hash(data[at[lo] : at[hi - 1] + LENGTH], _VALUES)
        local = at[lo:hi] - at[lo]
        hashes[lo:hi] = span_hash(prefix, local, local + LENGTH)
        lo = hi
    return at, hashes


def _ask_starts(batches: Iterator[pa.RecordBatch], place: str, bits: int) -> Iterator[pa.RecordBatch]:
    files = Store(place)
    for rows in runs_of(batches, ["block"]):
        block = rows.column("block")[0].as_py()
        opened = totals_of(rows.to_pylist()) > 0
        f, g = files.get(block, "suffixes"), files.get(block, "settled")
        _, data = files.text(block)
        chosen = opened[g["of"]]
        at, hashes = _starts(f, data, chosen)
        distinct, of, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        alone = np.repeat(~g["settled"][chosen], f["length"][chosen] + 1)
        files.put(block, "starts", _save(at=at[alone], of=of[alone]))
        if len(distinct):
            yield questions(block, distinct, counts, bits)


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def removed_runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of removed bytes begin and end, from the starts of repeated strings of a text."""
    starts = np.sort(starts)
    far = np.flatnonzero(np.diff(starts) > LENGTH)
    return starts[np.concatenate([[0], far + 1])], starts[np.concatenate([far, [len(starts) - 1]])] + LENGTH


def _result(batches: Iterator[pa.RecordBatch], place: str) -> Iterator[pa.RecordBatch]:
    files = Store(place)
    for rows in runs_of(batches, ["block"]):
        block = rows.column("block")[0].as_py()
        docs, data = files.text(block)
        repeated = np.empty(0, np.int64)
        answered = [r for r in rows.to_pylist() if r["totals"] is not None]
        if files.system.get_file_info(f"{files.path}/{block:016x}.suffixes").type == pafs.FileType.File:
            f, g, s = (files.get(block, step) for step in ("suffixes", "settled", "starts"))
            first, more = f["first"][g["settled"]], f["length"][g["settled"]]
            whole = np.repeat(first - (np.cumsum(more + 1) - more - 1), more + 1) + np.arange((more + 1).sum())
            totals = totals_of(answered)
            repeated = np.concatenate([whole, s["at"][totals[s["of"]] > 1] if len(totals) else repeated])
        raw, offsets = data.tobytes(), docs["offsets"]
        of = np.searchsorted(offsets, repeated, side="right") - 1
        order = np.argsort(of, kind="stable")
        repeated, of = repeated[order], of[order]
        out: dict[str, list] = {n: [] for n in ("n_removed", "n_spans", "kept_sha256")}
        cuts = np.searchsorted(of, np.arange(len(offsets)))
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            mine = repeated[cuts[i] : cuts[i + 1]]
            if not len(mine):
                kept, begin, end = raw[a:b], (), ()
            else:
                begin, end = removed_runs(mine - a)
                bounds = [0, *np.stack([begin, end], axis=1).ravel().tolist(), b - a]
                kept = b"".join(raw[a + x : a + y] for x, y in zip(bounds[::2], bounds[1::2], strict=True))
            out["n_removed"].append(b - a - len(kept))
            out["n_spans"].append(len(begin))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_pydict(
            {"doc_id": pa.array(docs["ids"].astype(np.int64), mask=docs["nulls"]), "n_bytes": pa.array(np.diff(offsets)), **out}
        )


def removals(docs: DataFrame) -> DataFrame:
    """What is removed from every text, one row per row of `docs`.

    NULL and empty texts have no bytes and lose none, and the digest is that of no bytes.
    Repeated rows are texts of their own, so both lose what they share; a NULL id stays
    NULL. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    place = folder(spark, "suffix-blocks")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(size // RANGE_BYTES).bit_length()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Where a share of the suffixes ends: quantiles of short strings in the texts.
    shares = 1 << bits
    splits = _splits(docs, shares)
    anchors = told(rows.mapInArrow(lambda it: _ask_anchors(it, place, bits), ASKED), "anchor-totals")
    sent = dealt(anchors, "block").mapInArrow(lambda it: _send_runs(it, place, splits), _SENT)
    merged = written(dealt(sent, "share").mapInArrow(_merge_runs, _MERGED), "merged-runs")
    opened = told(dealt(merged, "block").mapInArrow(lambda it: _ask_open(it, place, bits), ASKED), "open-anchors")
    starts = told(dealt(opened, "block").mapInArrow(lambda it: _ask_starts(it, place, bits), ASKED), "start-totals")
    every = anchors.groupBy("block").agg(F.lit(-1).cast("long").alias("range"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("totals"))
    return dealt(every.unionByName(starts), "block").mapInArrow(lambda it: _result(it, place), _RESULT)


def _splits(docs: DataFrame, shares: int) -> list[bytes]:
    """Strings that cut the suffixes into about equal shares; a sketch of a few places of every text."""
    if shares < 2:
        return []
    places = F.expr("filter(transform(sequence(1, 4), k -> 1 + pmod(xxhash64(doc_id, k), greatest(length(text), 1))), p -> p > 0)")
    some = docs.where("text IS NOT NULL").select("text", F.explode(places).alias("at"))
    raw = F.substring(F.encode(F.expr(f"substring(text, cast(at AS int), {_PREFIX_BYTES})"), "UTF-8"), 1, _PREFIX_BYTES)
    number = F.conv(F.rpad(F.hex(raw), 2 * _PREFIX_BYTES, "0"), 16, 10).cast("long")
    points = [i / shares for i in range(1, shares)]
    found = some.select(number.alias("v")).agg(F.percentile_approx("v", points, 10 * shares)).first()[0] or []
    return [int(v).to_bytes(_PREFIX_BYTES, "big") for v in sorted(set(found))]
