"""Token ids of texts, written to binary files with a shared compression dictionary.

Texts are range partitioned and sorted by id, encoded, and written as shard files. Every
document is a zstandard frame of its own, so that a short one can be read alone; what
such frames lack in context comes from one dictionary, trained on id arrays.

A shard file, all numbers little-endian:

    8 bytes   MAGIC
    32 bytes  SHA-256 of the dictionary (of nothing, where there is none)
    u64       number of documents n
    u64       bytes of an id as serialized (2 or 4)
    frames    one zstandard frame per document
    i64[n]    document ids (0 for NULL)
    u8[n]     1 where the document id is NULL
    u64[n]    ids of each document, end id included
    u64[n+1]  where each frame begins, and where the last one ends
    u64       where the document ids begin in the file

`manifest` lists the shards that count. A task that is run again writes files of other
names, so what a lost executor leaves behind is never read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm.store import folder, written
from plumbline.llm.text_arrays import Texts, pieces, prefix_hash, span_hash

MAGIC = b"PLIDZST1"
HEADER = struct.Struct("<8s32sQQ")
END_ID = 0
LEVEL = 3
# Serialized ids in a shard, about; a longer document is a shard of its own.
SHARD_BYTES = 64 << 20
# Documents that the dictionary is trained on, at most, and the characters taken of each.
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 8_000
DICTIONARY_BYTES = 64 << 10
# Pieces of text whose ids are kept in a worker, and how many new ones are filed together.
CACHED_PIECES = 400_000
FILED_PIECES = 50_000
# Bytes of text that are encoded together.
GROUP_BYTES = 512 << 10

# Classes of bytes: letters (with the Latin-1 ones, which are two bytes), digits, the
# space, other white space, everything else. Bytes of other letters have none.
_NONE, _LETTER, _DIGIT, _SPACE, _BLANK, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _CLASS[0xC3] = _CLASS[0x80:0xC0] = _LETTER
_CLASS[48:58], _CLASS[32], _CLASS[9:14], _CLASS[0x1C:0x20] = _DIGIT, _SPACE, _BLANK, _NONE
_CLASS[0xC0:0xC3] = _CLASS[0xC4:] = _NONE
_ENDINGS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")
_VALUES = np.random.default_rng(22).integers(0, 1 << 63, 256, dtype=np.uint64)


def unsplittable(texts: Texts) -> np.ndarray:
    """Texts with letters or white space beyond those that `split` knows."""
    data, offsets = texts
    after = np.zeros(len(data), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    odd = _CLASS[data] == _NONE
    odd |= ((data & 0xC0) == 0x80) & (~after | (data == 0x97) | (data == 0xB7))
    seen = np.concatenate([[0], np.cumsum(odd)])
    return seen[offsets[1:]] > seen[offsets[:-1]]


def split(texts: Texts) -> np.ndarray:
    """Where the pieces begin that a byte-level BPE makes of texts first.

    A piece is a run of letters, of digits or of other signs with the space before it, or
    the white space that is left: a run of it without its last character, and that
    character by itself if it isn't a space, or a whole run at a text's end. An
    apostrophe that begins a piece forms one with a short ending.
    """
    data, offsets = texts
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    ends = offsets[1:][offsets[1:] > offsets[:-1]]
    kind = _CLASS[data]
    before, behind = np.zeros_like(kind), np.zeros_like(kind)
    before[1:], behind[:-1] = kind[:-1], kind[1:]
    before[filled] = behind[ends - 1] = _NONE
    white = (kind == _SPACE) | (kind == _BLANK)
    white_before = (before == _SPACE) | (before == _BLANK)
    last_of_run = (behind != _SPACE) & (behind != _BLANK) & (behind != _NONE)
    new = np.where(white, ~white_before | last_of_run, (before != kind) & (before != _SPACE))
    new[filled] = True
    marks = np.flatnonzero((data == 39) & new & (behind == _LETTER))
    if len(marks):
        raw, limit = data.tobytes(), ends[np.searchsorted(ends, marks, side="right")]
        for at, end in zip(marks.tolist(), limit.tolist(), strict=True):
            for ending in _ENDINGS:
                stop = at + 1 + len(ending)
                if stop <= end and raw[at + 1 : stop] == ending:
                    new[at + 1 : stop] = False
                    if stop < end and kind[stop] == _LETTER:
                        new[stop] = True
                    break
    return np.flatnonzero(new)


class Pieces:
    """Ids of pieces by their hash: sorted arrays, the newest apart until they are many."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.levels = [self._empty(), self._empty()]

    @staticmethod
    def _empty() -> dict[str, np.ndarray]:
        return {
            "keys": np.empty(0, np.uint64), "marks": np.empty(0, np.int64), "starts": np.empty(0, np.int64),
            "sizes": np.empty(0, np.int64), "uses": np.empty(0, np.int32), "pool": np.empty(0, np.uint32),
        }

    @staticmethod
    def _chosen(level: dict, order: np.ndarray) -> dict[str, np.ndarray]:
        out = {k: level[k][order] for k in ("keys", "marks", "sizes", "uses")}
        out["starts"] = np.cumsum(out["sizes"]) - out["sizes"]
        out["pool"] = gathered(level["pool"], level["starts"][order], out["sizes"])
        return out

    def find(self, keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Level (-1: unknown, -2: another piece with this hash) and place of each key, and its number of ids."""
        level_of, place_of = np.full(len(keys), -1), np.zeros(len(keys), dtype=np.int64)
        sizes = np.zeros(len(keys), dtype=np.int64)
        for number, level in enumerate(self.levels):
            if not len(level["keys"]):
                continue
            place = np.minimum(np.searchsorted(level["keys"], keys), len(level["keys"]) - 1)
            same = level["keys"][place] == keys
            right = same & (level["marks"][place] == marks)
            level_of[same & ~right] = -2
            level_of[right], place_of[right] = number, place[right]
            sizes[right] = level["sizes"][place[right]]
            level["uses"][place[right]] += 1
        return level_of, place_of, sizes

    def add(self, keys: np.ndarray, marks: np.ndarray, ids: list[np.ndarray]) -> None:
        """New pieces, none of them known. Where there are too many, those used once go."""
        recent = self.levels[1]
        sizes = np.array([len(i) for i in ids], dtype=np.int64)
        joined = {
            "keys": np.concatenate([recent["keys"], keys]), "marks": np.concatenate([recent["marks"], marks]),
            "sizes": np.concatenate([recent["sizes"], sizes]), "uses": np.concatenate([recent["uses"], np.zeros(len(keys), np.int32)]),
            "starts": np.concatenate([recent["starts"], len(recent["pool"]) + np.cumsum(sizes) - sizes]),
            "pool": np.concatenate([recent["pool"], *ids]),
        }
        self.levels[1] = self._chosen(joined, np.argsort(joined["keys"], kind="stable"))
        if len(self.levels[1]["keys"]) > FILED_PIECES:
            old, recent = self.levels
            recent["starts"] = recent["starts"] + len(old["pool"])
            both = {k: np.concatenate([old[k], recent[k]]) for k in old}
            keep = np.arange(len(both["keys"]))
            if len(keep) > CACHED_PIECES:
                keep = np.flatnonzero(both["uses"] > 1)
                keep = keep if len(keep) < CACHED_PIECES // 2 else keep[:0]
                both["uses"] = np.zeros_like(both["uses"])
            self.levels = [self._chosen(both, keep[np.argsort(both["keys"][keep], kind="stable")]), self._empty()]


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of `pool` that begin at `starts`, one after the other."""
    past = np.cumsum(sizes) - sizes
    return pool[np.repeat(starts - past, sizes) + np.arange(int(sizes.sum()))]


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A byte-level BPE encodes each piece of its first split alone, so the ids of pieces met
    before are looked up. Texts where that split isn't certain are encoded whole.
    """

    def __init__(self, path: str) -> None:
        # A task has one core; threads of the library would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = self._whole(["\n"])[0]
        self.by_piece = self._splits()
        self.known = Pieces()

    def _splits(self) -> bool:
        """Whether the file's first split is the one that `split` makes."""
        kind = str(self.tokenizer.pre_tokenizer)
        return (
            kind.startswith("ByteLevel(") and "add_prefix_space=False" in kind and "use_regex=True" in kind
            and self.tokenizer.normalizer is None and len(self.newline) == 1
        )

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=np.uint32) for x in found]

    def _pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of single pieces; many at once, one to a line, since a line's end is always a token of its own."""
        out: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if "\n" not in p and "\r" not in p]
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            ids = self._whole(["\n".join(pieces[i] for i in some)])[0]
            ends = np.append(np.flatnonzero(ids == self.newline[0]), len(ids)).tolist()
            for i, start, end in zip(some, [0, *(e + 1 for e in ends)], ends, strict=False):
                out[i] = ids[start:end]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._whole([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: Texts) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        data, offsets = texts
        n = len(offsets) - 1
        raw = data.tobytes()
        whole = unsplittable(texts) if self.by_piece else np.ones(n, dtype=bool)
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                whole[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(content, at + 1)
        starts = split(texts)
        ends = np.append(starts[1:], len(data))
        first = np.searchsorted(starts, offsets)
        hashes = span_hash(prefix_hash(data, _VALUES), starts, ends)
        marks = ((ends - starts) << 16) | (data[starts].astype(np.int64) << 8) | data[ends - 1]
        easy = np.repeat(~whole, np.diff(first))
        keys, at, of = np.unique(hashes[easy], return_index=True, return_inverse=True)
        at = np.flatnonzero(easy)[at]
        level, place, sizes = self.known.find(keys, marks[at])
        # Another piece with an equal hash: the texts that hold one of them are encoded whole.
        clash = (level == -2)[of] | (marks[easy] != marks[at][of])
        if clash.any():
            whole[np.searchsorted(first, np.flatnonzero(easy)[clash], side="right") - 1] = True
        missing = np.flatnonzero(level == -1)
        found = self._pieces([raw[a:b].decode() for a, b in zip(starts[at[missing]].tolist(), ends[at[missing]].tolist(), strict=True)])
        sizes[missing] = [len(x) for x in found]
        pools = [x["pool"] for x in self.known.levels]
        base = np.zeros(len(keys), dtype=np.int64)
        for number, (x, past) in enumerate(zip(self.known.levels, (0, len(pools[0])), strict=True)):
            mine = level == number
            base[mine] = x["starts"][place[mine]] + past
        base[missing] = sum(map(len, pools)) + np.cumsum(sizes[missing]) - sizes[missing]
        per_piece = sizes[of]
        ids = gathered(np.concatenate([*pools, *found]), base[of], per_piece)
        if len(missing):
            self.known.add(keys[missing], marks[at[missing]], found)
        counts = np.zeros(len(starts), dtype=np.int64)
        counts[easy] = per_piece
        cuts = np.concatenate([[0], np.cumsum(counts)])[first]
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        hard = np.flatnonzero(whole)
        for i, x in zip(hard.tolist(), self._whole([raw[offsets[i] : offsets[i + 1]].decode() for i in hard]), strict=True):
            out[i] = x
        return out


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; of few samples the samples themselves, of none nothing."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


class Shard:
    """A shard file as it is written."""

    def __init__(self, place: str, dictionary: bytes, width: int) -> None:
        self.system, path = pafs.FileSystem.from_uri(place)
        self.name = f"{path}/{uuid.uuid4().hex}.ids"
        self.out = self.system.open_output_stream(self.name)
        self.digest, self.width = hashlib.sha256(dictionary).digest(), width
        self.out.write(HEADER.pack(MAGIC, self.digest, 0, width))
        self.doc_ids, self.counts, self.starts, self.size = [], [], [HEADER.size], 0

    def add(self, doc_id: int | None, n: int, frame: bytes) -> None:
        self.out.write(frame)
        self.doc_ids.append(doc_id)
        self.counts.append(n)
        self.starts.append(self.starts[-1] + len(frame))
        self.size += n * self.width

    def close(self) -> int:
        """Write the index; the number of bytes of the file."""
        nulls = np.array([i is None for i in self.doc_ids], dtype=np.uint8)
        parts = [
            np.array([i or 0 for i in self.doc_ids], dtype="<i8").tobytes(),
            nulls.tobytes(),
            np.array(self.counts, dtype="<u8").tobytes(),
            np.array(self.starts, dtype="<u8").tobytes(),
            struct.pack("<QQ", len(self.doc_ids), self.starts[-1]),
        ]
        self.out.write(b"".join(parts))
        self.out.close()
        return self.starts[-1] + sum(map(len, parts))


class ShardFile:
    """A shard file opened for reading; documents can be read one by one."""

    def __init__(self, system: pafs.FileSystem, name: str, dictionary: bytes) -> None:
        self.file = system.open_input_file(name)
        magic, digest, _, self.width = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} is not a shard written with this dictionary")
        end = self.file.size()
        n, index = struct.unpack("<QQ", self.file.read_at(16, end - 16))
        raw = self.file.read_at(end - 16 - index, index)
        ids, nulls = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n)
        self.doc_ids = [None if gone else int(i) for i, gone in zip(ids, nulls, strict=True)]
        self.counts = np.frombuffer(raw, "<u8", n, 9 * n)
        self.starts = np.frombuffer(raw, "<u8", n + 1, 17 * n).astype(np.int64)
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, k: int) -> np.ndarray:
        """The ids of the shard's document `k`, end id included."""
        frame = self.file.read_at(int(self.starts[k + 1] - self.starts[k]), int(self.starts[k]))
        raw = self.unpack.decompress(frame, max_output_size=int(self.counts[k]) * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def rows(self) -> Iterator[tuple[int | None, int, int]]:
        """(document id, ids, crc32 of the ids as 32-bit integers) of all documents in order."""
        for k, doc_id in enumerate(self.doc_ids):
            ids = self.ids(k)
            yield doc_id, len(ids), zlib.crc32(ids.tobytes())


class Output(NamedTuple):
    """A finished output: where it is, its dictionary and its shards in order."""

    place: str
    dictionary: bytes
    manifest: DataFrame


def write(docs: DataFrame, tokenizer_path: str, place: str | None = None) -> Output:
    """Encode every text and write shard files in ascending order of `doc_id`, NULL first.

    NULL and empty texts have the end id alone. Repeated ids stay next to each other, by
    the hash of their texts. An empty table has no shards. Other columns are not read.
    `place` is a folder that every executor can reach; by default one beside the
    checkpoints.
    """
    spark = docs.sparkSession
    place = place or folder(spark, "token-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else 4

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            for _, texts in pieces(batch, "text", GROUP_BYTES):
                some = [serialized(ids, width) for ids in encoder.encode(texts)]
                yield pa.RecordBatch.from_pydict({"ids": pa.array(some, pa.binary())})

    # A share of the hashes that holds somewhat more than is wanted, so that little is sorted.
    share = min(1.0, 4.0 * SAMPLE_ROWS / max(rows.count(), 1))
    some = rows.where(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 33) < share * (1 << 31))
    # Of a long text a stretch from anywhere in it.
    later = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    stretch = F.substring("text", 1 + F.pmod(F.xxhash64("text"), later).cast("int"), F.lit(SAMPLE_CHARS)).alias("text")
    sample = some.where("text <> ''").orderBy(F.xxhash64("doc_id", "text")).limit(SAMPLE_ROWS).select(stretch)
    samples = [bytes(r.ids) for r in sample.mapInArrow(encoded, "ids binary").collect()]
    dictionary = train_dictionary(samples)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        end = np.array([END_ID], dtype=np.uint32)
        part, number, shard = TaskContext.get().partitionId(), 0, None

        def finished() -> pa.RecordBatch:
            size = shard.close()
            return pa.RecordBatch.from_pydict(
                {
                    "part": [part], "number": [number], "path": [shard.name], "n_docs": [len(shard.doc_ids)],
                    "n_ids": [sum(shard.counts)], "n_bytes": [size],
                }
            )

        for rows, texts in (x for batch in batches for x in pieces(batch, "text", GROUP_BYTES)):
            for doc_id, found in zip(rows.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                shard = shard or Shard(place, dictionary, width)
                shard.add(doc_id, len(found) + 1, pack.compress(serialized(np.concatenate([found, end]), width)))
                if shard.size >= SHARD_BYTES:
                    yield finished()
                    number, shard = number + 1, None
        if shard:
            yield finished()

    schema = "part bigint, number bigint, path string, n_docs bigint, n_ids bigint, n_bytes bigint"
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return Output(place, dictionary, written(ordered.mapInArrow(shards, schema), "token-manifest"))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder per worker, with what it has learned from earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def read(output: Output) -> DataFrame:
    """`doc_id`, `start`, `n_tokens` and `ids_crc32` of every document, from the files.

    The manifest has a row per shard file, so its running sum is a small job.
    """
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = output.manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files = max(1, min(output.manifest.count(), 10_000))
    place, dictionary = output.place, output.dictionary

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(place)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                found = list(ShardFile(system, path, dictionary).rows())
                counts = np.array([n for _, n, _ in found], dtype=np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([d for d, _, _ in found], pa.int64()),
                        "start": pa.array(start + np.cumsum(counts) - counts),
                        "n_tokens": pa.array(counts),
                        "ids_crc32": pa.array([c for _, _, c in found], pa.int64()),
                    }
                )

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return starts.select("path", "start").repartition(files).mapInArrow(rows, schema)
