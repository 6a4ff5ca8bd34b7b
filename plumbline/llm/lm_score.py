"""Log probabilities of texts under a bigram model by deleted interpolation.

A token's probability mixes a uniform share, the maximum-likelihood unigram and the
maximum-likelihood bigram. Their weights depend on how often the context was seen, in
buckets by powers of two, and are learned by expectation-maximisation on training
documents whose own counts are deleted from the estimates.

Counting is spread in two ways. A block is a run of documents of one input partition: its
words become numbers, kept in a file in the shared folder. A range is a share of the hash
space of words and bigrams. Each block sends each range its distinct hashes, sorted and
packed, with their counts in training documents; the range adds up the counts of all
blocks and answers each one in its own order, so an answer needs no hashes. A word that a
third of all documents holds is one entry per block.

Words and bigrams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocks import arrow_schema, cuts, pack, pack_sorted, runs_of, store, unpack, unpack_sorted
from plumbline.llm.store import folder, written
from plumbline.llm.text_arrays import SPACED, mix, pieces, word_hashes, words

# Tokens of a block and bytes of text that a range stands for, about.
BLOCK_TOKENS = 1_000_000
RANGE_BYTES = 8 << 20
HELD_OUT_FOLD = 1
BUCKETS = 16
# Estimates are put in cells of a tenth of a decade when the weights are learned.
CELLS = 122
LEAST_UNIFORM = 1e-4
DEFAULT_WEIGHTS = (0.1, 0.5, 0.4)

_END = np.uint64(0xE17D0000E17D0001)
_BEGIN = np.uint64(0xBE610000BE610001)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Block(NamedTuple):
    """Documents with their tokens as numbers into the block's sorted word hashes.

    Each document has its words, then the end.
    """

    doc_ids: np.ndarray
    null_ids: np.ndarray
    folds: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    tokens: np.ndarray

    @property
    def contexts(self) -> np.ndarray:
        """What stands before each token, as numbers; the begin at a document's first."""
        out = np.roll(self.tokens, 1)
        out[self.offsets[:-1]] = np.searchsorted(self.hashes, _BEGIN)
        return out

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct bigram hashes and each token's number among them."""
        pairs = mix(self.hashes[self.contexts] * _STEP + self.hashes[self.tokens])
        return np.unique(pairs, return_inverse=True)

    def training(self) -> np.ndarray:
        return np.repeat(self.folds != HELD_OUT_FOLD, np.diff(self.offsets))

    def unigram_counts(self) -> np.ndarray:
        """In training documents; the begin is counted as a context, once per document."""
        counts = np.bincount(self.tokens[self.training()], minlength=len(self.hashes))
        counts[np.searchsorted(self.hashes, _BEGIN)] = (self.folds != HELD_OUT_FOLD).sum()
        return counts

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(
            out, doc_ids=self.doc_ids, null_ids=self.null_ids, folds=self.folds, offsets=self.offsets,
            n=len(self.hashes), hashes=np.frombuffer(pack_sorted(self.hashes), np.uint8),
            tokens=np.frombuffer(pack(self.tokens.astype(np.uint32)), np.uint8),
        )
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Block:
        f = np.load(io.BytesIO(raw))
        hashes = unpack_sorted(f["hashes"].tobytes(), int(f["n"]))
        tokens = unpack(f["tokens"].tobytes(), np.uint32, int(f["offsets"][-1])).astype(np.int64)
        return cls(f["doc_ids"], f["null_ids"], f["folds"], f["offsets"], hashes, tokens)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    parts: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
    size = 0

    def made() -> Block:
        ids = [b.column("doc_id") for b, _, _ in parts]
        nulls = np.concatenate([i.is_null().to_numpy(zero_copy_only=False) for i in ids])
        values = np.concatenate([i.fill_null(0).to_numpy(zero_copy_only=False) for i in ids])
        folds = np.concatenate([b.column("fold").to_numpy(zero_copy_only=False) for b, _, _ in parts]).astype(np.int8)
        hashes = np.concatenate([h for _, h, _ in parts])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([n for _, _, n in parts]))])
        distinct, tokens = np.unique(np.append(hashes, _BEGIN), return_inverse=True)
        parts.clear()
        return Block(values, nulls, folds, offsets, distinct, tokens[:-1])

    for batch in batches:
        for part, texts in pieces(batch, "text"):
            found = words(texts, SPACED)
            counts = np.diff(found.offsets)
            hashes = np.insert(word_hashes(texts, found), found.offsets[1:], _END)
            parts.append((part, hashes, counts + 1))
            size += len(hashes)
            if size >= BLOCK_TOKENS:
                yield made()
                size = 0
    if parts:
        yield made()


_SENT = "range bigint, block bigint, n1 bigint, h1 binary, c1 binary, n2 bigint, h2 binary, c2 binary"
_ANSWERED = "block bigint, range bigint, n1 bigint, c1 binary, n2 bigint, c2 binary, tokens bigint, types bigint"


def _send(batches: Iterator[pa.RecordBatch], place: str, bits: int) -> Iterator[pa.RecordBatch]:
    system, path = pafs.FileSystem.from_uri(place)
    part = TaskContext.get().partitionId()
    for number, block in enumerate(blocks_of(batches)):
        name = (part << 32) | number
        store(system, f"{path}/{name:016x}", block.dump())
        counts1 = block.unigram_counts()
        pairs, of = block.bigrams()
        counts2 = np.bincount(of[block.training()], minlength=len(pairs))
        cuts1, cuts2 = cuts(block.hashes, bits), cuts(pairs, bits)
        rows = []
        for r in range(1 << bits):
            (a, b), (c, d) = cuts1[r : r + 2], cuts2[r : r + 2]
            if b > a or d > c:
                packed = [pack_sorted(block.hashes[a:b]), pack(counts1[a:b].astype(np.uint32)), pack_sorted(pairs[c:d]), pack(counts2[c:d].astype(np.uint32))]
                rows.append((r, name, int(b - a), packed[0], packed[1], int(d - c), packed[2], packed[3]))
        names = [f.split()[0] for f in _SENT.split(", ")]
        yield pa.RecordBatch.from_pydict({n: [row[i] for row in rows] for i, n in enumerate(names)}, schema=_SENT_ARROW)


_SENT_ARROW, _ANSWERED_ARROW = arrow_schema(_SENT), arrow_schema(_ANSWERED)


def _totals(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct hashes, their total counts, and the totals in the order of each list."""
    distinct, of = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(of, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.uint64)
    ends = np.cumsum([len(h) for h in hashes])[:-1]
    return distinct, total, np.split(total[of], ends)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in runs_of(batches, ["range"]):
        rows = run.to_pylist()
        h1 = [unpack_sorted(r["h1"], r["n1"]) for r in rows]
        d1, t1, per1 = _totals(h1, [unpack(r["c1"], np.uint32, r["n1"]) for r in rows])
        h2 = [unpack_sorted(r["h2"], r["n2"]) for r in rows]
        _, _, per2 = _totals(h2, [unpack(r["c2"], np.uint32, r["n2"]) for r in rows])
        word = d1 != _BEGIN
        out = {
            "block": [r["block"] for r in rows],
            "range": [r["range"] for r in rows],
            "n1": [r["n1"] for r in rows],
            "c1": [pack(c) for c in per1],
            "n2": [r["n2"] for r in rows],
            "c2": [pack(c) for c in per2],
            # What the range holds in all, told once.
            "tokens": [int(t1[word].sum())] + [0] * (len(rows) - 1),
            "types": [int((t1[word] > 0).sum())] + [0] * (len(rows) - 1),
        }
        yield pa.RecordBatch.from_pydict(out, schema=_ANSWERED_ARROW)


class Counted(NamedTuple):
    """Answers to all blocks, where their files are, and the training totals."""

    answers: DataFrame
    place: str
    tokens: int
    types: int


def counted(docs: DataFrame) -> Counted:
    """Count the training documents among `docs` and send every block what it needs."""
    spark = docs.sparkSession
    place = folder(spark, "lm-blocks")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(size // RANGE_BYTES).bit_length())
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(HELD_OUT_FOLD))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.cast("long").alias("fold"), "text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.mapInArrow(lambda it: _send(it, place, bits), _SENT)
    by_range = sent.repartition(max(partitions, 1), "range").sortWithinPartitions("range")
    answers = written(by_range.mapInArrow(_answer, _ANSWERED), "lm-answers")
    totals = answers.agg(F.sum("tokens"), F.sum("types")).first()
    return Counted(answers, place, totals[0] or 0, totals[1] or 0)


class Scored(NamedTuple):
    """A block with the counts of each token, its bigram and its context."""

    block: Block
    unigram: np.ndarray
    bigram: np.ndarray
    context: np.ndarray
    of: np.ndarray


def _ready(batches: Iterator[pa.RecordBatch], place: str) -> Iterator[Scored]:
    system, path = pafs.FileSystem.from_uri(place)
    for run in runs_of(batches, ["block"]):
        name = run.column("block")[0].as_py()
        with system.open_input_stream(f"{path}/{name:016x}") as file:
            block = Block.load(file.read())
        rows = sorted(run.select(["range", "n1", "c1", "n2", "c2"]).to_pylist(), key=lambda r: r["range"])
        c1 = np.concatenate([unpack(r["c1"], np.uint64, r["n1"]) for r in rows])
        c2 = np.concatenate([unpack(r["c2"], np.uint64, r["n2"]) for r in rows])
        _, of = block.bigrams()
        yield Scored(block, c1[block.tokens].astype(np.int64), c2[of].astype(np.int64), c1[block.contexts].astype(np.int64), of)


def by_block(answers: DataFrame) -> DataFrame:
    partitions = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return answers.select("block", "range", "n1", "c1", "n2", "c2").repartition(partitions, "block").sortWithinPartitions("block")


def bucket(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's count: 0 for none, then by powers of two."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _cell(p: np.ndarray) -> np.ndarray:
    """Tenths of a decade below 1, from 1; 0 for a probability of 0."""
    tenth = np.round(-10 * np.log10(np.where(p > 0, p, 1))).astype(np.int64)
    return np.where(p > 0, np.clip(tenth, 0, CELLS - 2) + 1, 0)


def _histogram(batches: Iterator[pa.RecordBatch], place: str, tokens: int) -> Iterator[pa.RecordBatch]:
    """Tokens of all training documents by the cells of their estimates, each document's own counts deleted."""
    total = np.zeros(BUCKETS * CELLS * CELLS, dtype=np.int64)
    for x in _ready(batches, place):
        docs = np.repeat(np.arange(len(x.block.folds)), np.diff(x.block.offsets))
        learn = np.repeat(x.block.folds != HELD_OUT_FOLD, np.diff(x.block.offsets))
        docs = docs[learn]

        def own(values: np.ndarray, docs: np.ndarray = docs) -> np.ndarray:
            """How often each token's value occurs in its own document."""
            _, of, n = np.unique((docs << 32) | values, return_inverse=True, return_counts=True)
            return n[of]

        length = np.repeat(np.diff(x.block.offsets), np.diff(x.block.offsets))[learn]
        before, begin = x.block.contexts[learn], np.searchsorted(x.block.hashes, _BEGIN)
        unigram = x.unigram[learn] - own(x.block.tokens[learn])
        bigram = x.bigram[learn] - own(x.of[learn])
        context = x.context[learn] - np.where(before == begin, 1, own(before))
        p1 = unigram / np.maximum(tokens - length, 1)
        p2 = np.where(context > 0, bigram / np.maximum(context, 1), 0.0)
        cells = (bucket(context) * CELLS + _cell(p1)) * CELLS + _cell(p2)
        total += np.bincount(cells, minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"cell": pa.array(used), "n": pa.array(total[used])})


def expectation_maximisation(cells: np.ndarray, n: np.ndarray, types: int, rounds: int = 200) -> np.ndarray:
    """Weights of the uniform share, the unigram and the bigram for each bucket."""
    weights = np.tile(np.array(DEFAULT_WEIGHTS), (BUCKETS, 1))
    weights[0] = (0.2, 0.8, 0.0)
    of, c1, c2 = cells // CELLS**2, cells // CELLS % CELLS, cells % CELLS
    p = np.stack([np.full(len(cells), 1 / (types + 1)), *(np.where(c > 0, 10.0 ** (-(c - 1) / 10), 0.0) for c in (c1, c2))], axis=1)
    for _ in range(rounds):
        share = weights[of] * p
        share *= (n / share.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(of, weights=s, minlength=BUCKETS) for s in share.T], axis=1)
        seen = sums.sum(axis=1) > 0
        weights[seen] = sums[seen] / sums[seen].sum(axis=1, keepdims=True)
        weights[:, 0] = np.maximum(weights[:, 0], LEAST_UNIFORM)
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


def _score(batches: Iterator[pa.RecordBatch], place: str, tokens: int, types: int, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for x in _ready(batches, place):
        at = x.block.offsets[:-1]
        base = np.log10((x.unigram + 0.5) / (tokens + 0.5 * (types + 1)))
        w = weights[bucket(x.context)]
        p = w[:, 0] / (types + 1) + w[:, 1] * (x.unigram / max(tokens, 1))
        # A context never seen has no bigram; its bucket's weight of it is 0.
        p += w[:, 2] * (x.bigram / np.maximum(x.context, 1))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(x.block.doc_ids, mask=x.block.null_ids),
                "held_out": pa.array(x.block.folds == HELD_OUT_FOLD),
                "n_tokens": pa.array(np.diff(x.block.offsets)),
                "n_known": pa.array(np.add.reduceat((x.unigram > 0).astype(np.int64), at)),
                "train_tokens": pa.array(np.full(len(at), tokens, dtype=np.int64)),
                "base_score": pa.array(np.add.reduceat(base, at)),
                "score": pa.array(np.add.reduceat(np.log10(p), at)),
            }
        )


def scores(docs: DataFrame) -> DataFrame:
    """Scores of every row of `docs`, learned from the rows outside the held-out fold.

    NULL and empty texts are the end alone. A NULL id counts as held out. Repeated rows
    count and score each for itself. Without training rows all probabilities are uniform;
    an empty table gives an empty result. Columns other than `doc_id` and `text` are not
    read.
    """
    found = counted(docs)
    place, tokens, types = found.place, found.tokens, found.types
    cells = (
        by_block(found.answers).mapInArrow(lambda it: _histogram(it, place, tokens), "cell bigint, n bigint")
        .groupBy("cell").agg(F.sum("n").alias("n")).toPandas().sort_values("cell")
    )
    if tokens:
        weights = expectation_maximisation(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.int64), types)
    else:
        weights = np.tile(np.array([1.0, 0.0, 0.0]), (BUCKETS, 1))
    schema = (
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
    return by_block(found.answers).mapInArrow(lambda it: _score(it, place, tokens, types, weights), schema)
