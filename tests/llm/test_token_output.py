from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import token_output as T
from plumbline.llm.text_arrays import texts_of
from tests.llm.conftest import ODD_TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD_PIECES = [
    "it's", "we'll", "don''t", "'tis", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "naïve", "ß", "×", "ª", "²³",
    "½", "日本", "語", "🙂", "12", "a1", "<|endoftext|>", "...", "?!", "e.g.", "_x_", "İ", "ſ", " ",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def _plain(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_encoder_gives_the_library_s_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(T, "CACHED_PIECES", 200)
    monkeypatch.setattr(T, "FILED_PIECES", 20)
    encoder = T.Encoder(PATH)
    assert encoder.by_piece
    rng = random.Random(3)
    for _ in range(60):
        texts = ["".join(rng.choice([*ODD_PIECES, "word", " word", "Zwei"]) for _ in range(rng.randint(0, 25))) for _ in range(20)]
        found = encoder.encode(texts_of(pa.array(texts, pa.string())))
        assert [x.tobytes() for x in found] == [_plain(tokenizer, t) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_round_trip_in_order(documents, monkeypatch, name):
    monkeypatch.setattr(T, "SHARD_BYTES", 500)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "γάμμα", "42", "x-y"]) for _ in range(rng.randint(0, 80)))) for i in range(300)]
    rng.shuffle(rows)
    output = T.write(documents(rows).repartition(5), public_tokenizers.path(name))
    found = T.read(output).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(i for i, _ in rows)
    at, texts = 0, dict(rows)
    for r in found:
        raw = _plain(tokenizer, texts[r.doc_id]) + b"\0\0\0\0"
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    assert output.manifest.count() > 5


def test_one_document_can_be_read_alone_and_a_wrong_dictionary_is_refused(documents, tokenizer):
    rows = [(i, f"document number {i} " * 5) for i in range(200)]
    output = T.write(documents(rows), PATH)
    system, _ = pafs.FileSystem.from_uri(output.place)
    shard = T.ShardFile(system, output.manifest.first().path, output.dictionary)
    k = len(shard.doc_ids) // 2
    assert shard.ids(k).tobytes() == _plain(tokenizer, dict(rows)[shard.doc_ids[k]]) + b"\0\0\0\0"
    assert output.dictionary
    with pytest.raises(ValueError, match="dictionary"):
        T.ShardFile(system, output.manifest.first().path, b"other")


def test_odd_rows_and_empty_table(odd, documents):
    found = T.read(T.write(odd, PATH)).orderBy("start").collect()
    assert len(found) == len(ODD_TEXTS) + 3
    assert [r.doc_id for r in found][:2] == [None, None]
    assert [r.n_tokens for r in found if r.doc_id in (0, 1)] == [1, 1]
    assert T.read(T.write(documents([]), PATH)).count() == 0


def test_long_texts_alone_have_a_dictionary(documents):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(4000))) for i in range(12)]
    output = T.write(documents(rows), PATH)
    assert len(output.dictionary) > 1000
    assert sorted(r.doc_id for r in T.read(output).collect()) == list(range(12))
