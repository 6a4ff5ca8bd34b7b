from __future__ import annotations

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import text_arrays as A

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB z1.\n\té漢🙂'", max_size=30)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_and_shingles_are_those_of_the_pattern(values):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(values, pa.string())})
    for table, pattern in ((A.SPACED, rb"[^\x20\x09-\x0D]+"), (A.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = 0
        for part, texts in A.pieces(batch, "text", 16):
            found = A.words(texts, table)
            hashes = A.word_hashes(texts, found)
            grams, offsets = A.shingles(hashes, found.offsets, 3)
            for i, value in enumerate(part.column("text").to_pylist()):
                raw = bytes((value or "").encode())
                raw = raw.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
                words = re.findall(pattern, raw)
                mine = slice(found.offsets[i], found.offsets[i + 1])
                got = [texts.data[a:b].tobytes().lower() for a, b in zip(found.starts[mine], found.ends[mine], strict=True)]
                assert got == words
                sets = {tuple(words[k : k + 3]) for k in range(len(words) - 2)} or ({tuple(words)} if words else set())
                assert offsets[i + 1] - offsets[i] == len(sets)
                seen += 1
        assert seen == len(values)


def test_equal_words_have_equal_hashes_and_others_do_not():
    values = ["alpha beta", "BETA Alpha gamma", "beta"]
    texts = A.texts_of(pa.array(values))
    h = A.word_hashes(texts, A.words(texts, A.SPACED)).tolist()
    assert h[0] == h[3] and h[1] == h[2] == h[5] and len(set(h)) == 3
