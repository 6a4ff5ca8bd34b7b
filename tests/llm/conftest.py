from __future__ import annotations

import re
import zlib

import pytest

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")


def spaced_words(text: str | None) -> list[bytes]:
    """Words between white space, A-Z lower-cased."""
    return [w.lower() for w in SPACED.findall((text or "").encode())]


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


ODD_TEXTS = [None, "", "   \n\t ", "x", "Ünïcödé ß 漢字 🙂", "a" * 5000, "one two three " * 400, "same text here", "same text here"]


@pytest.fixture
def documents(spark):
    """A table like `documents` from (doc_id, text), with columns whose names clash with ours."""

    def make(rows: list[tuple], langs: list | None = None, sources: list | None = None):
        schema = (
            "doc_id bigint, text string, lang string, source string, n_chars bigint, "
            "size int, score string, digest string, row_ int, times string, kept string, lang_pred string"
        )
        full = [
            (i, t, langs[k] if langs else "en", sources[k] if sources else "src0", len(t or ""), 1, "s", "d", 2, "t", "k", "l")
            for k, (i, t) in enumerate(rows)
        ]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def odd(documents):
    """NULLs, empty, blank, long and repeated texts, a repeated row and a NULL id."""
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    return documents([*rows, (3, "x"), (None, "same text here"), (None, None)])
