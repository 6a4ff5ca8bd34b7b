from __future__ import annotations

import os
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline as P
from plumbline.llm import decontaminate, language_id, mixing, near_dedup
from plumbline.llm.queries import QUERIES, table
from plumbline.llm.store import written
from tests.llm.test_near_dedup import _brute


def test_stages_keep_what_they_should(spark, folder):
    docs = table(spark, folder, "documents")
    columns = docs.columns
    whole = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, docs, folder), name.replace(" ", "-"))
        assert docs.columns == columns
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        kept = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert set(kept) <= set(rows) <= whole
        if name == "language id":
            assert all(any(c.isalpha() for c in t or "") for _, t in kept)
            assert len(kept) >= 0.99 * sum(any(c.isalpha() for c in t or "") for _, t in rows)
        elif name == "near duplicates":
            _, roots = _brute(rows, near_dedup.Rule(5, 80))
            assert sorted(i for i, _ in kept) == sorted(set(roots.values()))
        elif name == "decontamination":
            bad = decontaminate.contamination(before, table(spark, folder, "benchmark")).where("contaminated")
            assert sorted(i for i, _ in kept) == sorted({i for i, _ in rows} - {r.doc_id for r in bad.collect()})
        else:
            times = {r.doc_id: r.times for r in mixing.taken(before).collect()}
            assert sorted(i for i, _ in kept) == sorted(i for i, n in times.items() for _ in range(n))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    texts = dict(whole)
    found = P.STAGES[-1][1](spark, docs, folder).orderBy("start").collect()
    assert len(found) == len(kept)
    for r in found:
        ids = np.array([*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_stages_take_odd_tables(spark, odd, documents, folder):
    for docs in (odd, documents([])):
        for name, stage in P.STAGES[:-1]:
            docs = written(stage(spark, docs, folder), name.replace(" ", "-"))
            assert docs.columns == odd.columns
        assert P.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_registered_queries_are_these(folder):
    names = [n for n in entry_point.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    assert "pipeline" in names and set(QUERIES) < set(names)
    assert [n for n, _ in P.STAGES] == ["language id", "near duplicates", "decontamination", "mixing", "token ids"]
    assert os.path.isdir(folder) and language_id.UNDETERMINED == "und"
