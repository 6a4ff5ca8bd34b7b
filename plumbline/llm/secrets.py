"""Secrets in text: fixed patterns, and values in credential contexts that are hard to guess.

A value's guess cost is the cheapest way to split it into dictionary words, dates,
repeats, keyboard walks, sequences and brute-force spans, as the decimal logarithm of
the guesses needed. Values after a credential word whose cost reaches a threshold are
reported beside those of the fixed patterns. The dictionary is a short list of common
passwords and the most frequent words of all documents, counted outside such values; a
value of several words, all of them in the dictionary, is taken to be prose, however many
they are.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import small_batches, written
from plumbline.llm.text_arrays import pieces, words

# Fixed patterns; ASCII letters of `assign` in either case.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "guess")

# What a value that is taken to be a credential comes after.
CONTEXT = re.compile(
    r"""(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|login"""
    r"""|(?:api|access|private|secret|encryption)[ _-]?key)["'`]?[ \t]*(?:[:=]|\bis\b)[ \t]*""",
    re.ASCII | re.IGNORECASE,
)
# A value in quotes, up to the mark that closes it on the same line, or one up to white space.
VALUE = re.compile(r""""((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\\n]|\\.)*+)`|["'`]?(\S+)""")
TRAILING = ".,;:!?)]}>\"'`"
# A text without any of these has neither an `assign` nor a credential context.
MARKS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "login")
# Decimal logarithm of guesses from which a value is a secret.
HARD = 10.0
# Words of the documents in the dictionary, and their length in characters.
LEARNED_WORDS = 50_000
SHORTEST_WORD, LONGEST_WORD = 3, 32
# Answers that a worker keeps, for values of at most so many characters.
KEPT_ANSWERS, KEPT_CHARS = 50_000, 200

# Words that guessers try first (fixed values).
COMMON_WORDS = (
    "password passwd pass secret admin root user login letmein welcome monkey dragon master hello "
    "freedom whatever shadow sunshine princess football baseball superman batman iloveyou trustno "
    "access hunter ranger buster soccer hockey killer george charlie andrew michelle jessica "
    "pepper daniel robert thomas jordan harley summer winter spring autumn love test guest default "
    "changeme example sample demo temp server system service database token key api public private "
    "company office house computer internet google apple orange banana cookie cheese flower purple "
    "yellow green black white silver golden diamond crystal angel baby money lucky star tiger eagle "
    "falcon phoenix matrix thunder storm ninja samurai wizard magic secure security the and you your "
    "none null true false value string insert here replace placeholder dummy"
).split()
KEYBOARD_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4301$5@7!", "aeoissati")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")

_RANK = {w: i + 1 for i, w in enumerate(COMMON_WORDS)}
_WORDS = re.compile(r"[^\W\d_]+")
_PLACE = {c: (r, i) for r, row in enumerate(KEYBOARD_ROWS) for i, c in enumerate(row)}
_CHARSETS = ((re.compile(r"[a-z]"), 26), (re.compile(r"[A-Z]"), 26), (re.compile(r"[0-9]"), 10), (re.compile(r"[^A-Za-z0-9]"), 33))
# What it costs to guess where a segment begins and of which kind it is.
_SEGMENT = math.log10(8)


def _beside(a: str, b: str) -> bool:
    (ra, ia), (rb, ib) = _PLACE.get(a, (9, 99)), _PLACE.get(b, (5, 50))
    return abs(ra - rb) <= 1 and abs(ia - ib) <= 1 and a != b


def _runs(value: str, joined: Callable[[str, str], bool], distance: int = 1) -> list[int]:
    """For each position, where the characters that are each joined to the one `distance` further end."""
    last = len(value) - distance
    ends = list(range(len(value)))
    for i in range(last - 1, -1, -1):
        if joined(value[i], value[i + distance]):
            ends[i] = ends[i + 1] if i + 1 < last else last
    return ends


def guess_cost(value: str, ranks: Mapping[str, int] = _RANK) -> float:
    """Decimal logarithm of the guesses of the cheapest segmentation; 0 for an empty value.

    `ranks` are the dictionary's words by the order in which they are guessed. Time is
    proportional to the length, so a value may be as long as a text.
    """
    n = len(value)
    if not n:
        return 0.0
    # Character by character, since a few change their number otherwise.
    low = "".join(c if len(k := c.lower()) != 1 else k for c in value)
    plain = low.translate(LEET)
    per_char = math.log10(sum(size for pattern, size in _CHARSETS if pattern.search(value)))
    walks = _runs(low, _beside)
    steps = {d: _runs(low, lambda a, b, d=d: ord(b) - ord(a) == d) for d in (0, 1, -1)}
    again = {unit: _runs(low, lambda a, b: a == b, unit) for unit in (2, 3, 4)}
    dates: dict[int, int] = {}
    for m in DATE.finditer(value):
        dates[m.start()] = m.end()
    best = [math.inf] * (n + 1)
    brute = [math.inf] * (n + 1)
    best[0] = 0.0

    def offer(end: int, cost: float) -> None:
        best[end] = min(best[end], cost)

    for i in range(n):
        # A brute-force span goes on at the price of a character alone.
        brute[i] = min(brute[i], best[i] + _SEGMENT)
        brute[i + 1] = min(brute[i + 1], brute[i] + per_char)
        best[i + 1] = min(best[i + 1], brute[i + 1])
        here = best[i] + _SEGMENT
        for j in range(i + SHORTEST_WORD, min(i + LONGEST_WORD, n) + 1):
            for form, extra in ((low, 0.0), (plain, 0.5)):
                if rank := ranks.get(form[i:j]):
                    upper = sum(c.isupper() for c in value[i:j])
                    offer(j, here + math.log10(rank) + extra + (math.log10(2 + upper) if upper else 0.0))
        if i in dates:
            offer(dates[i], here + math.log10(365 * 120))
        # Runs end with the character that the last one is joined to.
        if walks[i] - i >= 2:
            offer(walks[i] + 1, here + math.log10(47 * 8) + 0.5 * math.log10(walks[i] + 1 - i))
        for d, ends in steps.items():
            if ends[i] - i >= 2:
                offer(ends[i] + 1, here + (per_char if d == 0 else math.log10(20)) + math.log10(ends[i] + 1 - i))
        for unit, ends in again.items():
            times = 1 + (ends[i] - i) // unit
            if times > 1:
                offer(i + times * unit, here + unit * per_char + math.log10(times))
    return best[n]


def is_prose(value: str, ranks: Mapping[str, int]) -> bool:
    """Whether a value has several words parted by blanks, all without digits and in the dictionary or shorter than its words."""
    parts = value.split()
    if len(parts) < 2 or any(c.isdigit() for c in value):
        return False
    found = [w for part in parts for w in _WORDS.findall(part.lower())]
    return len(found) >= 2 and all(len(w) < SHORTEST_WORD or w in ranks for w in found)


class Guesser:
    """Tells which values are hard to guess, by one dictionary."""

    def __init__(self, ranks: Mapping[str, int]) -> None:
        self.ranks = ranks
        self._kept = lru_cache(maxsize=KEPT_ANSWERS)(self._hard)

    def _hard(self, value: str) -> bool:
        return not is_prose(value, self.ranks) and guess_cost(value, self.ranks) >= HARD

    def hard(self, value: str) -> bool:
        return self._kept(value) if len(value) <= KEPT_CHARS else self._hard(value)


def word_ranks(docs: DataFrame, most: int = LEARNED_WORDS) -> dict[str, int]:
    """The words that occur most often in all texts, from 1, at most `most` of them, with the fixed ones.

    Values in credential contexts are left out, so that a secret isn't learned however
    often it was copied; words met once are no words. Words of about equal count are taken
    together or not at all, so that no more than `most` rows reach the driver. Equal counts
    go by the word.
    """
    value = CONTEXT.pattern + r"""(?:"[^"\n]*"|'[^'\n]*'|`[^`\n]*`|\S+)"""
    text = F.when(F.lower("text").rlike("|".join(MARKS)), F.regexp_replace("text", f"(?i){value}", " ")).otherwise(F.col("text"))
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    words_ = docs.select(F.explode(found).alias("word")).where(F.length("word").between(SHORTEST_WORD, LONGEST_WORD))
    # Sixteen levels to each doubling of a count, so about a thousand in all.
    level = F.floor(F.log2("n") * 16).alias("level")
    counted = words_.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = written(counted.select("word", "n", level), "word-counts")
    levels = sorted(((r.level, r["count"]) for r in counted.groupBy("level").count().collect()), reverse=True)
    taken = [at for (at, _), upto in zip(levels, accumulate(n for _, n in levels), strict=True) if upto <= most]
    rows = counted.where(F.col("level") >= taken[-1]).collect() if taken else []
    rows.sort(key=lambda r: (-r.n, r.word))
    learned = {r.word: k + 1 for k, r in enumerate(rows)}
    return {w: min(k, learned.get(w, k)) for w, k in {**learned, **_RANK}.items()}


def base_spans(text: str, assign: bool = True, hexadecimal: bool = True) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the fixed patterns' matches, by start, then kind."""
    out = []
    if assign:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= SHORTEST["access"]]
    if hexadecimal:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= SHORTEST["hex"]]
    return sorted(out)


def guess_spans(text: str, taken: list[tuple[int, int, int]], guesser: Guesser) -> list[tuple[int, int, int]]:
    """Hard values in credential contexts that no single span of `taken`, in order, covers."""
    out, at = [], 0
    begins = [a for a, _, _ in taken]
    reach = list(accumulate((b for _, _, b in taken), max))
    for context in CONTEXT.finditer(text):
        if context.start() < at:
            continue
        # Of contexts in a row, the last one has the value.
        m = None if CONTEXT.match(text, context.end()) else VALUE.match(text, context.end())
        if m is None:
            continue
        at = m.end()
        start, end = m.span(m.lastindex)
        if m.lastindex == 4:
            end = start + len(m[4].rstrip(TRAILING))
        before = bisect_right(begins, start)
        covered = before > 0 and reach[before - 1] >= end
        if end - start >= 6 and not covered and guesser.hard(text[start:end]):
            out.append((start, 3, end))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


_IS_HEX = np.zeros(256, dtype=bool)
_IS_HEX[48:58] = _IS_HEX[97:103] = True


def _scan(batches: Iterator[pa.RecordBatch], ranks: Mapping[str, int]) -> Iterator[pa.RecordBatch]:
    guesser = Guesser(ranks)
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        for part, texts in pieces(batch, "text"):
            runs = words(texts, _IS_HEX)
            long = np.concatenate([[0], np.cumsum(runs.ends - runs.starts >= SHORTEST["hex"])])
            has_hex = long[runs.offsets[1:]] > long[runs.offsets[:-1]]
            counts, digests, spans = np.zeros((part.num_rows, 3), dtype=np.int64), [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                text = text or ""
                low = text.lower()
                marked = any(m in low for m in MARKS)
                if not (marked or has_hex[i] or "AKIA" in text):
                    digests.append(nothing)
                    spans.append("")
                    continue
                base = base_spans(text, marked, bool(has_hex[i]))
                for _, kind, _ in base:
                    counts[i, kind] += 1
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(base + (guess_spans(text, base, guesser) if marked else [])))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_assign": pa.array(counts[:, 0]),
                    "n_access": pa.array(counts[:, 1]),
                    "n_hex": pa.array(counts[:, 2]),
                    "base_sha256": pa.array(digests, pa.string()),
                    "spans": pa.array(spans, pa.string()),
                }
            )


def scan(docs: DataFrame, ranks: Mapping[str, int] | None = None) -> DataFrame:
    """Spans of secrets in every text, one row for each row of `docs`.

    `ranks` is the dictionary, by default `word_ranks(docs)`. `spans` lists kind:start:end
    in code points, the end exclusive. NULL and empty texts have none, and the digest is
    that of the empty string. Texts and values of any length are read whole, in time
    proportional to it. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    schema = docs.select("doc_id").schema
    for name in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(name, "long")
    known = dict(word_ranks(docs) if ranks is None else ranks)
    schema = schema.add("base_sha256", "string").add("spans", "string")
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _scan(batches, known), schema)
