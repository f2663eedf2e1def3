"""Secret scan: fixed formats, and credential values that would take many guesses.

Base spans have fixed formats: assignments to credential names, access keys and long hex strings. Beyond
them, a value in a credential context (a name such as "passwd", a sign or "is", then the value) is a secret
if guessing it is dear: a dynamic program over its characters finds the cheapest way to write it as known
words, dates, repeats, keyboard walks and brute-force spans; the sum of the logarithms is its cost.

Spans are in code points, end exclusive. Each document is read whole, on its own, with no shuffle.

Defined results: a null text is empty and has no spans; repeated documents are scanned each for itself; an
empty table gives no rows. Columns other than doc_id and text are not looked at by scan(), and kept by redacted().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame

from veilscan.llm.common import blobs, pick, slices

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run shorter than 24 fails whole, wherever it starts.
HEX = re.compile(r"[0-9a-f]{24,}")
#: What a text with any span must contain; in bytes, lower case.
HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"akia", b"pin", b"credential", b"login", b"auth", b"bearer")
HEX_BYTES = re.compile(rb"[0-9a-f]{24}")
CONTEXT = re.compile(
    r"""(?ai:(?<![A-Za-z0-9])(?:(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[ _-]?key|credentials?|login|auth|bearer)["']?(?:[ \t]*(?::=|=>|->|[:=])[ \t]*|[ \t]+(?:is|was)[ \t:]+)(?:bearer[ \t]+)?|bearer[ \t]+))["'`]?([^\s"'`<>,;]{6,})"""
)
#: Guesses (as a power of ten) from which on a value is taken for a secret.
GUESSES = 9.0

#: Words that people choose as passwords, most common first, and keyboard rows.
COMMON = (
    "password passwd pass admin administrator root user test guest welcome letmein login master secret token key "
    "changeme default example sample demo temp monkey dragon football baseball iloveyou sunshine princess shadow "
    "superman batman trustno hello freedom whatever michael jordan summer winter spring autumn google amazon server "
    "database public private access system manager service account backup oracle mysql postgres redis docker none "
    "null true false undefined your here value string placeholder redacted hidden enter insert foo bar baz qux "
    "required invalid incorrect correct expired missing needed wrong stored encrypted generated changed optional valid always never"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("4@01!35$7", "aaoiiesst")
#: Dates: year, month and day in this or the opposite order, with or without a sign between, and a year alone.
YEAR, MONTHS, DAYS, BETWEEN = "(?:19|20)[0-9][0-9]", ("0[1-9]|1[0-2]", "[1-9]"), ("0[1-9]|[12][0-9]|3[01]", "[1-9]"), "[-/._]?"
#: One pattern for each number of digits, since the cheapest segmentation may need any of the ends.
DATES = tuple(
    re.compile(BETWEEN.join(f"(?:{x})" for x in parts[::step]))
    for parts in [(YEAR, m, d) for m in MONTHS for d in DAYS]
    for step in (1, -1)
) + (re.compile(YEAR),)
#: Addresses after words such as "login" are no secrets, nor are web addresses without a password in them.
ADDRESS = re.compile(r"[^@\s:/]+@[\w.-]+\.[a-zA-Z]{2,}|[a-zA-Z][a-zA-Z0-9+.-]*://[^@\s]*")
#: Values up to this length are remembered.
SHORT = 64

DATE_COST = log10(365 * 120)
RANKS = {w: i + 1 for i, w in enumerate(COMMON)}
NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in ROWS for a, b in zip(row, row[1:])}
LONGEST = max(map(len, COMMON))


def _symbol(c: str) -> float:
    """Logarithm of the alphabet that a character is from."""
    return 1.0 if c.isdigit() else log10(26) if c.isalpha() and c.isascii() else log10(33) if c.isascii() else 2.0


def _capitals(piece: str) -> float:
    return 0.0 if piece.islower() or not piece.isalpha() else log10(2) if piece.istitle() or piece.isupper() else 0.3 * sum(c.isupper() for c in piece)


def guess_cost(value: str, most: float = float("inf")) -> float:
    """Power of ten of the guesses in the cheapest segmentation; any number from most on if it is not below most.

    No segmentation goes on from a place that costs most or more, so long values of many guesses end early.
    """
    return _remembered(value, most) if len(value) <= SHORT else _cheapest(value, most)


@lru_cache(maxsize=10_000)
def _remembered(value: str, most: float) -> float:
    return _cheapest(value, most)


def _cheapest(value: str, most: float) -> float:
    low, n = value.lower(), len(value)
    leet = low.translate(LEET)
    best = [0.0] + [float("inf")] * n
    # how a place was reached: the block's length of a repeat, -1 for a walk
    way = [0] * (n + 1)

    def reach(j: int, cost: float, by: int = 0) -> bool:
        """Whether to go on: a walk or repeat that began before and is no dearer here stays so to its end."""
        if cost < best[j]:
            best[j], way[j] = cost, by
            return True
        return not by or not way[j] or way[j] > 0 and (by < 0 or by % way[j] > 0)

    for i in range(n):
        here = best[i] + (0.3 if i else 0.0)  # one more segment to arrange
        if here >= most:
            continue
        brute = 0.0
        for j in range(i + 1, n + 1):
            brute += _symbol(value[j - 1])
            if here + brute >= most:
                break
            reach(j, here + brute)
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            for text, more in ((low, 0.0), (leet, 0.5)):
                if rank := RANKS.get(text[i:j]):
                    reach(j, here + log10(rank + 1) + more + _capitals(value[i:j]))
        if low[i].isdigit():
            for pattern in DATES:
                if m := pattern.match(low, i):
                    reach(m.end(), here + DATE_COST)
        j = i + 1
        while j < n and (low[j - 1], low[j]) in NEXT:
            j += 1
            if j - i >= 3 and not reach(j, here + log10(2 * len(NEXT)) + log10(j - i), -1):
                break
        block_cost = 0.0
        for size in range(1, (n - i) // 2 + 1):
            block_cost += _symbol(value[i + size - 1])
            if here + block_cost >= most:
                break
            block, times = value[i : i + size], 1
            while value.startswith(block, i + size * times):
                times += 1
                if not reach(i + size * times, here + block_cost + log10(times), size):
                    break
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the fixed formats, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The base spans, and those of credential values that no single one of them covers."""
    out = list(base)
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        value = m[1].rstrip(".!?)]}")
        end = start + len(value)
        if len(value) >= 6 and not ADDRESS.fullmatch(value) and guess_cost(value, GUESSES) >= GUESSES and not any(s <= start and end <= e for s, _, e in base):
            out.append((start, 3, end))
    return sorted(out)


def spans_of(raw: bytes) -> tuple[list, list]:
    """Base spans and all spans of a text in UTF-8."""
    low = raw.lower()
    if not any(h in low for h in HINTS) and not HEX_BYTES.search(raw):
        return [], []
    text = raw.decode()
    base = base_spans(text)
    return base, all_spans(text, base)


def listed(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, their digest, and all spans."""
    id_, text = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for raw in blobs(part.column(1)):
                base, spans = spans_of(raw)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            columns = [list(c) for c in zip(*rows)] or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            )

    return docs.select(id_.cast("long").alias("doc_id"), text.cast("string").alias("text")).mapInArrow(run, SCANNED)


def redact(text: str, spans: list) -> str:
    parts, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        parts.append(text[at : max(at, start)])
        if start >= at:
            parts.append("[SECRET]")
        at = end
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by [SECRET]; n_chars, where there is one, follows the new text."""
    columns, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            arrays = list(part.columns)
            texts, sizes = arrays[at].to_pylist(), {}
            for k, raw in enumerate(blobs(arrays[at])):
                spans = spans_of(raw)[1]
                if spans:
                    texts[k] = redact(raw.decode(), spans)
                    sizes[k] = len(texts[k])
            if sizes:
                arrays[at] = pa.array(texts, arrays[at].type)
                if "n_chars" in columns:
                    c = columns.index("n_chars")
                    arrays[c] = pa.array([sizes.get(k, n) for k, n in enumerate(arrays[c].to_pylist())], arrays[c].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return docs.mapInArrow(run, docs.schema)
