"""Secrets in whole texts: fixed patterns and windows of high Shannon entropy.

Candidate strings are the longest runs of characters that keys are written in.
A window of fixed length slides over each stretch of a candidate that lies in
one character class; the entropy of its characters follows from the sum of
c * log2(c) over their counts c, and moving the window by one character changes
two counts, so a step costs the same for any window length. Windows of enough
bits that mix the kinds of characters their class asks for are joined into
spans. Patterns of an allow list take spans back that only look random.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the three base kinds, on lower-cased text for the first.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
LEAST_VALUE = 6

DIGITS, LOWER, UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class CharClass(NamedTuple):
    """Windows of ``window`` characters of ``alphabet`` with at least ``bits`` of
    entropy a character and one character of each string in ``mix``."""

    name: str
    alphabet: bytes
    window: int
    bits: float
    mix: tuple[bytes, ...]


CLASSES = (
    CharClass("hex_bits", DIGITS + b"abcdefABCDEF", 32, 3.0, (DIGITS, b"abcdefABCDEF")),
    CharClass("alnum_bits", DIGITS + LOWER + UPPER, 24, 3.9, (DIGITS, LOWER, UPPER)),
    CharClass("base64_bits", DIGITS + LOWER + UPPER + b"+/_=-", 32, 4.2, (DIGITS, LOWER, UPPER)),
)
#: Searched in a span's own text, in either case: names that say the value is
#: none, and runs of an alphabet in order.
ALLOW = ("example|sample|dummy|placeholder|changeme|redacted",
         "0123456789abcdef|abcdefghijkl|nopqrstuvwxyz|0123456789",
         "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")

#: c * log2(c) as whole numbers, so that sums moved step by step never drift.
_SCALE = 1 << 40


def count_terms(window: int) -> list[int]:
    return [0] + [round(c * math.log2(c) * _SCALE) for c in range(1, window + 1)]


def member_table(alphabet: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(alphabet)] = True
    return table


def runs(inside: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Longest stretches of true values of at least ``least`` places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    start, stop = edges[::2], edges[1::2]
    kept = stop - start >= least
    return list(zip(start[kept].tolist(), stop[kept].tolist()))


class Windows:
    """Sliding entropy of one character class."""

    def __init__(self, kind: CharClass):
        self.kind, self.member = kind, member_table(kind.alphabet)
        self.terms = count_terms(kind.window)
        #: entropy >= bits exactly when the sum of terms is at most this
        self.most = math.floor(kind.window * (math.log2(kind.window) - kind.bits) * _SCALE)
        self.group = [0] * 256
        for n, characters in enumerate(kind.mix):
            for c in characters:
                self.group[c] = n + 1

    def spans(self, run: bytes) -> list[tuple[int, int]]:
        """Joined windows of a run of the class's characters that pass."""
        width, terms, group, most = self.kind.window, self.terms, self.group, self.most
        counts, kinds, total = [0] * 256, [0] * (len(self.kind.mix) + 1), 0
        missing = len(self.kind.mix)
        out: list[tuple[int, int]] = []
        for i, new in enumerate(run):
            if i >= width:
                old = run[i - width]
                c = counts[old]
                counts[old] = c - 1
                total += terms[c - 1] - terms[c]
                g = group[old]
                kinds[g] -= 1
                if g and not kinds[g]:
                    missing += 1
            c = counts[new] = counts[new] + 1
            total += terms[c] - terms[c - 1]
            g = group[new]
            kinds[g] += 1
            if g and kinds[g] == 1:
                missing -= 1
            if i >= width - 1 and total <= most and not missing:
                start = i + 1 - width
                if out and out[-1][1] >= start:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((start, i + 1))
        return out


class Scanner:
    """All spans of a text, as (kind, start, stop) in bytes or code points."""

    def __init__(self, classes: Sequence[CharClass] = CLASSES, allow: Sequence[str] = ALLOW):
        self.windows = [Windows(c) for c in classes]
        self.allow = re.compile("|".join(f"(?:{a})" for a in allow).encode(), re.IGNORECASE) if allow else None
        # hex digits and the capitals of access keys are among them
        self.part = member_table(b"".join(c.alphabet for c in classes) + DIGITS + LOWER + UPPER)
        self.least = min([20, *[c.window for c in classes]])
        self.order = {k: n for n, k in enumerate([*BASE, *[c.name for c in classes]])}

    def bytes_spans(self, raw: bytes) -> list[tuple[str, int, int]]:
        out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(raw.lower())
               if m.end(2) - m.start(2) >= LEAST_VALUE]
        codes = np.frombuffer(raw, np.uint8)
        for a, b in runs(self.part[codes], self.least):
            run = raw[a:b]
            out += [("access", a + m.start(), a + m.end()) for m in ACCESS.finditer(run)]
            out += [("hex", a + m.start(), a + m.end()) for m in HEX.finditer(run)]
            for w in self.windows:
                for x, y in runs(w.member[codes[a:b]], w.kind.window):
                    for s, e in w.spans(run[x:y]):
                        if not (self.allow and self.allow.search(run, x + s, x + e)):
                            out.append((w.kind.name, a + x + s, a + x + e))
        return out

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """Spans in code points, by start, then kind."""
        raw = text.encode("utf-8", "surrogatepass")
        found = self.bytes_spans(raw)
        if found and not text.isascii():
            later = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80)
            at = lambda x: x - int(np.searchsorted(later, x))
            found = [(k, at(a), at(b)) for k, a, b in found]
        return sorted(found, key=lambda s: (s[1], self.order[s[0]]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", classes: Sequence[CharClass] = CLASSES,
         allow: Sequence[str] = ALLOW) -> DataFrame:
    """(key, spans): every secret of each whole text as array<struct<kind, start, stop>>.

    Spans count code points, their end is exclusive, and they are ordered by
    start, then kind: ``assign``, ``access``, ``hex``, then the names of
    ``classes``. Spans of different kinds may overlap; the allow list takes
    back spans of classes only. A null or empty text has no spans. Null and
    repeated keys are carried through, one result row for each input row;
    other columns are not read. An empty table gives an empty result. Work is
    linear in a text's length, memory about three times its bytes.
    """
    kind = docs.schema[key].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Scanner(classes, allow).spans
        for batch in batches:
            found = [[{"kind": k, "start": a, "stop": b} for k, a, b in spans(t.as_py() or "")]
                     for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, struct)], names=[key, "spans"])

    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, spans array<struct<kind: string, start: bigint, stop: bigint>>")


def joined(spans):
    """Spans as ``kind:start:end``, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                      s["stop"].cast("string"))))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digest of the base kinds and all spans as text, from ``scan``'s rows."""
    def n(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(key, *map(n, BASE), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
