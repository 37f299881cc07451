"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for every position, the polynomial hash of the
code points before it, modulo a prime. The hash of any span is a difference of
two entries, so equality of spans takes constant time, the longest common
extension of two positions a binary search, and the hash of a text put
together from spans follows from its parts' arrays. A fingerprint is the whole
text's hash and a sketch: the least of the hashes of all its spans of a fixed
width. Likeness compares sketches.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.llm.common import mix64

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 998_244_353)
WIDTH = 16
SKETCH = 64
#: Text of a range of keys, and the most ranges there are.
RANGE_BYTES, MOST_RANGES = 4_000_000, 20_000

_powers: dict[int, np.ndarray] = {}


def powers(which: int, n: int) -> np.ndarray:
    """The first n powers of a base, kept by each worker and doubled when too few."""
    p, have = np.uint64(PRIMES[which]), _powers.get(which, np.ones(1, np.uint64))
    while len(have) < n:
        factor = np.uint64(pow(BASES[which], len(have), PRIMES[which]))
        have = np.concatenate([have, have * factor % p])
    if len(have) <= 1 << 22:
        _powers[which] = have
    return have[:n]


class Prefixes:
    """The prefix arrays of a text under both moduli."""

    def __init__(self, codes: np.ndarray):
        self.n, self.sums = len(codes), []
        values = codes.astype(np.uint64) + np.uint64(1)
        for w, p in enumerate(PRIMES):
            terms = values * powers(w, self.n) % np.uint64(p)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])  # below 2^63 up to 2^32 code points
            sums[1:] %= np.uint64(p)
            self.sums.append(sums)

    def raw(self, w: int, start, stop) -> np.ndarray:
        """Hash of a span times the base to the power of its start."""
        p = np.uint64(PRIMES[w])
        return (self.sums[w][stop] + p - self.sums[w][start]) % p

    def equal(self, a: int, b: int, length: int, other: Prefixes | None = None) -> bool:
        """Whether this text's span at a equals the span at b (of another text)."""
        other = other or self
        if a + length > self.n or b + length > other.n:
            return False
        return all(int(self.raw(w, a, a + length)) * pow(BASES[w], b, p) % p
                   == int(other.raw(w, b, b + length)) * pow(BASES[w], a, p) % p
                   for w, p in enumerate(PRIMES))

    def extension(self, a: int, b: int, other: Prefixes | None = None) -> int:
        """Length of the longest common extension of positions a and b, by binary search."""
        low, high = 0, min(self.n - a, (other or self).n - b)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(a, b, mid, other):
                low = mid
            else:
                high = mid - 1
        return low

    def whole(self) -> tuple[int, int]:
        return tuple(int(s[-1]) for s in self.sums)

    def windows(self, start: int, stop: int, width: int) -> np.ndarray:
        """64-bit values of all spans of a width that lie within [start, stop)."""
        m = stop - start - width + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        at, out = slice(start, start + m), []
        for w, p in enumerate(PRIMES):
            s = self.sums[w]
            span = (s[start + width:start + width + m] + np.uint64(p) - s[at]) % np.uint64(p)
            # shifted to a common place: the power that is missing up to the last start
            out.append(span * powers(w, stop)[stop - 1 - np.arange(start, start + m)] % np.uint64(p))
        return self._placed(out, stop - 1)

    @staticmethod
    def _placed(hashes: list[np.ndarray], place: int) -> np.ndarray:
        for w, p in enumerate(PRIMES):
            back = np.uint64(pow(pow(BASES[w], place, p), -1, p))
            hashes[w] = hashes[w] * back % np.uint64(p)
        return mix64(hashes[0] << np.uint64(31) | hashes[1])


def joined_hash(first: tuple[int, int], length: int, second: tuple[int, int]) -> tuple[int, int]:
    """Hash of a text of a length followed by another."""
    return tuple((a + b * pow(BASES[w], length, p)) % p for w, (p, a, b) in enumerate(zip(PRIMES, first, second)))


def least(values: np.ndarray, k: int) -> np.ndarray:
    """The k least distinct values, sorted."""
    m = 2 * k
    while len(values) > m:
        got = np.unique(np.partition(values, m)[:m])
        if len(got) >= k:
            return got[:k]
        m *= 8
    return np.unique(values)[:k]


def render(length: int, whole: tuple[int, int], sketch: np.ndarray) -> str:
    """Length and whole hash, then the sketch's high halves."""
    return f"{length:x}-{whole[0]:08x}{whole[1]:08x}-" + (sketch >> np.uint64(32)).astype(">u4").tobytes().hex()


def likeness(a: str, b: str, k: int = SKETCH) -> float:
    """Estimated share of common spans from two fingerprints; 1 for equal ones."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s.rsplit("-", 1)[1]), ">u4") for s in (a, b))
    both = np.unique(np.concatenate([x, y]))[:k]
    if not len(both):
        return 0.0
    return float(np.isin(np.intersect1d(x, y, assume_unique=False), both).sum() / len(both))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprint(text: str, width: int = WIDTH, k: int = SKETCH) -> str:
    p = Prefixes(codes_of(text))
    return render(p.n, p.whole(), _sketch(p, width, k))


def _sketch(p: Prefixes, width: int, k: int) -> np.ndarray:
    return least(p.windows(0, p.n, min(width, p.n) or 1), k)


def edited_fingerprint(own: Prefixes, own_codes: np.ndarray, kept: int, after: Prefixes, after_codes: np.ndarray,
                       taken: int, width: int, k: int) -> str:
    """Fingerprint of own[:kept] + after[:taken], from both prefix arrays."""
    n = kept + taken
    head = tuple(int(s[kept]) for s in own.sums)
    whole = joined_hash(head, kept, tuple(int(s[taken]) for s in after.sums))
    width = min(width, n) or 1
    a, b = max(kept - width + 1, 0), min(taken, width - 1)
    seam = Prefixes(np.concatenate([own_codes[a:kept], after_codes[:b]]))
    values = np.concatenate([own.windows(0, kept, width), seam.windows(0, seam.n, width),
                             after.windows(0, taken, width)])
    return render(n, whole, least(values, k))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                 k: int = SKETCH) -> DataFrame:
    """(key, n_chars, fingerprint) of every row; null texts are empty, keys are carried through."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([fingerprint(t, width, k) for t in texts])], names=[key, "n_chars", "fingerprint"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_chars long, fingerprint string")


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows in ranges of descending keys, each range followed by the next one's first row.

    Columns: key, text, _range, _extra (true for the row lent by the next
    range). Ranges hold about RANGE_BYTES of text, and there are MOST_RANGES
    at most, so that their bounds fit a broadcast; each is a partition of its
    own, whatever the number of shuffle partitions. Only the rows lent, one
    for each range, are copied.
    """
    spark = docs.sparkSession
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text))
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = min(max(-(-size // RANGE_BYTES), 1), MOST_RANGES)
    bounds = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n))).first()[0] or []
    bounds = sorted(set(bounds))
    held = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        """How many bounds a key doesn't exceed."""
        return pd.Series([len(held.value) - bisect_left(held.value, k) for k in keys.tolist()], dtype="int32")

    # null keys come after all others; in pandas they would turn integers into floating-point numbers
    rows = rows.withColumn("_range", F.when(F.col(key).isNull(), F.lit(len(bounds) + 1)).otherwise(
        range_of(F.coalesce(F.col(key), F.lit(bounds[0]))) if bounds else F.lit(0)))
    heads = {r["_range"]: r["top"] for r in rows.groupBy("_range").agg(F.max(key).alias("top")).collect()}
    order = sorted(heads)
    lent = [(r, heads[r], order[i - 1]) for i, r in enumerate(order)]
    lent = spark.createDataFrame(lent, f"_range int, _top {docs.schema[key].dataType.simpleString()}, _to int")
    # the first row of a range, by key and then text, both descending
    first = (rows.join(F.broadcast(lent), "_range").where(F.col(key).eqNullSafe(F.col("_top")))
             .groupBy("_to").agg(F.max(F.struct(text, key)).alias("h")))
    first = first.select(F.col(f"h.{key}").alias(key), F.col(f"h.{text}").alias(text),
                         F.col("_to").alias("_range"), F.lit(True).alias("_extra"))
    return (rows.withColumn("_extra", F.lit(False)).unionByName(first)
            .repartitionById(len(bounds) + 2, F.col("_range"))
            .sortWithinPartitions("_range", "_extra", F.desc_nulls_last(key), F.desc(text)))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                        k: int = SKETCH) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has the last floor(n/2) code points replaced by the first
    as many (or all) of the next document, descending key, the first one
    following the last. Equal keys follow each other by descending text; null
    keys come last. A null text is empty; a table of one row follows itself.
    Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, common_prefix (code points that the text and the
    next one begin with alike, by binary search over prefix hashes). Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
             "common_prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out = []
            for i, t, r, extra in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(),
                                      batch.column(3).to_pylist()):
                codes = codes_of(t.as_py())
                p = Prefixes(codes)
                now = (i, r, codes, p, render(p.n, p.whole(), _sketch(p, width, k)))
                if before is not None and before[1] == r:
                    out.append(_edited(before, now, width, k))
                before = None if extra else now
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out
                else [pa.array([], f.type) for f in schema], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    ddl = (f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, common_prefix long")
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    assert schema.names == names
    return with_next(docs, key, text).select(key, text, "_range", "_extra").mapInArrow(run, ddl)


def _edited(own: tuple, after: tuple, width: int, k: int) -> tuple:
    key, _, codes, p, print_ = own
    _, _, next_codes, next_p, next_print = after
    swapped = p.n // 2
    kept, taken = p.n - swapped, min(swapped, next_p.n)
    data = np.concatenate([codes[:kept], next_codes[:taken]]).tobytes().decode("utf-32-le", "surrogatepass")
    edited = edited_fingerprint(p, codes, kept, next_p, next_codes, taken, width, k)
    return (key, p.n, hashlib.sha256(data.encode("utf-8", "surrogatepass")).hexdigest(), print_, edited,
            likeness(print_, edited, k), likeness(print_, next_print, k), p.extension(0, 0, next_p))
