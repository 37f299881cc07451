"""Spelling variants: words one edit apart, found through Bloom filters.

The vocabulary's words enter Bloom filters sharded by length: a word is one
64-bit block and a few bits in it, so a probe reads one place. Every word then
generates its edits, as hashes that follow from the word's own by a few
operations, and probes the shard of their length. Being near is symmetric, so
deletions find the insertions of the other side, and of two replacements at one
place only the later character is tried. Edits found in a filter are spelled
out and shuffled to an exact join with the vocabulary, which removes those
that are no words.

Filters are broadcast in passes of at most ``PASS_BYTES``, however large the
vocabulary; a pass probes the part of the filters it holds.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careflow.llm.common import cut, mix64, slices, text_bytes

#: The letters of a word after lower-casing A-Z.
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
LEAST_LENGTH, LEAST_COUNT, DOMINANCE = 7, 2, 10
MISSPELT_EVERY = 31

#: Blocks of 64 bits in a slice of a filter, bytes of filters in one broadcast, bits
#: of the filter for a word at least, bits set for a word, probes made at once.
SLICE_BLOCKS = 1 << 17
PASS_BYTES = 32 << 20
KEY_BITS, PROBE_BITS = 16, 5
PROBES = 1 << 15
#: Words of a task that generates edits, and code points of them at once.
TASK_WORDS, GROUP_LETTERS = 50_000, 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 1 << 64)
#: A random value for each of the code points below 256.
_VALUE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED))


def crc_table() -> np.ndarray:
    """The byte table of the reflected polynomial EDB88320 (that of zlib)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = crc_table()


# ---------------------------------------------------------------- vocabulary

def letter_runs(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the longest runs of letters, cut at the rows' starts (n + 1).

    In UTF-8 the letters from C0 to FF are the byte C3 and one more.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _LETTER[raw]
    inside[1:] |= raw[:-1] == 0xC3
    edge = np.zeros(len(raw) + 1, bool)
    edge[rows] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    return (np.flatnonzero(inside & (~before | edge[:-1])),
            np.flatnonzero(inside & (~after | edge[1:])) + 1)


def checksums(low: np.ndarray, start: np.ndarray, stop: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """crc32 of every span's bytes, each going on from its own seed."""
    size = stop - start
    out = np.empty(len(start), np.uint32)
    short = np.flatnonzero(size <= 64)
    short = short[np.argsort(-size[short], kind="stable")]
    state, at, ends = ~seeds[short], start[short], -size[short]
    for j in range(int(-ends[0]) if len(short) else 0):
        n = int(np.searchsorted(ends, -j))  # spans longer than j
        s = state[:n]
        state[:n] = _CRC[(s ^ low[at[:n] + j]) & 0xFF] ^ (s >> np.uint32(8))
    out[short] = ~state
    for i in np.flatnonzero(size > 64).tolist():
        out[i] = zlib.crc32(low[start[i]:stop[i]], int(seeds[i]))
    return out


def word_counts(column: pa.Array, keys: list) -> Counter:
    """Occurrences of a batch's words that are long enough, misspellings applied."""
    raw, rows = text_bytes(column)
    low = _LOWER[raw]
    start, stop = letter_runs(raw, rows)
    two = np.concatenate(([0], np.cumsum(raw == 0xC3, dtype=np.int64)))
    length = stop - start - (two[stop] - two[start])
    long = length >= LEAST_LENGTH
    start, stop, length = start[long], stop[long], length[long]
    row = np.searchsorted(rows, start, "right") - 1
    seeds = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in keys], np.uint32)
    sums = checksums(low, start, stop, seeds[row])
    wrong = sums % np.uint32(MISSPELT_EVERY) == 0
    data = low.tobytes()
    counts = Counter(data[a:b] for a, b in zip(start[~wrong].tolist(), stop[~wrong].tolist()))
    for a, b, n, h in zip(*(x[wrong].tolist() for x in (start, stop, length, sums))):
        if n > LEAST_LENGTH:
            word = data[a:b].decode()
            at = h % n
            counts[(word[:at] + word[at + 1:]).encode()] += 1
    return counts


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the distinct words of whole texts with at least seven code points and two occurrences.

    A word is a longest run of letters (A-Z, a-z, C0 to FF), A-Z lower-cased,
    from which one code point is taken away where the crc32 of its row's key
    and itself says so. A null text has none; a null key counts as an empty one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4_000_000):
            counts = word_counts(batch.column(1), batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())],
                names=["word", "n"])

    return (docs.select(F.col(key), F.col(text)).mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT))


# ---------------------------------------------------------------- hashes and filters

def shard_of(length: np.ndarray) -> np.ndarray:
    """Shard of words of a length: one for each up to 63, then one for each doubling."""
    length = np.asarray(length, np.int64)
    return np.where(length < 64, length, 58 + np.frexp(length.astype(float))[1]).astype(np.int32)


def codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def growing(first: int, n: int) -> np.ndarray:
    """Powers of the base from exponent ``first`` on, modulo 2^64."""
    out = np.full(n, _BASE, np.uint64)
    out[:1] = pow(_BASE, first, 1 << 64)
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def raw_hashes(words: np.ndarray) -> np.ndarray:
    """Polynomial hashes of rows of code points."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(words), np.uint64)
        for a in range(0, words.shape[1], 1024):
            part = words[:, a:a + 1024]
            total += (_VALUE[part] * growing(a, part.shape[1])).sum(axis=1, dtype=np.uint64)
    return total


def places(raw: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bits in it of polynomial hashes, in a shard of so many blocks."""
    h = mix64(raw)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    mask = np.zeros(len(h), np.uint64)
    for j in range(PROBE_BITS):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * j)) & np.uint64(63))
    return block.astype(np.int64), mask


def by_length(words: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    """Words grouped by length, in groups of at most so many code points (one word at least)."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for n, mine in groups.items():
        step = max(limit // max(n, 1), 1)
        for a in range(0, len(mine), step):
            yield mine[a:a + step]


def filter_sizes(words: DataFrame) -> dict[int, int]:
    """Blocks of each shard: sixteen bits for each word, twice its length for long ones.

    Bits grow with the length as the edits do, so a word of any length finds
    few edits that are no words. There are less than a hundred shards.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = f["word"].str.len()
            yield pd.DataFrame({"shard": shard_of(n), "bits": np.maximum(KEY_BITS, 2 * n).astype("int64")})

    sizes = (words.select("word").mapInPandas(run, "shard int, bits long")
             .groupBy("shard").agg(F.sum("bits").alias("bits")).collect())
    return {r["shard"]: max(64, -(-r["bits"] // 64)) for r in sizes}


def build_filters(words: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(shard, slice, bits): the filters, in slices of at most SLICE_BLOCKS blocks as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in by_length(batch.column(0).to_pylist()):
                shard = int(shard_of(len(group[0])))
                block, mask = places(raw_hashes(codes(group)), sizes[shard])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(group), shard, np.int32)), pa.array((block // SLICE_BLOCKS).astype(np.int32)),
                     pa.array((block % SLICE_BLOCKS).astype(np.int32)), pa.array(mask.view(np.int64))],
                    names=["shard", "slice", "block", "mask"])

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        shard, part = int(frame["shard"].iloc[0]), int(frame["slice"].iloc[0])
        bits = np.zeros(min(SLICE_BLOCKS, sizes[shard] - part * SLICE_BLOCKS), np.uint64)
        bits[frame["block"]] = frame["mask"].to_numpy().view(np.uint64)
        return pd.DataFrame({"shard": [shard], "slice": [part], "bits": [bits.tobytes()]})

    return (words.select("word").mapInArrow(run, "shard int, slice int, block int, mask long")
            .groupBy("shard", "slice", "block").agg(F.bit_or("mask").alias("mask"))
            .groupBy("shard", "slice").applyInPandas(pack, "shard int, slice int, bits binary"))


def passes(sizes: dict[int, int], limit: int = PASS_BYTES) -> list[list[tuple[int, int, int]]]:
    """Runs of slices (shard, first, last + 1) that are broadcast together, each within ``limit`` bytes."""
    out: list[list[tuple[int, int, int]]] = [[]]
    room = limit
    for shard in sorted(sizes):
        for part in range(-(-sizes[shard] // SLICE_BLOCKS)):
            size = 8 * min(SLICE_BLOCKS, sizes[shard] - part * SLICE_BLOCKS)
            if size > room and out[-1]:
                out.append([])
                room = limit
            room -= size
            if out[-1] and out[-1][-1][0] == shard:
                out[-1][-1] = (shard, out[-1][-1][1], part + 1)
            else:
                out[-1].append((shard, part, part + 1))
    return out


class Filters:
    """The filters of one pass."""

    def __init__(self, sizes: dict[int, int], held: dict[int, tuple[int, np.ndarray]]):
        #: for each shard the first block that is held, and the blocks from there
        self.sizes, self.held = sizes, held

    def hits(self, shard: int, raw: np.ndarray) -> np.ndarray:
        """Which hashes the held part of a shard may contain."""
        if shard not in self.held:
            return np.zeros(0, np.int64)
        first, bits = self.held[shard]
        block, mask = places(raw.ravel(), self.sizes[shard])
        block -= first
        if first or len(bits) < self.sizes[shard]:
            here = np.flatnonzero((block >= 0) & (block < len(bits)))
            block, mask = block[here], mask[here]
            return here[(bits[block] & mask) == mask]
        return np.flatnonzero((bits[block] & mask) == mask)


def probe(words: list[str], filters: Filters) -> Iterator[tuple[str, str]]:
    """(word, edit) for the edits of words of one length that the filters may contain.

    Edits are the deletions, and the replacements by a later letter.
    """
    table = codes(words)
    total, n = raw_hashes(table), len(words)
    here, shorter = int(shard_of(table.shape[1])), int(shard_of(table.shape[1] - 1))
    letters = np.frombuffer(LETTERS.encode("latin-1"), np.uint8)
    begun = np.zeros(n, np.uint64)
    step = max(PROBES // n, 1)
    with np.errstate(over="ignore"):
        for a in range(0, table.shape[1], step):
            part = table[:, a:a + step]
            power = growing(a, part.shape[1])
            own = _VALUE[part] * power
            sums = begun[:, None] + np.cumsum(own, axis=1, dtype=np.uint64)
            # what stands before the place, and what follows moved up by one
            gone = (sums - own) + (total[:, None] - sums) * np.uint64(_BACK)
            for i in filters.hits(shorter, gone).tolist():
                word, at = words[i // part.shape[1]], a + i % part.shape[1]
                if word[at:at + 1] != word[at + 1:at + 2]:  # equal letters side by side: the last stands for all
                    yield word, word[:at] + word[at + 1:]
            rest = total[:, None] - own
            for c, value in zip(letters.tolist(), _VALUE[letters]):
                row, at = np.nonzero(part < c)
                if len(row):
                    for i in filters.hits(here, rest[row, at] + value * power[at]).tolist():
                        word, x = words[row[i]], a + int(at[i])
                        yield word, word[:x] + chr(c) + word[x + 1:]
            begun = sums[:, -1]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): both directions of every pair of words one edit apart.

    ``words`` holds (word, n) with distinct words of the letters above.
    """
    spark = words.sparkSession
    sizes = filter_sizes(words)
    if not sizes:
        return spark.createDataFrame([], "word string, n long, other string, other_n long")
    slices_of = cut(build_filters(words, sizes))
    # the vocabulary is small beside its edits
    dealt = cut(words.select("word", "n").repartition(-(-words.count() // TASK_WORDS), "word"))
    found = []
    for held in passes(sizes):
        wanted = reduce(lambda x, y: x | y, [(F.col("shard") == s) & F.col("slice").between(a, b - 1) for s, a, b in held])
        bits: dict[int, list] = {s: [] for s, _, _ in held}
        for r in slices_of.where(wanted).orderBy("shard", "slice").collect():  # at most PASS_BYTES
            bits[r["shard"]].append((r["slice"], r["bits"]))
        parts = {}
        for s, a, b in held:
            blocks = np.zeros(min(b * SLICE_BLOCKS, sizes[s]) - a * SLICE_BLOCKS, np.uint64)
            for part, data in bits[s]:
                at = (part - a) * SLICE_BLOCKS
                blocks[at:at + len(data) // 8] = np.frombuffer(data, np.uint64)
            parts[s] = (a * SLICE_BLOCKS, blocks)
        filters = spark.sparkContext.broadcast((sizes, parts))

        def run(batches: Iterator[pa.RecordBatch], filters=filters) -> Iterator[pa.RecordBatch]:
            table = Filters(*filters.value)
            for batch in batches:
                count = dict(zip(*(c.to_pylist() for c in batch.columns)))
                for group in by_length(list(count), GROUP_LETTERS):
                    out = list(probe(group, table))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w for w, _ in out], pa.string()), pa.array([count[w] for w, _ in out], pa.int64()),
                         pa.array([e for _, e in out], pa.string())], names=["word", "n", "other"])

        found.append(dealt.mapInArrow(run, "word string, n long, other string"))
    edits = reduce(DataFrame.unionByName, found)
    exact = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = cut(edits.join(exact, "other").select("word", "n", "other", "other_n"))
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"),
                                          F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of every chain of (word, form).

    Every step is to a word several times as frequent, so the number of rounds
    is at most the logarithm of the largest n; only open chains go on.
    """
    ahead = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    ended, todo = [], forms.select("word", F.col("form").alias("root"))
    while True:
        step = cut(todo.join(ahead, "root", "left"))
        ended.append(step.where("next is null").select("word", "root"))
        todo = step.where("next is not null").select("word", F.col("next").alias("root"))
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, ended)


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   dominance: int = DOMINANCE) -> DataFrame:
    """(word, form, root, n, n_near, form_n): spelling variants among the words of all texts.

    ``form`` is the near word of largest n (ties: smallest in code-point
    order) if that is at least ``dominance`` times the word's n, else null;
    ``root`` the end of the chain of forms, the word itself if it has none;
    ``n_near`` the number of near words. Null texts have no words; repeated
    rows count again, as their words occur again; other columns are not read;
    an empty table, or one without such words, gives an empty result.
    """
    words = cut(vocabulary(docs, key, text))
    pairs = near_words(words)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"),
                                     F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    judged = cut(words.join(best, "word", "left")
                 .withColumn("fits", F.coalesce(-F.col("best.m") >= F.lit(dominance) * F.col("n"), F.lit(False)))
                 .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                         F.when(F.col("fits"), F.col("best.other")).alias("form"),
                         F.when(F.col("fits"), -F.col("best.m")).alias("form_n")))
    ends = roots(judged.where("form is not null").select("word", "form"))
    return (judged.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
