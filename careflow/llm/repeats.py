"""Repeated byte strings across a corpus, by positions sampled by content.

A byte goes if a string of ``length`` bytes that covers it also starts
anywhere else. The positions that are compared are a sample fixed by content:
every possible start owns the position of the least hash among the windows of
its first bytes, so equal strings own equally placed positions and no match is
lost, while about one byte in sixty-five is a position.

Positions are grouped twice, by hashes of the first and of the second half of
the bytes common to all starts that a position can have; those alone in a group
are dropped. Positions left then agree from the position on. Those whose whole
surroundings agree too are settled at once; only around the ends of repeated
passages are single starts compared. This stands in for prefix doubling, whose
sorting of all positions doesn't fit the limits (README).

Bytes are compared by 64-bit hashes of spans, several of which have to agree.

Passages of a number of words are found alike, with the words' hashes in place
of the bytes; white space between words is not compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.llm.common import cut, mix64, slices, text_bytes, tidy
from careflow.llm.shingles import _BLANK, prefix_sums

LENGTH = 400
WINDOW = 128
_GRAM = 16
_WORD_GRAM = 3
_PLACE_BITS = 24
_BLOCK = 1 << 20


def span_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((sums[stop] - sums[start]) * down[start])


def word_places(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows; none crosses rows."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    full = ~_BLANK[raw]
    before = np.concatenate([[False], full[:-1]]) & ~border[:-1]
    after = np.concatenate([full[1:], [False]]) & ~border[1:]
    return np.flatnonzero(full & ~before), np.flatnonzero(full & ~after) + 1


def units(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, or hashes of all its words, and each row's start."""
    raw, offsets = text_bytes(column)
    if not words:
        return raw, offsets
    start, stop = word_places(raw, offsets)
    return span_hash(*prefix_sums(raw), start, stop), np.searchsorted(start, offsets)


def sampled(raw: np.ndarray, ends: np.ndarray, length: int, window: int, gram: int = _GRAM) -> tuple[np.ndarray, ...]:
    """(first start, starts, position) of the positions owned by starts of a block.

    ``ends`` is, for each byte that may be a start, where its row's bytes end.
    """
    sums, down = prefix_sums(raw)
    starts = np.flatnonzero(np.arange(len(ends)) + length <= ends)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none, sums, down
    grams = np.arange(len(raw) - gram + 1)
    value = span_hash(sums, down, grams, grams + gram)
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    value = (value & ~mask) | grams.astype(np.uint64)  # ties go to the left
    width = -(-len(value) // window) * window
    padded = np.full(width, np.iinfo(np.uint64).max)
    padded[:len(value)] = value
    rows = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    own = (np.minimum(behind[starts], ahead[starts + window - 1]) & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(own) != 0)]))
    count = np.diff(np.concatenate([first, [len(starts)]]))
    return starts[first], count, own[first], sums, down


def positions(docs: DataFrame, key: str, text: str, length: int, window: int, words: bool = False) -> DataFrame:
    """One row for each sampled position: key, text_hash, at, shape, p0, p1, around.

    Everything counts bytes, or words. at is its first start in the row's bytes; shape holds its distance from there
    and its number of starts; p0 and p1 name the bytes from it up to the first and
    the second offset, around all bytes of its starts' strings.
    """
    kind = docs.schema[key].dataType.simpleString()
    core = length - window + 1
    half = core // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, _BLOCK):
            raw, offsets = units(batch.column(2), words)
            row_end = np.repeat(offsets[1:], np.diff(offsets))
            for s in range(0, len(raw), _BLOCK):
                e = min(s + _BLOCK, len(raw))
                part = raw[s:min(e + length, len(raw))]
                at, count, own, sums, down = sampled(
                    part, row_end[s:e] - s, length, window, _WORD_GRAM if words else _GRAM)
                if not len(at):
                    continue
                row = np.searchsorted(offsets, at + s, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)),
                     pa.array(at + s - offsets[row]), pa.array(((own - at) << 16 | count).astype(np.int32)),
                     pa.array(span_hash(sums, down, own, own + half).view(np.int64)),
                     pa.array(span_hash(sums, down, own + half, own + core).view(np.int64)),
                     pa.array(span_hash(sums, down, at, at + count - 1 + length).view(np.int64))],
                    names=[key, "text_hash", "at", "shape", "p0", "p1", "around"])

    return docs.select(key, "text_hash", text).mapInArrow(
        run, f"`{key}` {kind}, text_hash long, at long, shape int, p0 long, p1 long, around long")


def doubled(rows: DataFrame, pair: list[str]) -> DataFrame:
    """One round: rows whose pair is not unique, ranked by the sorted pairs."""
    ranked = cut(rows.groupBy(*pair).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
                 .orderBy(*pair).withColumn("_rank", F.monotonically_increasing_id()))
    return cut(rows.join(ranked, pair).drop(*pair).withColumnRenamed("_rank", "rank"))


def _same(key: str) -> Column:
    return F.col(f"d.{key}").eqNullSafe(F.col(f"x.{key}")) & (F.col("d.text_hash") == F.col("x.text_hash"))


def single_starts(docs: DataFrame, wanted: DataFrame, key: str, text: str, length: int,
                  words: bool = False) -> DataFrame:
    """(key, text_hash, at, lone, rank, strings): the string of every start of the wanted positions."""
    kind = docs.schema[key].dataType.simpleString()
    lists = wanted.groupBy(key, "text_hash").agg(
        F.collect_list(F.struct("at", "starts", "lone", "rank")).alias("wanted"))
    joined = docs.alias("d").join(lists.alias("x"), _same(key)).select(f"d.{key}", "d.text_hash", f"d.{text}", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, _BLOCK):
            raw, offsets = units(batch.column(2), words)
            sums, down = prefix_sums(raw)
            lists = batch.column(3)
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            at, n, lone, rank = (lists.flatten().field(i) for i in range(4))
            n = n.to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(n)
            one = np.repeat(np.arange(len(n)), n)
            place = (at.to_numpy(zero_copy_only=False) + offsets[row])[one] + np.arange(len(one)) - (ends - n)[one]
            strings = pa.array(span_hash(sums, down, place, place + length).view(np.int64))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), at, lone, rank,
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), strings)],
                names=[key, "text_hash", "at", "lone", "rank", "strings"])

    return joined.mapInArrow(
        run, f"`{key}` {kind}, text_hash long, at long, lone boolean, rank long, strings array<long>")


def repeated_spans(docs: DataFrame, key: str, text: str, length: int, window: int, words: bool = False) -> DataFrame:
    """(key, text_hash, spans): for each text with repeats, starts and lengths of covered bytes (or words)."""
    rows = doubled(positions(docs, key, text, length, window, words), ["p0"])
    rows = doubled(rows, ["rank", "p1"])
    place = F.struct(key, "text_hash", "at")
    classes = cut(rows.groupBy("rank", "shape", "around").agg(F.count("*").alias("n"), F.min(place).alias("first")))
    starts = F.col("shape").bitwiseAND(F.lit(0xFFFF))
    whole = (rows.join(classes.where("n > 1").select("rank", "shape", "around"), ["rank", "shape", "around"])
             .select(key, "text_hash", F.col("at").alias("start"), (starts + length - 1).alias("bytes")))
    lone = classes.where("n = 1").select("rank").distinct()
    wanted = classes.join(lone, "rank", "left_semi").select(
        "first.*", "rank", starts.alias("starts"), (F.col("n") == 1).alias("lone"))
    singles = cut(single_starts(docs, wanted, key, text, length, words))
    again = (singles.select("rank", F.explode("strings").alias("string"))
             .groupBy("rank", "string").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    lone = singles.where("lone").select(key, "text_hash", "at", "rank", F.posexplode("strings").alias("i", "string"))
    # written by itself, so that the strings' shuffles are released before the other positions'
    found = cut(lone.join(again, ["rank", "string"])
                .select(key, "text_hash", (F.col("at") + F.col("i")).alias("start"), F.lit(length).alias("bytes")))
    whole = whole.unionByName(found)
    return cut(whole.groupBy(key, "text_hash").agg(
        F.collect_list(F.struct("start", F.col("bytes").cast("long").alias("bytes"), F.lit(words).alias("words")))
        .alias("spans")))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                    window: int = WINDOW, keep_text: bool = False, carry: list[str] | None = None,
                    words: int | None = None) -> DataFrame:
    """(key, *carry, n_bytes, n_removed, n_spans, kept_sha256 [, kept]) of every row.

    n_spans counts the maximal runs of removed bytes; kept (only if asked for)
    is the text left, without the bytes of characters cut apart. Repeated rows
    are copies of each other. A null text is empty (kept: null); texts shorter
    than ``length`` lose nothing. Null keys are carried through, other columns
    are not read, an empty table gives an empty result.
    """
    if not 0 < window <= length // 3:
        raise ValueError("the window must be at most a third of the length")
    if words is not None and words < 3 * _WORD_GRAM:
        raise ValueError(f"passages have {3 * _WORD_GRAM} words at least")
    held = [key, *(carry or [])]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in held)
    fields += "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    docs = docs.select(*held, text).withColumn("text_hash", F.xxhash64(text))
    spans = repeated_spans(docs, key, text, length, window)
    if words is not None:
        more = repeated_spans(docs, key, text, words, words // 3, words=True)
        spans = cut(spans.unionByName(more).groupBy(key, "text_hash").agg(
            F.flatten(F.collect_list("spans")).alias("spans")))
    tidy(docs.sparkSession)
    joined = (docs.alias("d").join(spans.alias("x"), _same(key), "left")
              .select(*[f"d.{c}" for c in [*held, text]], "x.spans"))
    names = [*held, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    if keep_text:
        fields, names = fields + ", kept string", [*names, "kept"]
    at = len(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, s in zip(batch.column(at), batch.column(at + 1)):
                data = (t.as_py() or "").encode()
                gone, runs = 0, 0
                if s.is_valid:
                    start, n = (s.values.field(i).to_numpy() for i in range(2))
                    stop = start + n
                    word = s.values.field(2).to_numpy(zero_copy_only=False)
                    if word.any():
                        begin, end = word_places(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                        start, stop = start.copy(), stop.copy()
                        start[word], stop[word] = begin[start[word]], end[stop[word] - 1]
                    step = np.zeros(len(data) + 1, np.int32)
                    np.add.at(step, start, 1)
                    np.add.at(step, stop, -1)
                    covered = np.cumsum(step[:-1]) > 0
                    gone = int(covered.sum())
                    runs = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                    data = np.frombuffer(data, np.uint8)[~covered].tobytes()
                row = [gone + len(data), gone, runs, hashlib.sha256(data).hexdigest()]
                out.append([*row, data.decode(errors="ignore") if t.is_valid else None] if keep_text else row)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:at], *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=names)

    return joined.mapInArrow(run, fields)
