"""Best-fit packing of documents into fixed-length token sequences.

Bulk-synchronous best fit. Documents are range-sorted by length, which gives
each a rank within its length class; sequences are ranked likewise within the
class of their free space (gap). One superstep sweeps documents and gaps in
order of size: every gap is matched to the longest unmatched document that
fits (its predecessor in size), and when several gaps want the same class of
documents, their ranks settle it. Matched gaps move to the class of what is
left of them and are ranked anew; the next superstep follows, until no gap
takes a document. Then the longest documents left open new sequences.

Lengths are whole numbers up to the capacity, so what has to be known to all
between two supersteps is only a count for each class: the sweep runs over
these counts (no more than two for each length, whatever the corpus), and the
resulting runs of ranks tell each gap, in whichever task it lies, which
document it takes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.llm.chunks import PLAIN, Memo, single_spaced, space_chunks
from careflow.llm.common import cut, tokenizer, tokenizer_path

FILE = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
CAPACITY = 2048
END_ID = 0
_RANK_BITS = 44


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Texts are cut at single spaces, where pre-tokens begin, and each distinct
    chunk is merged once for each worker (the memo is bounded). ``path`` is a
    byte-level BPE file; ``ranks_path`` may name the same vocabulary as ranks,
    whose library merges unseen chunks several times faster to the same ids.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        self.tok = tokenizer(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.ranks = _ranked(ranks_path) if ranks_path else None
        self.spaced = Memo(lambda new: self.merge([" " + c for c in new]))
        self.chunks = Memo(lambda new: list(map(self.chunk, new)), 50_000)

    def chunk(self, chunk: str) -> bytes:
        return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def merge(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that begin with a space. Those that do not end in a blank are
        encoded as one text, in which each begins a pre-token again, and told apart by
        their bytes."""
        if not self.ranks:
            return list(map(self.chunk, chunks))
        ranked, width = self.ranks
        out = dict.fromkeys(chunks, b"")
        joined = [c for c in chunks if len(c) > 1 and not c[1].isspace() and not c[-1].isspace()]
        got = np.array(ranked.encode_ordinary("".join(joined)), "<u4")
        ends = np.cumsum([len(c.encode()) for c in joined], dtype=np.int64)
        cuts = (4 * np.searchsorted(np.cumsum(width[got]), ends) + 4).tolist()
        data = got.tobytes()
        out.update(zip(joined, [data[a:b] for a, b in zip([0, *cuts], cuts)]))
        return [ids or self.chunk(c) for c, ids in out.items()]

    def text(self, text: str) -> bytes:
        if not text:
            return b""
        if PLAIN.fullmatch(text) and single_spaced(text) and not any(s in text for s in self.special):
            head, *rest = text.split(" ")
            return self.chunks.values([head])[0] + b"".join(self.spaced.values(rest))
        return b"".join(self.chunks.values(space_chunks(text)))


@lru_cache(maxsize=2)
def _ranked(path: str):
    """The ranks' encoder and the bytes of each token."""
    import base64

    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        width[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={}), width


@lru_cache(maxsize=2)
def encoder(path: str, ranks_path: str | None = None) -> Encoder:
    return Encoder(path, ranks_path)


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32): whole texts as token ids, cut to the capacity.

    A null text counts as empty and is the end id alone. Only documents over
    the capacity are cut, into full pieces but for the first.
    """
    ranks = None if path else tokenizer_path(RANKS)
    path = path or tokenizer_path(FILE)
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks).text
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch.column(1).fill_null("")):
                ids = memoryview(encode(t.as_py()) + end)
                n = len(ids) // 4
                edges = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                for p, (a, b) in enumerate(zip(edges, edges[1:])):
                    row.append(i), piece.append(p), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a:4 * b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def sweep(docs: list[list[int]], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """One superstep over class counts: runs (gap, rank, n, length, document rank).

    ``docs[l]`` is [next rank, end] of the documents of length l left, and is
    advanced; ``gaps`` counts the gaps of each size. A run says that n gaps
    from a rank on take n documents from a rank on; length 0 is no match.
    """
    runs, stack, low = [], [], 1
    for g in sorted(gaps):
        stack.extend(x for x in range(low, g + 1) if docs[x][0] < docs[x][1])
        low, a, left = g + 1, 0, gaps[g]
        while left and stack:
            longest = stack[-1]
            n = min(left, docs[longest][1] - docs[longest][0])
            runs.append((g, a, n, longest, docs[longest][0]))
            docs[longest][0] += n
            a, left = a + n, left - n
            if docs[longest][0] == docs[longest][1]:
                stack.pop()
        if left:
            runs.append((g, a, left, 0, 0))
    return runs


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple], list[list[tuple]]]:
    """Seeds and supersteps for so many documents of each length.

    Seeds are (length, first rank, n, first sequence, superstep, gap rank);
    supersteps hold runs (gap, rank, n, length, document rank, new gap rank).
    """
    docs = [[0, counts.get(x, 0)] for x in range(capacity + 1)]
    left = sum(x * n for x, n in counts.items())
    gaps: dict[int, int] = {}
    seeds, steps, sequences = [], [], 0

    def open_from(want: int, least: int) -> int:
        nonlocal sequences
        tokens = 0
        for x in range(capacity, 0, -1):
            n = docs[x][1] - docs[x][0]
            if x < least:
                n = min(n, want)
            if n:
                seeds.append((x, docs[x][0], n, sequences, len(steps), gaps.get(capacity - x, 0)))
                gaps[capacity - x] = gaps.get(capacity - x, 0) + n
                docs[x][0] += n
                sequences, want, tokens = sequences + n, want - n, tokens + n * x
            if want <= 0 and x <= least:
                break
        return tokens

    left -= open_from(0, capacity // 2 + 1)
    while left:
        gaps.pop(0, None)
        before, runs, after = left, [], {}
        for g, a, n, x, rank in sweep(docs, gaps):
            runs.append((g, a, n, x, rank, after.get(g - x, 0)))
            after[g - x] = after.get(g - x, 0) + n
            left -= n * x
        gaps = after
        steps.append(runs)
        if left == before:
            left -= open_from(-(-left // capacity), capacity + 1)
    return seeds, steps


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1 to capacity.

    Every row is packed once, repeated rows and null keys included; ties in
    length go by ``order``. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the range sort samples its input first: read it from written rows
    rows = cut(pieces)
    ranked = cut(rows.repartitionByRange(n_parts, "length", *order).sortWithinPartitions("length", *order)
                 .withColumn("_part", F.spark_partition_id())
                 .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    # one row for each range and length class in it: bounded by ranges plus capacity
    table = (ranked.groupBy("_part", "length").agg(F.min("_at").alias("first"), F.count("*").alias("n"))
             .orderBy("length", "_part").collect())
    counts: dict[int, int] = {}
    starts = []
    for r in table:
        starts.append((r["_part"], r["length"], counts.get(r["length"], 0) - r["first"]))
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    starts = spark.createDataFrame(starts, "_part int, length long, _shift long")
    ranked = (ranked.join(F.broadcast(starts), ["_part", "length"])
              .withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"))
    seeds, steps = plan(counts, capacity)
    known = spark.sparkContext.broadcast((_table(seeds), [_table(s) for s in steps]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_seed, by_gap = known.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in range(2))
            hit, seed = _find(by_seed, length, rank)
            length, rank, seed = length[hit], rank[hit], seed[hit]
            inner = rank - seed[:, 1]
            sequence, opened, gap_rank = seed[:, 3] + inner, seed[:, 4], seed[:, 5] + inner
            gap = capacity - length
            out = [(length, rank, sequence, np.zeros_like(length))]
            for step, runs in enumerate(by_gap):
                live = np.flatnonzero((opened <= step) & (gap > 0))
                if not len(live):
                    continue
                found, row = _find(runs, gap[live], gap_rank[live])
                live, row = live[found], row[found]
                inner, took = gap_rank[live] - row[:, 1], row[:, 3]
                got = took > 0
                out.append((took[got], (row[:, 4] + inner)[got], sequence[live][got], (capacity - gap[live])[got]))
                gap[live] -= took
                gap_rank[live] = row[:, 5] + inner
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)],
                                             names=["length", "_rank", "sequence_id", "offset"])

    placed = ranked.select("length", "_rank").mapInArrow(
        run, "length long, _rank long, sequence_id long, offset long")
    return ranked.join(placed, ["length", "_rank"]).drop("_rank")


def _table(runs: list[tuple]) -> np.ndarray:
    """Runs ordered by (class, first rank)."""
    out = np.array(sorted(runs), np.int64).reshape(len(runs), 6)
    return out


def _find(runs: np.ndarray, cls: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which (class, rank) pairs lie in a run, and the run of each."""
    if not len(runs):
        return np.zeros(len(cls), bool), np.zeros((len(cls), 6), np.int64)
    at = np.searchsorted((runs[:, 0] << _RANK_BITS) + runs[:, 1], (cls << _RANK_BITS) + rank, "right") - 1
    row = runs[np.maximum(at, 0)]
    return (at >= 0) & (row[:, 0] == cls) & (rank < row[:, 1] + row[:, 2]), row


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenises and packs whole documents; one row for each piece.

    Columns: key, piece, start, length, ids_crc32, sequence_id, offset. A null
    text is an empty document (one end id). Repeated and null keys are packed
    like any other row. Other columns are not read.
    """
    pieces = token_pieces(docs, path, capacity, end_id, key, text)
    return pack(pieces, capacity, (key, "piece")).select(
        key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
