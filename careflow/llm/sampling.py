"""Sampled subword segmentations by forward filtering and backward sampling.

Every piece of the vocabulary that fits is an edge of a text's lattice. The
forward pass sums the weights of all paths to each place; the backward pass
draws, from the end on, each edge in proportion to the weight of all paths
through it, so whole segmentations are drawn with their exact probability. The
random numbers are a hash of the row's key and the place in its text:
segmentations are the same in every run and however the rows are dealt.

The vocabulary is a merge model without probabilities; a piece weighs the
inverse of its merge rank, to the power of ``alpha``. Characters that are no
piece are spelled as bytes, the space sign inside a text too, so that decoding
gives every text back.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from careflow.llm.common import mix64, slices, tokenizer_path

FILE = "piece_bpe_32k.model"
ALPHA = 0.5
SPACE = "▁"
_SPELLED = 1 << 24
_COMMON = 0x250
_SIGN = "\ufdd0"
_BLOCK = 1_000_000


class Lattice:
    """Pieces, weights and unit lattices of one model, for one Python worker."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
                                              or model.is_unused(i))]
        weight = -alpha * np.log(np.arange(2, len(plain) + 2))
        weight -= np.log(np.exp(weight).sum())
        self.spelled = float(weight.min())  # for each byte
        # a trie of the pieces: the step from a node by a character is a sorted key
        steps, self.ends = {}, [(-1, 0.0)]
        for i, w in zip(plain, weight.tolist()):
            node = 0
            for c in self.pieces[i]:
                step = (node << 21) | ord(c)
                if step not in steps:
                    steps[step] = len(self.ends)
                    self.ends.append((-1, 0.0))
                node = steps[step]
            self.ends[node] = (i, w)
        self.steps = np.array(sorted(steps), np.int64)
        self.child = np.array([steps[k] for k in self.steps.tolist()])
        self.piece, self.weight = (np.array(x) for x in zip(*self.ends))
        # the pairs of characters that some piece holds side by side
        self.beside = np.zeros((_COMMON + 1, _COMMON + 1), bool)
        self.beside[_COMMON] = self.beside[:, _COMMON] = True
        for p in (self.pieces[i] for i in plain):
            for x, y in zip(p, p[1:]):
                self.beside[self.common(ord(x)), self.common(ord(y))] = True
        self.raw = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])

    @staticmethod
    def common(code: int) -> int:
        """Row of a character in the table of pairs; all rare ones share the last."""
        return code if code < _COMMON - 1 else _COMMON - 1 if code == ord(SPACE) else _COMMON

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """Whether no piece reaches over each place between two characters."""
        rows = np.where(codes < _COMMON - 1, codes, np.where(codes == ord(SPACE), _COMMON - 1, _COMMON))
        return ~self.beside[rows[:-1], rows[1:]]

    def edges(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, length, code, log-weight) of every piece in texts laid end to end,
        with so many characters from each place to its text's end."""
        out, at, node = [], np.arange(len(codes)), np.zeros(len(codes), np.int64)
        single = np.zeros(len(codes), bool)
        length = 0
        while len(at):
            step = (node << 21) | codes[at + length]
            found = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            hit = self.steps[found] == step
            at, node, length = at[hit], self.child[found[hit]], length + 1
            ends = self.piece[node] >= 0
            out.append((at[ends], np.full(ends.sum(), length), self.piece[node[ends]], self.weight[node[ends]]))
            if length == 1:
                single[at[ends]] = True
            more = room[at] > length
            at, node = at[more], node[more]
        lost = np.flatnonzero(~single)
        c = codes[lost]
        size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        out.append((lost, np.ones(len(lost), np.int64), _SPELLED + c, self.spelled * size))
        return tuple(np.concatenate(x) for x in zip(*out))

    def spell(self, code: int) -> list[int]:
        return [self.byte_id[b] for b in chr(code - _SPELLED).encode("utf-8", "surrogatepass")]

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Drawn ids of each text."""
        # the space sign itself is spelled as bytes, under a name that is no piece
        texts = [SPACE + t.replace(SPACE, _SIGN).replace(" ", SPACE) if t else "" for t in texts]
        whole, ends = "".join(texts), np.cumsum([0, *map(len, texts)])
        if not whole:
            return [np.zeros(0, "<u4") for _ in texts]
        cut = np.ones(len(whole) + 1, bool)
        cut[1:-1] = self.cuts(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32))
        cut[ends] = True
        cut = np.flatnonzero(cut)
        units = [whole[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        row = np.searchsorted(ends, cut[:-1], "right") - 1
        place = cut[:-1] - ends[row]
        kinds = list(dict.fromkeys(units))
        length = np.fromiter(map(len, kinds), np.int64, len(kinds))
        codes = np.frombuffer("".join(kinds).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(length)
        own = np.repeat(np.arange(len(kinds)), length)
        start, size, code, weight = self.edges(codes, ends[own] - np.arange(len(codes)))
        # node numbers: each unit's places from 0 to its length, in a row
        base = ends - length + np.arange(len(kinds))
        goes, into = start + own[start], start + own[start] + size
        # forward: places in the order of their distance from the unit's start
        depth = into - base[own[start]]
        order = np.lexsort((into, depth))
        goes, into, code, weight, depth = goes[order], into[order], code[order], weight[order], depth[order]
        paths = np.zeros(len(codes) + len(kinds))
        for a, b in pairwise(np.searchsorted(depth, np.arange(1, depth[-1] + 2)).tolist()):
            x = paths[goes[a:b]] + weight[a:b]
            first = np.flatnonzero(np.concatenate([[True], np.diff(into[a:b]) != 0]))
            top = np.maximum.reduceat(x, first)
            many = np.diff(np.concatenate([first, [b - a]]))
            paths[into[a + first]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, many)), first))
        order = np.argsort(into, kind="stable")
        goes, into, codes = goes[order], into[order], code[order]
        share = np.exp(paths[goes] + weight[order] - paths[into])
        first = np.flatnonzero(np.concatenate([[True], np.diff(into) != 0]))
        many = np.diff(np.concatenate([first, [len(into)]]))
        total = np.cumsum(share)
        ladder = into + np.minimum(total - np.repeat(total[first] - share[first], many), 1.0)
        index = dict(zip(kinds, range(len(kinds))))
        kind = np.fromiter(map(index.__getitem__, units), np.int64, len(units))
        # every place but a unit's first is reached by some edge: its last one, and whether it is the only one
        last, only = np.zeros(len(paths), np.int64), np.ones(len(paths), bool)
        last[into[first]], only[into[first]] = first + many - 1, many == 1
        floor = base[kind]
        seed, now = seeds[row], floor + length[kind]
        live, drawn, order = np.arange(len(units)), [], []
        while len(live):
            at = now[live]
            edge = last[at]
            drawing = np.flatnonzero(~only[at])
            one, to = live[drawing], at[drawing]
            u = mix64(seed[one] ^ mix64((place[one] + to - floor[one]).astype(np.uint64)))
            found = np.searchsorted(ladder, to + (u >> np.uint64(12)).astype(np.float64) / 2.0 ** 52, "right")
            edge[drawing] = np.minimum(found, edge[drawing])
            drawn.append(codes[edge]), order.append(live)
            now[live] = goes[edge]
            live = live[now[live] > floor[live]]
        code, unit = np.concatenate(drawn)[::-1], np.concatenate(order)[::-1]
        order = np.argsort(unit, kind="stable")
        code, unit = code[order], unit[order]
        ends = np.searchsorted(row[unit], np.arange(len(texts) + 1))
        code, ends = self._spelled(code, ends)
        return [code[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _spelled(self, code: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes with spelled characters as the ids of their bytes, and where the texts end in them."""
        at = np.flatnonzero(code >= _SPELLED)
        kinds, kind = np.unique(code[at], return_inverse=True)
        named = [self.spell(c if c != _SPELLED + ord(_SIGN) else _SPELLED + ord(SPACE)) for c in kinds.tolist()]
        size = np.ones(len(code), np.int64)
        size[at] = np.array([len(ids) for ids in named], np.int64)[kind]
        start = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(code, size).astype("<u4")
        for k in range(max(map(len, named), default=0)):
            has = np.flatnonzero(size[at] > k)
            out[start[at[has]] + k] = np.array([ids[k] if k < len(ids) else 0 for ids in named], "<u4")[kind[has]]
        return out, start[ends]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces with space signs as spaces, bytes put together."""
        return b"".join(map(self.raw.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def lattice(path: str, alpha: float) -> Lattice:
    return Lattice(path, alpha)


def seed_of(key: object, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{key!r}".encode(), digest_size=8).digest(), "little")


def sample_pieces(docs: DataFrame, path: str | None = None, alpha: float = ALPHA, seed: int = 0,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) with a drawn segmentation of every whole text.

    Rows with one key and text get one segmentation. A null or empty text has
    no ids; a null key is a seed like any other. Other columns are not read;
    an empty table stays empty.
    """
    return _mapped(docs, path, alpha, seed, key, text, "ids array<int>",
                   lambda tok, ids: [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["ids"])


def decode_pieces(pieces: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the texts of id arrays (null: null)."""
    path = path or tokenizer_path(FILE)
    kind = pieces.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = lattice(path, ALPHA).decode
        for batch in batches:
            out = [decode(np.array(x, np.int64)) if x is not None else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return pieces.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def sample_digest(docs: DataFrame, path: str | None = None, alpha: float = ALPHA, seed: int = 0,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_pieces, ids_crc32, decoded_sha256) of the drawn segmentations, decoded again."""
    def columns(tok: Lattice, ids: list[np.ndarray]) -> list:
        return [pa.array([len(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(tok.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids])]

    return _mapped(docs, path, alpha, seed, key, text, "n_pieces long, ids_crc32 long, decoded_sha256 string",
                   columns, ["n_pieces", "ids_crc32", "decoded_sha256"])


def _mapped(docs, path, alpha, seed, key, text, fields, columns, names) -> DataFrame:
    path = path or tokenizer_path(FILE)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = lattice(path, alpha)
        for batch in slices(batches, 1, _BLOCK):
            keys = batch.column(0).to_pylist()
            seeds = np.array([seed_of(k, seed) for k in keys], np.uint64)
            ids = tok.sample([t or "" for t in batch.column(1).to_pylist()], seeds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(tok, ids)], names=[key, *names])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {fields}")
