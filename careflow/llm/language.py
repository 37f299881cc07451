"""Language identification as mixture inference.

Each language has a distribution over letter trigrams, learned from labelled
texts. For a document, expectation maximisation estimates the proportions in
which the languages mix from the likelihoods of its trigrams. Which languages
take part is chosen by penalised likelihood: another language joins the set,
in the order of the estimated proportions, as long as the gain in
log-likelihood is worth its penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.llm.common import slices

#: Documented bound of the training sample: so many labelled rows are expected.
TRAIN_ROWS = 20_000
BUCKET_BITS = 15
ROUNDS = 12
UNKNOWN = "und"
_BLOCK = 160_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of a batch's letter trigrams, and whether each row has a letter.

    Texts are lower-cased; whatever is no letter counts as one blank between words.
    """
    texts = ["" if t is None else t.lower() for t in column.to_pylist()]
    codes = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.cumsum([len(t) + 1 for t in texts])
    solid = letters()[codes]
    codes[~solid] = 32
    row = np.searchsorted(ends, np.arange(len(codes)), "left")  # the blank before a text belongs to the last one
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # the first blank after a word
    keep[0] = True
    codes, row = codes[keep], np.minimum(row[keep], max(len(texts) - 1, 0))
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(len(texts), bool)
    c = codes.astype(np.uint64)
    gram = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA6B) + c[2:]
    bucket = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
    inner = codes[1:-1] != 32  # one trigram for each letter, with its neighbours
    cells, n = np.unique((row[1:-1][inner].astype(np.int64) << BUCKET_BITS) | bucket[inner].astype(np.int64),
                         return_counts=True)
    has = np.zeros(len(texts), bool)
    has[cells >> BUCKET_BITS] = True
    return cells >> BUCKET_BITS, cells & ((1 << BUCKET_BITS) - 1), n.astype(np.float64), has


def learn(docs: DataFrame, text: str, lang: str, key: str, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities over trigram buckets.

    Learns from ``rows`` labelled rows, expected, chosen by a hash of the key
    (all if there are no more). What is gathered has a size of languages times
    buckets, whatever the input.
    """
    docs = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang, key)
    total = docs.count()
    if total > rows:
        docs = docs.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * rows / total) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, 0, _BLOCK):
            row, bucket, n, _ = trigrams(batch.column(0))
            names = np.array(batch.column(1).to_pylist(), object)
            for name in set(names):
                mine = names[row] == name
                if name not in sums:
                    sums[name] = np.zeros(1 << BUCKET_BITS)
                np.add.at(sums[name], bucket[mine], n[mine])
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                 pa.array(counts[at].astype(np.int64))], names=["lang", "bucket", "n"])

    counts = (docs.select(text, F.col(lang).cast("string")).mapInArrow(run, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    names = sorted(set(counts["lang"]))
    table = np.full((len(names), 1 << BUCKET_BITS), 0.5)
    np.add.at(table, (counts["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(int),
                      counts["bucket"].to_numpy(int)), counts["n"].to_numpy(float))
    return names, np.log(table / table.sum(axis=1, keepdims=True)).T.copy()


def mixtures(row: np.ndarray, n: np.ndarray, logs: np.ndarray, docs: int, rounds: int = ROUNDS,
             penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each language in each document, and the chosen sets.

    ``row`` is sorted; ``logs`` has a log-probability for each trigram and language.
    """
    size = logs.shape[1]
    first = np.flatnonzero(np.concatenate([[True], np.diff(row) != 0]))
    ids = row[first]
    place = np.repeat(np.arange(len(ids)), np.diff(np.concatenate([first, [len(row)]])))
    total = np.add.reduceat(n, first)
    top = logs.max(axis=1)
    odds = np.exp(logs - top[:, None])
    floor = np.add.reduceat(n * top, first)

    def maximise(which: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """EM over the documents ``which``, within the allowed languages of each."""
        some = np.isin(place, which)
        mine, weight, rate = np.searchsorted(which, place[some]), n[some], odds[some]
        at = np.flatnonzero(np.concatenate([[True], np.diff(mine) != 0]))
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            part = rate * share[mine]
            part *= (weight / part.sum(axis=1))[:, None]
            share = np.add.reduceat(part, at) / total[which][:, None]
        return share, np.add.reduceat(weight * np.log((rate * share[mine]).sum(axis=1)), at) + floor[which]

    everyone = np.arange(len(ids))
    single = np.add.reduceat(n[:, None] * logs, first)
    best = single.argmax(axis=1)
    shares = np.zeros((len(ids), size))
    post = np.exp(single - single.max(axis=1, keepdims=True))
    shares[everyone, best] = (post / post.sum(axis=1, keepdims=True))[everyone, best]
    chosen = shares > 0
    if size > 1:
        full, _ = maximise(everyone, np.ones((len(ids), size)))
        order = np.argsort(-full, axis=1, kind="stable")
        level, open_, now = 2, everyone, single[everyone, best]
        while len(open_) and level <= size:
            allowed = np.zeros((len(open_), size))
            np.put_along_axis(allowed, order[open_, :level], 1.0, axis=1)
            share, value = maximise(open_, allowed)
            better = value - now > penalty * np.log(total[open_] + 1)
            open_, now, share = open_[better], value[better], share[better]
            shares[open_], chosen[open_] = share, allowed[better] > 0
            level += 1
    out, sets = np.zeros((docs, size)), np.zeros((docs, size), bool)
    out[ids], sets[ids] = shares, chosen
    return out, sets


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text",
             carry: list[str] | None = None) -> DataFrame:
    """(key, *carry, lang_pred, score, languages) of every row, from its text alone.

    lang_pred is the language of the largest proportion, ``und`` for a null
    text or one without a letter (score 0) and when nothing was learned. score
    is its proportion; when it is the only one, its posterior against the
    other single languages. languages maps the chosen set to its proportions.
    Null and repeated keys are carried through; an empty table stays empty.
    """
    names, logs = model
    known = docs.sparkSession.sparkContext.broadcast((names, logs))
    carry = carry or []
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in [key, *carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = known.value
        at = 1 + len(carry)
        for batch in slices(batches, at, _BLOCK):
            row, bucket, n, has = trigrams(batch.column(at))
            d = batch.num_rows
            if len(names) and len(row):
                share, sets = mixtures(row, n, logs[bucket], d)
            else:
                share, sets = np.zeros((d, max(len(names), 1))), np.zeros((d, max(len(names), 1)), bool)
                has[:] = False
            best = share.argmax(axis=1)
            lang = [names[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
            score = np.clip(np.where(has, share[np.arange(d), best], 0.0), 0.0, 1.0)
            mix = [[(names[j], float(share[i, j])) for j in np.flatnonzero(sets[i])] for i in range(d)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(lang, pa.string()), pa.array(score),
                 pa.array(mix, pa.map_(pa.string(), pa.float64()))],
                names=[key, *carry, "lang_pred", "score", "languages"])

    return docs.select(key, *carry, text).mapInArrow(
        run, fields + "lang_pred string, score double, languages map<string,double>")


def fold(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 3."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3


def predict(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score, languages): learns from the rows whose fold is not 1.

    held_out is null for a null key, whose row is not learned from either.
    """
    model = learn(docs.where(fold(key) != 1), text, lang, key)
    return (identify(docs, model, key, text)
            .select(key, (fold(key) == 1).alias("held_out"), "lang_pred", "score", "languages"))
