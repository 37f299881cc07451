"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is run through the merge model alone; those
that come out as one token form the shortcut set (at most as many entries as
the vocabulary has, so it is safe to broadcast). Counting then splits texts
into pre-tokens, counts members of the set as one token each, and runs merges
only for the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from careflow.llm.chunks import PLAIN, Memo, byte_level
from careflow.llm.common import tokenizer, tokenizer_path

FILE = "word_bpe_49k.json"
LIMIT = 2048
#: Fixed pattern of the tokenizer's pre-tokens, for characters of ``PLAIN``.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """Pre-token strings that the merge model leaves as one token, proved one by one."""
    tok = tokenizer(path)
    suffix = tok.model.end_of_word_suffix or ""
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    out = set()
    for entry in tok.get_vocab(with_added_tokens=False):
        if entry in special or not entry.endswith(suffix):
            continue
        word = entry[:len(entry) - len(suffix)] if suffix else entry
        if word and len(tok.model.tokenize(word)) == 1:
            out.add(word)
    return frozenset(out)


class Counter:
    """Counts tokens of texts in one Python worker."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tok, self.whole = tokenizer(path), whole
        self.merge = self.tok.model.tokenize
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.memo = Memo(lambda new: list(map(self.chunk, new)))

    def chunk(self, chunk: str) -> int:
        if any(s in chunk for s in self.special):  # the library cuts these out before normalising
            return len(self.tok.encode(chunk, add_special_tokens=False).ids)
        if PLAIN.fullmatch(chunk):
            pieces = map(byte_level, PIECES.findall(chunk.lower()))
        else:
            tok = self.tok
            pieces = (p for p, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(chunk)))
        whole, merge = self.whole, self.merge
        return sum(1 if p in whole else len(merge(p)) for p in pieces)

    def text(self, text: str) -> int:
        # Python splits at the control characters 1C to 1F, the tokenizer does not
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.chunk(text)
        return sum(self.memo.values(text.split()))


@lru_cache(maxsize=2)
def counter(path: str, whole: frozenset[str]) -> Counter:
    """One counter, with its memo, for all tasks of a Python worker."""
    return Counter(path, whole)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row, whole texts.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated keys are
    carried through, one result row for each input row; other columns are not
    read. An empty table gives an empty result. Special strings inside a text
    count as the library's default has them (one token).
    """
    path = path or tokenizer_path(FILE)
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, whole.value).text
        for batch in batches:
            texts = batch.column(1).fill_null("")
            n = [count(t.as_py()) for t in texts]
            n_tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), n_tokens,
                 pc.greater(n_tokens, limit)],
                names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
