"""Independent chunks of a text under a pre-tokenizer, with a bounded memo."""

from __future__ import annotations

import re
from collections.abc import Callable

_BLANKS = re.compile(r"\s\s")
_SAFE_GAP = re.compile(r"(?<=\S) (?=\S)")
#: Blanks on which Python and the tokenizer libraries may differ.
_ODD = re.compile("[^\\S \\t\\n\\r]")


def single_spaced(text: str) -> bool:
    """Whether every space stands between two characters that are not blank."""
    return text[0] != " " and text[-1] != " " and not _BLANKS.search(text)


def space_chunks(text: str) -> list[str]:
    """The text cut before single spaces that stand between other characters.

    A byte-level pre-tokenizer always starts a piece at such a space, so the
    chunks' tokens are the text's. Joining the chunks gives the text back.
    """
    if not text:
        return []
    if _ODD.search(text):
        return [text]
    if not single_spaced(text):
        parts, start = [], 0
        for gap in _SAFE_GAP.finditer(text):
            parts.append(text[start:gap.start()])
            start = gap.start()
        parts.append(text[start:])
        return parts
    head, *rest = text.split(" ")
    return [head, *[" " + x for x in rest]]


#: Characters whose letter, digit, case and composition properties are the same
#: in every Unicode version that the libraries may use.
PLAIN = re.compile("[\x20-\x7e\xa1\xa7\xab\xbb\xbf\xc0-\xd6\xd8-\xf6\xf8-\u0107\u2013\u2014\u2018-\u201d\u2026\u20ac\n\t]*")


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for the code points from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


_ALPHABET = byte_alphabet()


def byte_level(piece: str) -> str:
    """A pre-token in the byte-level alphabet."""
    if piece.isascii() and piece.isalnum():
        return piece
    return piece.encode().decode("latin-1").translate(_ALPHABET)


class Memo:
    """Values of chunks, computed for unseen ones together.

    Holds two generations of at most ``entries`` values: chunks that recur
    move to the younger one, the others go with the elder.
    """

    def __init__(self, compute: Callable[[list[str]], list], entries: int = 400_000):
        self.compute, self.entries, self.known, self.old = compute, entries, {}, {}

    def values(self, chunks: list[str]) -> list:
        known = self.known
        try:
            return list(map(known.__getitem__, chunks))
        except KeyError:
            pass
        if len(known) > self.entries:
            self.old, self.known = known, (known := {})
        new = []
        for x in dict.fromkeys(chunks):
            if x not in known:
                if x in self.old:
                    known[x] = self.old[x]
                else:
                    new.append(x)
        if new:
            known.update(zip(new, self.compute(new)))
        return list(map(known.__getitem__, chunks))
