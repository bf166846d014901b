"""Token ids of whole texts by a public byte-level BPE vocabulary of the tokenizers library.

A text is cut before each single space that no other white space follows, which
the vocabulary's own pre-tokenizer always does too; so the pieces can be encoded one by
one, and the ids of a piece that comes again are taken from a bounded cache.
A text with the string of an added token goes to the library as a whole, so the
ids are always those of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

from tokenizers import Tokenizer

#: Pieces whose ids a worker keeps, at most; the cache starts anew beyond. Longer pieces are not kept.
CACHE = 500_000
LONGEST = 40
PIECE = re.compile(r"\s*\S+|\s+")
#: Only around a space with white space (or the end) after it may a piece depend on its neighbours.
RUNS = re.compile(r" (?:\s|\Z)")
#: Signs that the pre-tokenizer keeps together after a word; the apostrophe, which starts contractions, is not one of them.
SIGNS = ".,;:!?#$%&*()|"


#: The letter by which a byte-level vocabulary names each byte: itself if it prints, else one from U+0100 on.
PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
LETTER = {b: b if b in PRINTS else 256 + sum(x not in PRINTS for x in range(b)) for b in range(256)}


class Encoder(dict):
    """Maps a piece, without the space before it, to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.merge = self.tokenizer.model.tokenize
        self.signs = cache(self.ids)

    def ids(self, piece: str) -> bytes:
        """The ids of a piece as it stands."""
        return array("I", [t.id for word, _ in self.split(piece) for t in self.merge(word)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(SIGNS)
        if word.isalpha():  # the pre-tokenizer would cut it just so
            if word != piece:
                ids = self[word] + self.signs(piece[len(word) :])
            else:
                ids = array("I", [t.id for t in self.merge(f" {word}".encode().decode("latin-1").translate(LETTER))]).tobytes()
        else:
            ids = self.ids(" " + piece)
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text."""
        if not text:
            return b""
        if any(x in text for x in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if RUNS.search(text):
            return b"".join([self[x[1:]] if x[0] == " " and x[1:2].strip() else self.ids(x) for x in PIECE.findall(text)])
        first, *rest = text.split(" ")
        return (self.ids(first) if first else b"") + b"".join(map(self.__getitem__, rest))


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
