"""Token ids of whole texts by the tokenizers library, with a bounded cache of chunks."""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable, Iterable

import public_tokenizers
from tokenizers import Tokenizer

from exhume.llm.worker import held

#: Entries of a cache's newer half, and letters of the longest piece kept.
CACHED, LONGEST = 250_000, 64
# The vocabulary's pre-tokens (endings behind an apostrophe, letters, single numbers, other marks), for lower-case text up to U+00FF.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: What goes through the whole tokenizer: letters beyond U+00FF, separators that only Python calls white space, and what might be a special token.
_OTHERS = re.compile(r"[^\x00-\x1b\x20-\xff]|<\|")


def vocabulary() -> str:
    """Path of the vocabulary the queries use (49,408 ids; lower case, ends of words marked)."""
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """The byte alphabet of byte-level BPE: printable bytes stand for themselves, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: 256 + i for i, b in enumerate(others)}


def _packed(ids: Iterable[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class _Cache(dict):
    """Values are made on the first look-up. A full half becomes the older one and the older one goes, so memory is bounded and what is in use stays."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """``encode(text)``: ids as little-endian unsigned 32-bit integers, equal to those of the whole text.

    A text of letters up to U+00FF (where normalising is lower case alone) is cut into pre-tokens by one regular expression, and equal
    ones go to the BPE model once. The vocabulary's pre-tokens never reach over a space or a line feed, and no normalisation joins
    what they part; so any other text goes through the whole tokenizer chunk by chunk, equal chunks once.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.parts, self.chunks = _Cache(self._part), _Cache(self._chunk)

    def _part(self, part: str) -> bytes:
        plain = part.isascii() and part.isprintable()
        spelled = part if plain else part.encode().decode("latin-1").translate(self.letters)
        return _packed(t.id for t in self.model.tokenize(spelled))

    def _chunk(self, chunk: str) -> bytes:
        if _OTHERS.search(chunk):
            return _packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        return self._pieces(chunk)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _PIECES.findall(text.lower())))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _OTHERS.search(text):
            return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))
        return self._pieces(text)


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return held(("encoder", path), lambda: Encoder(path))
