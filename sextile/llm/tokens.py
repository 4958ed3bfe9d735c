"""Token ids of whole texts by a public BPE tokenizer, with the ids of frequent words remembered."""

from __future__ import annotations

import sys
import unicodedata
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

# Entries of a table of some 150 bytes each. A full table becomes the older of two; what is met again
# moves to the newer, so frequent words stay and the others go.
REMEMBERED = 100_000

# Texts of these characters alone are split here. All are letters, digits or symbols to both this
# module and the tokenizer, and no normalisation changes more than their case.
_PLAIN = regex.compile("[\t\n\r\x20-\x7e¡-įı-ſ‐-‧‰-⁞€]*")
# Fixed value: the tokenizer's own pattern of a word.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


_SWAPPED = sys.byteorder != "little" or array("I").itemsize != 4


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _words_of(part: str) -> list[str]:
    """The words of a text without white space; most are letters, perhaps with a mark behind them."""
    if part.isalpha():
        return [part]
    if part[:-1].isalpha() and not part[-1].isalnum():
        return [part[:-1], part[-1]]
    return _WORD.findall(part)


class WordTokens:
    """Ids of texts as unsigned little-endian 32-bit bytes, the same as the tokenizer's own."""

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        self._letters = _byte_letters()
        # Ids of words and of whole parts of a text that white space surrounds.
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if "<|" in text or not _PLAIN.fullmatch(text):
            # Special tokens and rare characters are left to the tokenizer as a whole.
            whole = self._tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(whole, "<u4").tobytes()
        out = []
        for part in unicodedata.normalize("NFC", text).lower().split():
            out.append(self._known.get(part) or self._part(part))
        return b"".join(out)

    def _part(self, part: str) -> bytes:
        """Ids of a text without white space; the words of a text never go across white space."""
        ids = self._older.get(part)
        if ids is None:
            words = _words_of(part)
            if len(words) == 1:
                ids = self._word(part)
            else:
                ids = b"".join([self._known.get(w) or self._part(w) for w in words])
        if len(self._known) >= REMEMBERED:
            self._older, self._known = self._known, {}
        if len(part) <= 40:
            self._known[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        letters = "".join([self._letters[b] for b in word.encode()])
        ids = array("I", [t.id for t in self._tokenizer.model.tokenize(letters)])
        return np.asarray(ids, "<u4").tobytes() if _SWAPPED else ids.tobytes()
