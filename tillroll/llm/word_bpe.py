"""Ids of whole texts by the ``tokenizers`` library for vocabularies that
never join characters across a blank, remembering each word's ids.

The vocabulary normalises (NFC, lower case) and then splits by a pattern
whose tokens hold no white space, so the ids of a text are those of its
blank-separated words one after the other. Only words not seen before go to
the library. A plain word (letters up to U+024F, digits, punctuation of one
kind) goes straight to the library's BPE model; every other word, or a word
with a special token's string, goes through the library's whole encoder.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

#: The vocabulary's pattern over lower-case text, for words of plain characters.
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w]|_)+")
#: Letters whose lower case is one letter wherever they stand.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-įĲ-ňŊ-ſ]+")
_LOWERABLE = re.compile(r"[\t\n\r -;=-~À-ÖØ-öø-įĲ-ňŊ-ſ]*")
_PROSE = re.compile(r"[\t\n\r .,a-zß-öø-įĲ-ňŊ-ſ]*")
_DOUBLED = re.compile(r"[.,][.,]")
GENERATION = 150_000  # words remembered in each of two generations; a worker keeps them for its next tasks


def _byte_chars() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others
    for the code points from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in keep}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(keep))
    return out


class WordBpe(dict):
    """word -> its ids as little-endian unsigned 32-bit integers, in bytes.
    Two generations bound the memory: when the young one is full it becomes
    the old one, and words still in use are taken over from there."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.old: dict[str, bytes] = {}
        self.pre: dict[str, bytes] = {}
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = _byte_chars()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._word(word)
        if len(self) >= GENERATION:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if word.isascii() and word.isalpha():
            return array("I", [t.id for t in self.model.tokenize(word.lower())]).tobytes()
        if (len(word) > 200 or not _PLAIN.fullmatch(word) or not unicodedata.is_normalized("NFC", word)
                or ("<" in word and any(s in word for s in self.specials))):
            return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self._pretoken, _PRETOKEN.findall(word.lower())))

    def _pretoken(self, part: str) -> bytes:
        ids = self.pre.get(part)
        if ids is None:
            text = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            ids = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
            if len(self.pre) >= GENERATION:
                self.pre.clear()
            self.pre[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """All ids of a text, 4 bytes each."""
        if _LOWERABLE.fullmatch(text):  # the same ids, and fewer words to remember
            text = text.lower()
            if _PROSE.fullmatch(text) and not _DOUBLED.search(text):  # each mark is a token of its own
                text = text.replace(".", " . ").replace(",", " , ")
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The vocabulary, once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]
