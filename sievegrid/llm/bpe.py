"""Token ids of a byte-level BPE tokenizer, by pre-token, with a cache in each worker."""

from __future__ import annotations

import re
import string
import struct
from operator import attrgetter

import regex
from tokenizers import Tokenizer

#: Code points that the splitter here and the library's class differently, or that newer Unicode
#: versions add; a text with one of them is encoded by the library alone. tests/llm/test_bpe.py compares both.
_UNSURE = re.compile("[՘֋֌࢏౜೜₏₝-₟꟎-꭭\U00010000-\U0010ffff]")
#: Fixed value: the published split pattern of byte-level BPE vocabularies of this kind.
_SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

#: Bytes of each of the two caches, what an entry takes besides its key and ids, and characters of the longest key.
CACHE_BYTES, ENTRY_BYTES, CACHE_LONGEST = 100 << 20, 200, 64
_LOADED: dict[str, PreTokens] = {}


def packed(ids: list[int]) -> bytes:
    """Ids as unsigned little-endian 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be printed, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()
_ID = attrgetter("id")


def _shown(text: str) -> str:
    """A text as the vocabulary writes it; ASCII letters are written as themselves."""
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(_LETTERS)


class _Spaces(Exception):
    """Two spaces meet: pre-tokens there depend on both sides."""


class _Cache(dict):
    """Ids by key, emptied where they would take over CACHE_BYTES; keys of over CACHE_LONGEST characters aren't held."""

    held = 0

    def keep(self, key: str, ids: bytes) -> bytes:
        if len(key) <= CACHE_LONGEST:
            self.held += 2 * len(key) + len(ids) + ENTRY_BYTES
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[key] = ids
        return ids


class PreTokens:
    """Splits texts into pre-tokens and encodes each distinct one once.

    Words between single spaces are looked up whole first. Most of those that aren't
    held are letters and then marks: they are split without the pattern, and their
    letters are held once, whatever marks follow. Both caches are bounded in bytes,
    and live on in the worker from task to task.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        model = self.library.model

        def encoded(shown: str) -> bytes:
            return packed([*map(_ID, model.tokenize(shown))])

        class Cache(_Cache):
            def __missing__(self, pre: str) -> bytes:
                return self.keep(pre, encoded(_shown(pre)))

        cache = self.cache = Cache()

        class Words(_Cache):
            """Ids of a word with the space before it, where both ends of the word are no white space.

            No pre-token goes over such a space from the left, so they don't depend on what stands there.
            """

            def __missing__(self, word: str) -> bytes:
                if word.isalpha():
                    return self.keep(word, encoded(_LETTERS[32] + word if word.isascii() else _shown(" " + word)))
                if not word or word[0].isspace() or word[-1].isspace():
                    raise _Spaces
                letters = word.rstrip(string.punctuation)
                if letters.isalpha():
                    known = letters in self  # words that are met once are held once
                    ids = self[letters] + cache[word[len(letters) :]]
                    return self.keep(word, ids) if known else ids
                return self.keep(word, b"".join(map(cache.__getitem__, _SPLIT.findall(" " + word))))

        self.words = Words()

    def plain(self, text: str) -> bool:
        """Whether the splitter here is known to give the library's pre-tokens."""
        return not (_UNSURE.search(text) or any(s in text for s in self.special))

    def split(self, text: str) -> list[str]:
        return _SPLIT.findall(text)

    def whole(self, text: str) -> list[int]:
        """Ids by the library alone."""
        return self.library.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        """Packed ids of a text."""
        if not self.plain(text):
            return packed(self.whole(text))
        first, *words = text.split(" ")
        try:
            if words and first[-1:].isspace():
                raise _Spaces
            return b"".join([*map(self.cache.__getitem__, _SPLIT.findall(first)), *map(self.words.__getitem__, words)])
        except _Spaces:
            return b"".join(map(self.cache.__getitem__, _SPLIT.findall(text)))


def loaded(path: str) -> PreTokens:
    """The tokenizer of this worker process: its cache lives on from task to task."""
    if path not in _LOADED:
        _LOADED[path] = PreTokens(path)
    return _LOADED[path]
