"""Whole-text encoding with a public tokenizer file, with a cache of words where that gives the same ids.

The word BPE's pre-tokenizer cuts a text into words that are encoded one by one. For texts made only of plain
Latin characters, where its normalisation is lower-casing alone, texts are split at white space here and each
distinct word is encoded by the library's model once. Any other text goes to the library whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Characters outside this set send a text to the library: beyond them normalisation or character classes may differ.
OTHER = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\xa9\\xab\\xac\\xae-\\xb1\\xb4-\\xb8\\xbb\\xbf-\\u012f\\u0131-\\u024f]")
#: The pre-tokenizer's pattern, for those characters. Fixed by the tokenizer file.
_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Strings and words of strings in one generation of the cache at about most.
CACHE_WORDS = 400_000


def _byte_characters() -> dict[int, str]:
    """How the byte-level step writes bytes as characters: printable Latin-1 ones as themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(0x100 + k) for k, b in enumerate(sorted(set(range(256)) - set(own)))}


BYTE_CHARACTERS = _byte_characters()


class _Known(dict):
    """Ids of strings without white space and of words; a string that is missing is cut into words.

    They are held once, in two generations: what the older one has moves on when it is asked for, the rest ages out.
    """

    def __init__(self, tokenize):
        super().__init__()
        self._older: dict[str, bytes] = {}
        self._tokenize = tokenize

    def age(self, most: int) -> None:
        if len(self) > most:
            self._older.clear()  # before the younger one is copied
            self._older = dict(self)
            self.clear()

    def _word(self, w: str) -> bytes:
        mapped = w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        ids = self[w] = array("I", [t.id for t in self._tokenize(mapped)]).tobytes()
        return ids

    def __missing__(self, x: str) -> bytes:
        older = self._older
        out = older.get(x)
        if out is not None:
            self[x] = out
            return out
        if x.isalpha():
            return self._word(x)
        if x[:-1].isalpha():  # letters, then one mark or digit: two words whatever they are
            parts = (x[:-1], x[-1])
        else:
            parts = _WORDS.findall(x)
            if parts == [x]:
                return self._word(x)
        out, seen = b"", True
        for w in parts:
            ids = self.get(w)
            if ids is None:
                ids = older.get(w)
                if ids is None:
                    seen, ids = False, self._word(w)
                else:
                    self[w] = ids
            out += ids
        if seen:  # strings of words met for the first time may never come again
            self[x] = out
        return out


_loaded: dict[str, "WordTokenizer"] = {}


def load(path: str, cache_words: int = CACHE_WORDS) -> "WordTokenizer":
    """The tokenizer of a file; a Python worker loads it once, with the largest cache that was asked for."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path, cache_words)
    _loaded[path]._most = max(_loaded[path]._most, cache_words)
    return _loaded[path]


def release() -> None:
    """Lets go of the tokenizers that an earlier stage left in this Python worker; stages without one begin with it."""
    if _loaded:
        _loaded.clear()
        with contextlib.suppress(OSError, AttributeError):  # glibc alone keeps freed memory and has this call
            ctypes.CDLL(None).malloc_trim(0)


class WordTokenizer:
    """Encodes texts to little-endian uint32 ids, special tokens not added."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.ids = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        end = spec["model"].get("end_of_word_suffix")
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self._by_word = bool(end) and steps[0].get("pattern", {}).get("Regex") == _PATTERN
        added = [t["content"] for t in spec["added_tokens"]]
        self._special = re.compile("|".join(map(re.escape, added))) if added else None
        self._cache = _Known(self._library.model.tokenize)
        self._most = cache_words

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        texts = list(texts)
        plain = [self._by_word and not OTHER.search(t) and not (self._special and self._special.search(t)) for t in texts]
        cut = [t.lower().split() if p else None for t, p in zip(texts, plain)]
        self._cache.age(self._most)
        known = self._cache.__getitem__
        return [b"".join(map(known, found)) if found is not None else np.array(self._library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, found in zip(texts, cut)]


def batches(texts: Iterable[str | None], most_chars: int = 500_000) -> Iterator[list[str]]:
    """Texts in runs of about so many characters at most; a longer text makes a run of its own. None counts as empty."""
    run, size = [], 0
    for t in texts:
        t = t or ""
        if run and size + len(t) > most_chars:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run
