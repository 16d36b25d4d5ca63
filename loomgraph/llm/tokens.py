"""Token ids by a tokenizer file, with the words seen before kept in the worker.

A tokenizer that works word by word gives a text the ids of its words one after another. Texts are cut
before runs of white space, where no token of either kind of file spans, and only words not met before
go to the tokenizers library, many at a time.
"""

from __future__ import annotations

import os
import re

import numpy as np

from loomgraph.llm.worker import hold

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words kept by a worker; beyond it the cache starts anew, which costs time only.
CACHE_WORDS = 800_000
_WORDS_AT_ONCE = 20_000
_KEPT = 64  # characters of a word up to which it stays in the cache
_PIECES = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_SPACES = ("", " ", "\n", "\t", "\r")
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")


class WordEncoder:
    """Encodes texts to little-endian id bytes (``dtype``), without special tokens.

    ``drops_space``: the tokenizer ignores white space (word-level files); otherwise a space belongs to
    the word behind it (byte-level files).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.drops_space = not self._ids(" \n")
        ends = "</w>" if self.drops_space else "\u0120"
        self.marked = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.marked[[i for w, i in self.tokenizer.get_vocab().items() if (w.endswith(ends) if self.drops_space else w.startswith(ends))]] = True
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _words(self, text: str) -> list[str] | None:
        """The text's words, or None where its unusual white space may join them."""
        if self.drops_space:
            return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return None if _OTHER_SPACE.search(text) else _PIECES.findall(text)

    def _learn(self, words: list[str]) -> None:
        """Put the words' ids into the cache.

        Plain words are encoded end to end. Where they end shows in their ids: a word-level token says that
        it ends a word (a mark behind the word makes one more), a byte-level one that a space opens it.
        """
        if self.drops_space:
            kinds = [([w for w in words if w.isalpha()], 1), ([w for w in words if w[-1] in ".," and w[:-1].isalpha()], 2)]
        else:
            kinds = [([w for w in words if w[0] == " " and w[1:2] not in _SPACES], 1)]
        size, between = self.dtype.itemsize, " " if self.drops_space else ""
        for plain, tokens in kinds:
            for k in range(0, len(plain), _WORDS_AT_ONCE):
                some = plain[k : k + _WORDS_AT_ONCE]
                ids = np.array(self.tokenizer.encode_batch_fast([between.join(some)], add_special_tokens=False)[0].ids, self.dtype)
                marks = np.flatnonzero(self.marked[ids])
                if len(marks) == tokens * len(some):  # else they are encoded one by one below
                    cuts = np.concatenate([[0], marks[tokens - 1 :: tokens] + 1] if self.drops_space else [marks, [len(ids)]])
                    cuts, data = (cuts * size).tolist(), ids.tobytes()
                    self.known.update(zip(some, [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        rest = [w for w in words if w not in self.known]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, self.dtype).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text; a null text has none."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        self.known[""] = b""
        parts = [self._words(t) if t else [] for t in texts]
        ids = [None if p is None else list(map(self.known.get, p)) for p in parts]
        lacking = [i for i, x in enumerate(ids) if x is not None and None in x]
        if lacking:
            fresh = sorted({w for i in lacking for w, x in zip(parts[i], ids[i], strict=True) if x is None})
            self._learn(fresh)
            for i in lacking:
                ids[i] = list(map(self.known.__getitem__, parts[i]))
            for w in fresh:
                if len(w) > _KEPT:  # text without spaces would fill the cache with whole passages
                    del self.known[w]
        return [self._ids(t) if x is None else b"".join(x) for t, x in zip(texts, ids, strict=True)]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    return hold(f"tokens {path}", lambda: WordEncoder(path))
