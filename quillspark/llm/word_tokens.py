"""Whole texts to token ids with a tokenizers file whose pre-tokenizer never crosses white space."""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain

from quillspark.llm.common import worker_state

#: Control characters that Python's split() takes for white space and the tokenizer does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Marks that end a pre-token when they follow a letter.
_MARKS = ".,!?;:*#$%&"


class _Recent:
    """A dictionary of bounded size: two generations, the older of which is dropped when the newer is full."""

    def __init__(self, limit: int):
        self.half, self.new, self.old = limit // 2, {}, {}

    def missing(self, keys: set) -> list:
        """Those of keys that must be learnt; the others are in ``new`` from here on."""
        absent = keys.difference(self.new)
        if not absent:
            return []
        if len(self.new) + len(absent) > self.half:
            self.old, self.new = self.new, {}
            absent = keys
        old, new, todo = self.old, self.new, []
        for key in absent:
            value = old.get(key)
            if value is None:
                todo.append(key)
            else:
                new[key] = value
        return todo


class WordEncoder:
    """ids of a text as little-endian unsigned 32-bit bytes.

    White-space-separated chunks are encoded independently, and so are a word and the marks behind it, so
    their ids are kept in dictionaries of bounded size; only unseen words reach the tokenizer, a batch at a
    time. Texts with characters on whose class Python and the tokenizer disagree are encoded whole.
    """

    def __init__(self, path: str, limit: int = 1 << 20, chunks: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        normalizer = self.tokenizer.normalizer
        self.lower = normalizer is not None and normalizer.normalize_str("QÀ q") == "qà q"
        self.chunks, self.words = _Recent(chunks), _Recent(limit)

    @classmethod
    def of(cls, path: str, chunks: int = 1 << 20) -> WordEncoder:
        """One for each Python worker, kept between tasks."""
        return worker_state(("words", path, chunks), lambda: cls(path, chunks=chunks))

    def _raw(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.array([i for e in found for i in e.ids], "<u4").tobytes()
        out, at = [], 0
        for e in found:
            end = at + 4 * len(e)
            out.append(ids[at:end])
            at = end
        return out

    def _folded(self, text: str) -> str:
        """The text in lower case where that can't change its ids: the tokenizer composes letters first."""
        if not self.lower:
            return text
        if text.isascii():
            return text.lower()
        low = text.lower()
        return low if "Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low) else text

    def _learn(self, chunks: list[str]) -> None:
        cores = [c.rstrip(_MARKS) for c in chunks]
        cores = [k if k and k[-1].isalpha() and k[-1] != "İ" else c for k, c in zip(cores, chunks)]
        tails = [c[len(k) :] for k, c in zip(cores, chunks)]
        todo = self.words.missing({*cores, *tails} - {""})
        words = self.words.new
        words.update(zip(todo, self._raw(todo)))
        words[""] = b""
        self.chunks.new.update((c, words[k] + words[t]) for c, k, t in zip(chunks, cores, tails))

    def encode(self, texts: list[str]) -> list[bytes]:
        """A null or empty text has no ids."""
        odd = [bool(t) and _NOT_SPACE.search(t) is not None for t in texts]
        split = [self._folded(t).split() if t and not o else [] for t, o in zip(texts, odd)]
        if missing := self.chunks.missing(set(chain.from_iterable(split))):
            self._learn(missing)
        known = self.chunks.new.__getitem__
        return [self._raw([t])[0] if o else b"".join(map(known, parts)) for t, o, parts in zip(texts, odd, split)]
