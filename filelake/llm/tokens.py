"""Whole texts to token ids with the tokenizers library, piece by piece.

The library takes out the tokenizer's added tokens first and treats what lies between them as
texts of their own, so texts are split there before anything else. A byte-level BPE with the
usual pre-tokenizer cuts a text before it merges anything, and a blank after a character that
is not white space always starts a cut. Parts are split there, and pieces met before are taken
from a bounded cache; only new pieces reach the library.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import threading
import time
from array import array
from collections.abc import Sequence
from functools import cache

import numpy as np

_BLANK = re.compile(r" (?<=\S )")
# Letters and signs of which all cuts are known; other texts are split at blanks alone.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[{_L}\x20-\x26\x28-\x7e\n]+")
_DOUBLE = re.compile(r"\s\s")
_PART = re.compile(rf" ?[{_L}]+|(?:(?! [{_L}])[^{_L}])+")


def _pieces(text: str) -> list[str]:
    """Parts of a text that the library cuts in the same way alone as in place."""
    if _PLAIN.fullmatch(text) and not _DOUBLE.search(text):
        return _PART.findall(text)
    first, *rest = _BLANK.split(text)
    return [first, *(" " + p for p in rest)] if first else [" " + p for p in rest]


# After this time without a text an encoder's pieces are forgotten.
IDLE_SECONDS = 5.0


def _trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class PieceEncoder:
    """Ids of whole texts; ``cache_pieces`` bounds what is remembered between calls."""

    def __init__(self, path: str, cache_pieces: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = self._tokenizer.get_added_tokens_decoder().values()
        # The longest of those that start at one place, as in the library.
        names = sorted((t.content for t in added), key=len, reverse=True)
        self._added = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None
        # Texts with tokens that depend on what is beside them go to the library whole.
        self._whole = any(t.single_word or t.lstrip or t.rstrip for t in added)
        self._limit = cache_pieces
        self._lock, self._used, self._watch = threading.Lock(), 0.0, None
        self._known: dict[str, bytes] = {}
        # What was known before the cache was last full; pieces in use move back.
        self._before: dict[str, bytes] = {}
        self.vocabulary = self._tokenizer.get_vocab_size()

    def _split(self, text: str) -> list[str]:
        if self._added is None or not self._added.search(text):
            return _pieces(text)
        if self._whole:
            return [text]
        out: list[str] = []
        for k, part in enumerate(self._added.split(text)):
            out += [part] if k % 2 else _pieces(part)
        return out

    def _library(self, pieces: Sequence[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(list(pieces), add_special_tokens=False)
        if sys.byteorder == "big":
            return [np.array(e.ids, "<u4").tobytes() for e in found]
        return [array("I", e.ids).tobytes() for e in found]

    def _learn(self, new: set[str]) -> None:
        """Make the ids of pieces known that are not."""
        if len(self._known) + len(new) > self._limit:
            self._known, self._before = {}, self._known
        old = self._before
        self._known.update((p, old[p]) for p in new if p in old)
        rest = [p for p in new if p not in self._known]
        self._known.update(zip(rest, self._library(rest)))

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids as little-endian unsigned 32-bit numbers; NULL is empty."""
        # Millions of small objects and no cycles: the collector would only walk the caches.
        collecting = gc.isenabled()
        gc.disable()
        try:
            with self._lock:
                return self._encode(texts)
        finally:
            if collecting:
                gc.enable()
            self._used = time.monotonic()
            if self._watch is None:
                self._watch = threading.Thread(target=self._let_go, daemon=True)
                self._watch.start()

    def _let_go(self) -> None:
        """Forget all pieces once the encoder has rested: a worker lives on into stages that need the memory."""
        while True:
            time.sleep(IDLE_SECONDS)
            with self._lock:
                if time.monotonic() - self._used >= IDLE_SECONDS:
                    self._known, self._before, self._watch = {}, {}, None
                    _trim()
                    return

    def _encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        split = [self._split(t or "") for t in texts]
        # One look at each piece; those that were not known are filled in.
        found: list[list[bytes | None]] = [list(map(self._known.get, s)) for s in split]
        holes = [(s, f, [i for i, ids in enumerate(f) if ids is None]) for s, f in zip(split, found) if None in f]
        self._learn({s[i] for s, _, at in holes for i in at})
        get = self._known.__getitem__
        for s, f, at in holes:
            for i in at:
                f[i] = get(s[i])
        return [np.frombuffer(b"".join(f), "<u4") for f in found]


@cache
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process."""
    return PieceEncoder(path)
