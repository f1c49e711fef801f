"""Vectorised word scan of many texts at once: word borders, hashes and window hashes with numpy.

Texts are joined with a newline, so that no word crosses a text. A word's hash comes from prefix sums of
``value(byte) * P**position`` modulo 2**64, so any range of bytes is hashed by one subtraction and one product.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

P = 0x9E3779B97F4A7C15
P_INVERSE = pow(P, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
VALUE = np.arange(256, dtype=np.uint64)
VALUE = (VALUE + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) ^ ((VALUE + np.uint64(7)) << np.uint64(37))
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
        if n > 1 << 24:  # one huge text: don't keep its table
            _powers.pop(base)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads all bits of a 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Scan:
    """Borders and hashes of the words and lines of ``texts`` (UTF-8), each computed when first asked for."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.ends_of_text = np.cumsum(self.sizes + 1) - 1

    def per_text(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends_of_text, position)

    @cached_property
    def borders(self) -> tuple[np.ndarray, np.ndarray]:
        space = SPACE[self.buf]
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        if self.n and len(space) and not space[0]:
            change = np.concatenate([[0], change])
        return change[0::2], change[1::2]

    @cached_property
    def text_of_word(self) -> np.ndarray:
        return self.per_text(self.borders[0])

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.text_of_word, minlength=self.n)

    def count_bytes(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are set in ``mask``."""
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[self.ends_of_text] - total[self.ends_of_text - self.sizes]

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.count_bytes(((self.buf & 0xC0) != 0x80) & ~SPACE[self.buf])

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count_bytes(SYMBOL[self.buf])

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(VALUE[buf] * powers(P, len(buf)), out=out[1:])
        return out

    @cached_property
    def _prefix(self) -> np.ndarray:
        return self.prefix(self.buf)

    def hashes(self, start: np.ndarray, end: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        prefix = self._prefix if prefix is None else prefix
        return mix((prefix[end] - prefix[start]) * powers(P_INVERSE, len(prefix))[start] + (end - start).astype(np.uint64))

    @cached_property
    def word_hash(self) -> np.ndarray:
        return self.hashes(*self.borders)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of the same text."""
        end = np.flatnonzero(self.buf == 10)
        start = np.concatenate([[0], end[:-1] + 1])
        first = np.searchsorted(self.borders[0], start)
        held = np.searchsorted(self.borders[0], end) > first
        start, end = start[held], end[held]
        text = self.per_text(start)
        key = mix(self.hashes(start, end) + mix(text.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        again = key[order][1:] == key[order][:-1]
        return np.bincount(text[order][1:][again], minlength=self.n)

    def window_hash(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of ``width`` words within one text; the text is part of the hash."""
        h, text = self.word_hash, self.text_of_word
        n = len(h) - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        key = mix(text[:n].astype(np.uint64))
        for k in range(width):
            key = mix(key * np.uint64(P) + h[k : k + n])
        at = np.flatnonzero(text[:n] == text[width - 1 :])
        return at, key[at]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words inside a 5-word window that occurs twice or more in its text, first occurrence included."""
        at, key = self.window_hash(5)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        edge = np.zeros(len(self.word_hash) + 1, np.int32)
        np.add.at(edge, at[again], 1)
        np.add.at(edge, at[again] + 5, -1)
        covered = np.cumsum(edge)[:-1] > 0
        return np.bincount(self.text_of_word[covered], minlength=self.n)
