"""Character n-gram language models with interpolated modified Kneser-Ney smoothing, in sorted arrays.

A character is a code of 12 bits (code points from 4096 on are folded into the upper half), an n-gram a
63-bit key with the last character lowest. So the first n-1 characters of a key are key >> 12, and what is left
without the first is a mask: both are again keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from typing import NamedTuple

import numpy as np

BITS, SPACE, CODES = 12, 32, 1 << 12


def _fold(cp: np.ndarray) -> np.ndarray:
    return np.where(cp < CODES, cp, CODES // 2 + (cp * 40503 >> 4) % (CODES // 2)).astype(np.uint16)


@cache
def raw_table() -> np.ndarray:
    """Code of each code point: white space and NUL are the space, ASCII digits are 0, all else is itself."""
    table = _fold(np.arange(0x110000))
    table[[i for i in range(0x3001) if chr(i).isspace() or i == 0]] = SPACE
    table[48:58] = 48
    return table


@cache
def letter_table() -> np.ndarray:
    """Code of each code point: letters in lower case, all else is the space."""
    letters = np.full(0x110000, SPACE)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            letters[i] = ord(c.lower()[0])
    return _fold(letters)


def grams(texts: list[str], order: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all n-grams, number of keys of each text); runs of spaces count as one, and a text begins after order-1 zeros."""
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pad = order - 1
    codes = table[np.frombuffer((("\x01" * pad) + ("\x01" * pad).join(texts)).encode("utf-32-le"), np.uint32)]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + pad
    first = np.cumsum(size) - size
    for j in range(pad):
        codes[first + j] = 0
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    size = np.add.reduceat(keep, first, dtype=np.int64) - pad
    codes = codes[keep].astype(np.int64)
    keys = codes[pad:].copy()
    for j in range(1, order):
        keys |= codes[pad - j : len(codes) - j] << BITS * j
    return keys[keys & (CODES - 1) != 0], size


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with how often each occurs (or the sum of its counts)."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts[:0]


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """The three discounts, from how many n-grams occur once, twice, three and four times; 0.5, 0.75, 0.9 where these are too few."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


def discounts_of(counts: np.ndarray) -> tuple[float, float, float]:
    return discounts(*(int((counts == i).sum()) for i in (1, 2, 3, 4)))


class Level(NamedTuple):
    """Log probabilities of the n-grams of one length, and the log of what their contexts leave to shorter ones."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    left: np.ndarray


def lookup(sorted_keys: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value of each key, whether it is there)."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return values[at], sorted_keys[at] == keys


def shorter(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-1-grams that end the n-grams, with the number of different characters before each."""
    return np.unique(keys & ((1 << BITS * (n - 1)) - 1), return_counts=True)


def train(keys: np.ndarray, counts: np.ndarray, order: int, discount: Callable[[int, np.ndarray], tuple[float, float, float]] | None = None, lower: list[Level] | None = None) -> list[Level]:
    """Levels 1 to `order` from the counts of the longest n-grams. Given the `lower` levels, only those above are made: then the
    n-grams may be those of one shard, if it holds all n-grams with its last contexts of the length of the highest of them."""
    discount = discount or (lambda n, c: discounts_of(c))
    levels = list(lower or [])
    tables = {order: (keys, counts)}
    for n in range(order, len(levels) + 1, -1):
        tables[n - 1] = shorter(tables[n][0], n)
    for n in range(len(levels) + 1, order + 1):
        k, c = tables[n]
        context = k >> BITS
        start = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(k))))
        total = np.add.reduceat(c, start).astype(np.float64)
        off = np.array([0.0, *discount(n, c)])[np.minimum(c, 3)]
        left = np.add.reduceat(off, start) / total
        low = np.full(len(k), 1.0 / CODES) if n == 1 else np.exp(logp(levels, k & ((1 << BITS * (n - 1)) - 1)).astype(np.float64))
        p = (c - off) / total[of] + left[of] * low
        levels.append(Level(k, np.log(p).astype(np.float32), context[start], np.log(left).astype(np.float32)))
    return levels


def logp(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """Natural log probability of each key's last character after those before it."""
    out = np.zeros(len(keys), np.float32)
    todo = np.arange(len(keys))
    for n in range(len(levels), 0, -1):
        level, now = levels[n - 1], keys[todo]
        value, there = lookup(level.keys, level.logp, now)
        out[todo[there]] += value[there]
        todo, now = todo[~there], now[~there]
        if not len(todo):
            return out
        left, known = lookup(level.contexts, level.left, now >> BITS)
        out[todo[known]] += left[known]
        keys = keys.copy() if n == len(levels) else keys
        keys[todo] &= (1 << BITS * (n - 1)) - 1
    out[todo] -= np.float32(np.log(CODES))
    return out
