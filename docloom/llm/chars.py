"""Texts as arrays of code points: classes of characters, tokens and their hashes, without a loop per word."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np

LETTER, DIGIT, UPPER, SPACE = 1, 2, 4, 8
# Letters beyond this code point are not assigned.
TABLE_END = 0x32400
ODD = 0x9E3779B97F4A7C15  # odd multiplier of the token hash
POWERS = 256
# Texts longer than this are worked on in segments, so that memory follows the words, not the characters.
SEGMENT = 1 << 20


class Tables(NamedTuple):
    kind: np.ndarray  # flags by code point
    lower: np.ndarray  # lower-case code point
    powers: np.ndarray  # of ODD, modulo 2^64


@cache
def tables() -> Tables:
    """Built once in each Python worker."""
    kind, lower = np.zeros(sys.maxunicode + 1, np.uint8), np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for code in range(TABLE_END):
        char = chr(code)
        if char.isspace():
            kind[code] = SPACE
        elif char.isalpha() or unicodedata.category(char)[0] == "M":
            kind[code] = LETTER | (UPPER if char.isupper() else 0)
            small = char.lower()
            lower[code] = ord(small) if len(small) == 1 else code
        elif char.isdigit():
            kind[code] = DIGIT
    powers = np.full(POWERS, ODD, np.uint64)
    powers[0] = 1
    return Tables(kind, lower, np.multiply.accumulate(powers))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def segments(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Consecutive parts of at most ``SEGMENT`` characters, with their starts.

    Parts end after a white space; a longer run without one is cut inside.
    """
    start = 0
    while len(codes) - start > SEGMENT:
        spaces = np.flatnonzero(tables().kind[codes[start : start + SEGMENT]] & SPACE)
        end = start + (int(spaces[-1]) + 1 if len(spaces) else SEGMENT)
        yield start, codes[start:end]
        start = end
    yield start, codes[start:]


class Tokens(NamedTuple):
    start: np.ndarray  # first character of each token
    end: np.ndarray  # one past its last
    hash: np.ndarray  # 64 bits of the lower-case token


def tokens(codes: np.ndarray, symbols: bool = False) -> Tokens:
    """Runs of letters, marks and digits; with ``symbols``, each other visible character as well.

    Tokens of one spelling, but for case, have one hash. Two different ones share a hash with a
    probability of about 2^-64. A run of over a million characters is several tokens.
    """
    parts = [(at, _tokens(part, symbols)) for at, part in segments(codes)]
    if len(parts) == 1:
        return parts[0][1]
    return Tokens(
        np.concatenate([t.start + at for at, t in parts]),
        np.concatenate([t.end + at for at, t in parts]),
        np.concatenate([t.hash for _, t in parts]),
    )


def _tokens(codes: np.ndarray, symbols: bool) -> Tokens:
    kind, lower, powers = tables()
    flags = kind[codes]
    word = (flags & (LETTER | DIGIT)) != 0
    used = word | ((flags & SPACE) == 0) if symbols else word
    first = used.copy()
    first[1:] &= ~(word[1:] & word[:-1])
    start = np.flatnonzero(first)
    if not len(start):
        return Tokens(start, start, np.zeros(0, np.uint64))
    last = used.copy()
    last[:-1] &= ~(word[1:] & word[:-1])
    end = np.flatnonzero(last) + 1
    at = np.flatnonzero(used)
    lengths = end - start
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(begins, lengths)
    values = (lower[codes[at]].astype(np.uint64) + np.uint64(1)) * powers[place % POWERS]
    values += (place // POWERS).astype(np.uint64)
    return Tokens(start, end, mixed(np.add.reduceat(values, begins)))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all their bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` tokens, in order."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i in range(size):
        total = total * np.uint64(ODD) + hashes[i : i + count]
    return mixed(total)
