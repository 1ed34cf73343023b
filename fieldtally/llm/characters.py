"""Texts as arrays of code points, several at once, for hashed features in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Characters worked on at once.
AT_ONCE = 1 << 19
CUT = re.compile(r"\s")


def slices(texts: list[str], most: int = AT_ONCE) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (number of the text, text) of about ``most`` characters; a longer text is cut at white space."""
    owners, parts, size = [], [], 0
    for owner, text in enumerate(texts):
        at = 0
        while at < len(text) or at == 0:
            end = at + most
            if end < len(text):
                found = CUT.search(text, end)
                end = found.end() if found else len(text)
            part = text[at:end]
            if parts and size + len(part) > most:
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(owner)
            parts.append(part)
            size += len(part)
            at = max(end, 1)
    if parts:
        yield owners, parts


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a blank after each, and the number of the text of each of them."""
    joined = " ".join(texts) + " "
    lengths = np.array([len(t) + 1 for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.repeat(np.arange(len(texts)), lengths)


@lru_cache(maxsize=4)
def property_table(name: str) -> np.ndarray:
    """By code point, what ``str.<name>()`` says of the character."""
    return np.fromiter((getattr(chr(i), name)() for i in range(0x110000)), bool, 0x110000)


def ngram_hashes(points: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """A bucket for each run of ``n`` code points, by a multiplicative hash."""
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    value = np.full(size, n, np.uint64)
    for i in range(n):
        value *= np.uint64(0x9E3779B97F4A7C15)
        value ^= points[i : i + size]
    value *= np.uint64(0xD6E8FEB86659FD93)
    value >>= np.uint64(33)
    return (value % np.uint64(buckets)).astype(np.int64)
