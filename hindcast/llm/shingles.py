"""Sets of hashed word shingles, for many texts at once."""

from __future__ import annotations

import numpy as np

from .common import mix

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes hashed at a time; a longer text is cut between words.
BLOCK = 2 << 20


def words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (ASCII lower-cased, separated by ASCII white space) and the document of each."""
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = (body != 32) & ((body < 9) | (body > 13))
    first = np.zeros(len(body) + 1, bool)
    first[offsets] = True  # a document's end ends a word
    before = np.concatenate([[False], text[:-1]])
    starts = np.flatnonzero(text & (~before | first[:-1]))
    after = np.concatenate([text[1:], [False]])
    ends = np.flatnonzero(text & (~after | first[1:])) + 1
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK, side="right")))
        lo, hi = starts[a], ends[b - 1]
        part = body[lo:hi].astype(np.uint64)
        part += np.where((part >= 65) & (part <= 90), np.uint64(33), np.uint64(1))
        power = np.full(len(part) + 1, _BASE)
        power[0] = 1
        power = np.multiply.accumulate(power)
        total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(part * power[:-1])])
        back = np.full(len(part) + 1, _INVERSE)
        back[0] = 1
        back = np.multiply.accumulate(back)
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64))
        a = b
    return out, np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(body: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document in ascending order, one after the other, and the n + 1 offsets.

    A document with fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    docs = len(offsets) - 1
    word, doc = words(body, offsets)
    count = np.bincount(doc, minlength=docs)
    first = np.cumsum(count) - count
    size = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    own = np.repeat(np.arange(docs), size)
    at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + first[own]
    length = np.minimum(count, width)[own]
    hashed = mix(length.astype(np.uint64), 7)
    for j in range(width):
        live = j < length
        nxt = mix(hashed[live] * np.uint64(0xD6E8FEB86659FD93) + word[at[live] + j])
        hashed[live] = nxt
    by = np.lexsort((hashed, own))
    hashed, own = hashed[by], own[by]
    new = np.ones(len(own), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (own[1:] != own[:-1])
    hashed, own = hashed[new], own[new]
    return hashed, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=docs))])


def set_ids(hashed: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One number for each set, the same for equal sets (64 bits; empty sets have 0)."""
    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mix(hashed, 3))])
    size = np.diff(offsets)
    return np.where(size > 0, mix(total[offsets[1:]] - total[offsets[:-1]] + size.astype(np.uint64)), np.uint64(0)).astype(np.int64)
