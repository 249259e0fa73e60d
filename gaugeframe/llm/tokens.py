"""Vectorised text kernel on Arrow string buffers.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A
word's 64-bit hash is a polynomial over a random byte table, so that all words
of a batch are hashed by one cumulative sum, without a Python loop. Every hash
depends on the content alone and is equal in all tasks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document forms a chunk of its own.
CHUNK_BYTES = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


#: Bytes that are in no term: ASCII other than letters and digits.
NO_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


BLOCK_BITS = 20


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, as many as a block has bytes."""
    out = []
    for r in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))):
        p = np.ones(1 << BLOCK_BITS, np.uint64)
        for k in range(BLOCK_BITS):
            p[1 << k : 2 << k] = p[: 1 << k] * r
            r = r * r
        out.append(p)
    return out[0], out[1]


np.seterr(over="ignore")


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_large_binary(col.type) and not pa.types.is_binary(col.type) else b"")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole documents."""
    if not len(col):
        return
    buf, offs = text_buffer(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of each byte range buf[starts:ends]; equal bytes, equal hash."""
    if not len(starts):
        return np.empty(0, np.uint64)
    p, inv = _powers()
    size, places = 1 << BLOCK_BITS, np.concatenate([starts, ends])
    sums = np.empty(len(places), np.uint64)
    order = None if len(buf) <= size else np.argsort(places, kind="stable")
    carry, step, done = np.uint64(0), 1, 0
    for lo in range(0, max(len(buf), 1), size):  # block by block, so that a long text takes no more memory
        part = buf[lo : lo + size]
        cum = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE[FOLD[part] if fold else part] * p[: len(part)], out=cum[1:])
        if order is None:
            sums = cum[places]
            break
        cum = cum * np.uint64(step) + carry
        upto = int(np.searchsorted(places, lo + len(part), side="right", sorter=order))
        sums[order[done:upto]] = cum[places[order[done:upto]] - lo]
        carry, step, done = cum[-1], step * pow(int(BASE), size, 1 << 64) % (1 << 64), upto
    back = inv[starts & (size - 1)]
    if order is not None:
        over = pow(pow(int(BASE), size, 1 << 64), -1, 1 << 64)
        far = [1]
        while len(far) <= len(buf) >> BLOCK_BITS:
            far.append(far[-1] * over % (1 << 64))
        back = back * np.array(far, np.uint64)[starts >> BLOCK_BITS]
    return mix((sums[len(starts) :] - sums[: len(starts)]) * back + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def words(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word: a run of bytes that are not marked in gap."""
    inside = ~gap[buf]
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edge[:n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def ngrams(word: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word's index of each run of k words within a document."""
    m = len(word) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    acc = np.full(m, k, np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0xF1357AEA2E62A9C5) + word[j : j + m]
    at = np.flatnonzero(doc[:m] == doc[k - 1 :])
    return mix(acc[at]), at


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles, sorted within each document, and the number of them by document.

    A document with fewer than k words, but one at least, has its whole word
    sequence as its single shingle.
    """
    n = len(offs) - 1
    s, e, doc = words(buf, offs)
    h = hash_ranges(buf, s, e, fold=True)
    grams, at = ngrams(h, doc, k)
    gdoc = doc[at]
    count = np.bincount(doc, minlength=n)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(doc, short)
        whole = np.empty(len(short), np.uint64)
        for i, (d, f) in enumerate(zip(short, first)):
            whole[i] = ngrams(h[f : f + count[d]], doc[f : f + count[d]], int(count[d]))[0][0]
        grams, gdoc = np.concatenate([grams, whole]), np.concatenate([gdoc, short])
        order = np.argsort(gdoc, kind="stable")
        grams, gdoc = grams[order], gdoc[order]
    at = np.searchsorted(gdoc, np.arange(n + 1)).tolist()
    for lo, hi in zip(at[:-1], at[1:]):  # plain sorts of one document each are much faster than one by two keys
        grams[lo:hi].sort()
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (gdoc[1:] != gdoc[:-1])
        grams, gdoc = grams[new], gdoc[new]
    return grams, np.bincount(gdoc, minlength=n)
