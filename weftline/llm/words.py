"""Words, their hashes and shingle hashes of many texts at once, in numpy over Arrow buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as a-z. A word's hash mixes
in its length and eight bytes at a time, for all words together; that of a long one is BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: In a plain word, ASCII punctuation and controls are space too.
PLAIN = np.array([not (chr(b).isalnum() or b >= 128) if b < 128 else False for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
CHUNK = 1 << 20
#: Spans of more bytes than this are hashed one by one.
LONG = 128
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, up to the n-th."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + (1 << 17))
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and n+1 offsets; a null text is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch of about ``size`` bytes of text, or one longer text, each with its bytes and offsets."""
    raw, off = bytes_of(batch.column(batch.schema.get_field_index(text)))
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield batch.slice(a, b - a), raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def prefix(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes modulo 2**64, one longer than ``raw``: for hashes of all windows of one length."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * powers(len(raw))[0][: len(raw)], out=out[1:])
    return out


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes; different spans of one size up to eight bytes never hash alike."""
    size = end - start
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every place on
    out = scramble(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    for at in range(0, LONG, 8):
        if not len(live):
            break
        left = size[live] - at
        out[live] = scramble(out[live] ^ (eight[start[live] + at] & _FIRST[np.minimum(left, 8)]))
        live = live[left > 8]
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def spans(solid: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of solid bytes within a text, and n+1 offsets of the texts' runs."""
    padded = np.zeros(len(solid) + 2, bool)
    padded[1:-1] = solid
    edge = padded[1:] != padded[:-1]
    start, end = np.flatnonzero(edge & padded[1:]), np.flatnonzero(edge & padded[:-1])
    inner = off[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(solid))])
    cut = inner[padded[inner] & padded[inner + 1]]  # a text ends in a run and the next begins with one
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(start, off)


def words(raw: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and n+1 offsets of the texts' words."""
    return spans(~space[raw], off)


def word_hashes(raw: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of every word in lower case, and n+1 offsets of the texts' words."""
    start, end, at = words(raw, off, space)
    return span_hashes(LOWER[raw], start, end), start, end, at


def shingle_hashes(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's n-word shingles, and m+1 offsets; a shorter text with words is one shingle."""
    count = np.diff(at)
    out = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    new = np.concatenate([[0], np.cumsum(out)])
    whole = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for k in range(n):
        whole = scramble(whole + hashes[k : k + len(whole)] + np.uint64(k + 1)) if len(whole) else whole
    first = np.repeat(at[:-1] - new[:-1], out) + np.arange(new[-1])
    if len(whole):
        got = whole[np.minimum(first, len(whole) - 1)]
    else:
        got = np.zeros(new[-1], np.uint64)
    for d in np.flatnonzero((count > 0) & (count < n)):
        h = np.zeros(1, np.uint64)
        for k in range(count[d]):
            h = scramble(h + hashes[at[d] + k : at[d] + k + 1] + np.uint64(k + 1))
        got[new[d]] = scramble(h + np.uint64(count[d]))[0]
    return got, new


def doc_sets(got: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and m+1 offsets."""
    doc = np.repeat(np.arange(len(new) - 1), np.diff(new))
    order = np.lexsort((got, doc))
    got, doc = got[order], doc[order]
    keep = np.ones(len(got), bool)
    keep[1:] = (got[1:] != got[:-1]) | (doc[1:] != doc[:-1])
    return got[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(new) - 1))])
