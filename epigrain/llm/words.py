"""Vectorised word and shingle hashing over batches of UTF-8 text; every function works on whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that separate words: space and 0x09 to 0x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)

#: Bytes of text handled at once, so that the arrays of a task stay small whatever an Arrow batch holds.
PIECE_BYTES = 500_000


def _folding() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


def _separators(also: str = "") -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(SPACES)] = True
    out[[ord(c) for c in also]] = True
    return out


FOLD = _folding()
SPACE = _separators()
#: Words of letters and digits: every other ASCII byte separates; bytes of other scripts count as letters.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that near hashes spread."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_B
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _PRIME, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes], separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and the offset of each text's first word (one more at the end).

    ASCII upper case is folded. A text without words has an empty range.
    """
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, dtype=np.uint8)
    gap = separator[raw]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    lengths = ends - starts
    # a word's hash is the sum of byte * power, where powers start anew in each word
    inside = np.flatnonzero(~gap)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(inside), dtype=np.int64) - np.repeat(first, lengths)
    values = (FOLD[raw[inside]].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(values, first) ^ lengths.astype(np.uint64))
    text_starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, text_starts).astype(np.int64)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `width` words inside a text; a shorter, non-empty text gives its whole sequence as one."""
    counts = np.diff(offsets)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate(([0], np.cumsum(made)))
    if not len(words):
        return np.empty(0, np.uint64), out_offsets
    total = np.zeros(len(words), dtype=np.uint64)
    for k in range(min(width, len(words))):
        total[: len(words) - k] = total[: len(words) - k] * _PRIME + words[k:]
    text = np.repeat(np.arange(len(counts)), made)
    at = offsets[:-1][text] + (np.arange(out_offsets[-1]) - out_offsets[:-1][text])
    out = mix(total[at])
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        value = np.uint64(counts[i])
        with np.errstate(over="ignore"):
            for w in words[offsets[i] : offsets[i + 1]]:
                value = value * _PRIME + w
        out[out_offsets[i]] = mix(np.array([~value], dtype=np.uint64))[0]
    return out, out_offsets


def distinct_per_text(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text, and their offsets."""
    if not len(hashes):
        return hashes, np.zeros_like(offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    counts = np.bincount(text[keep], minlength=len(offsets) - 1)
    return hashes[keep], np.concatenate(([0], np.cumsum(counts)))


def slices_of(column, rows: int = 256) -> Iterator[list]:
    """The values of an Arrow column, some rows at a time, so that a batch is never held as Python objects whole."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def in_pieces(texts: list[bytes], most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together; one longer text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
