"""Harmonic packing of token sequences: length classes by reciprocal capacity, each bin filled with a fixed number of pieces.

A piece of length n belongs to class k = capacity // n, whose slots are capacity // k long; k pieces of a class fill one bin.
A document is cut freely. Whole sequences come first. What is left is cut to the length of the largest slot it fills exactly,
until the rest wastes at most ``tolerance`` of its slot, so bins are nearly full whatever the lengths are.

Every partition fills its own bins: nothing is shuffled, no group is gathered, and a lost partition is simply computed again.
At a partition's end the pieces of its incomplete bins (fewer than k per class, so fewer than capacity tokens per class) are
laid end to end and cut at the capacity; the last rest is cut at powers of two, which need no padding.

Edge cases: a null or empty text is a document of its end id alone; rows that repeat a doc_id are packed each on its own; an
empty table gives no row; other columns are ignored; a very long text is cut into whole sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy
from .token_ids import CACHE, encoder, slices

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long"
)
#: Share of a slot that a piece may leave empty before its document is cut once more.
TOLERANCE = 0.03


def cuts(length: int, capacity: int, tolerance: float = TOLERANCE) -> list[int]:
    """Piece lengths of a document, in order; their sum is ``length``."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        slot = capacity // (capacity // rest)
        if slot - rest <= tolerance * slot:
            out.append(rest)
            break
        fits = capacity // (capacity // rest + 1)
        out.append(fits)
        rest -= fits
    return out


class HarmonicPacker:
    """Bins of one partition. ``place`` takes pieces and returns the sequences that they complete."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}

    def place(self, piece: tuple, length: int) -> list[tuple] | None:
        k = self.capacity // length
        held = self.open.setdefault(k, [])
        held.append((piece, length))
        if len(held) == k:
            del self.open[k]
            return held
        return None

    def rest(self) -> list[tuple]:
        """Pieces of incomplete bins, larger classes of length first."""
        return [p for k in sorted(self.open) for p in self.open[k]]


def tail_lengths(total: int, capacity: int) -> list[int]:
    """Sequence lengths for what is left at the end: whole ones, then powers of two."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 2048,
    keeps_space: bool = False,
    tolerance: float = TOLERANCE,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents and where they lie: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens); with ``with_ids`` also the ids. A sequence is read by ordering its pieces by offset."""
    tail = np.array([end_id], "<u4").tobytes()
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches):
        encode = encoder(tokenizer, keeps_space).encode
        packer = HarmonicPacker(capacity)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def emit(pieces):
            nonlocal sequence
            total, offset = sum(n for _, n in pieces), 0
            for (doc_id, start, body, doc_tokens), n in pieces:
                rows.append((doc_id, start, n, zlib.crc32(body), doc_tokens, sequence, offset, total, body))
                offset += n
            sequence += 1

        def batch_of():
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:-1]]
            fields = list(names)
            if with_ids:
                arrays.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in columns[-1]], pa.list_(pa.int32())))
                fields.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, fields)

        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for doc_id, body in zip(ids[a:b], encode(texts[a:b]), strict=True):
                    body += tail
                    total, start = len(body) // 4, 0
                    for n in cuts(total, capacity, tolerance):
                        piece = (doc_id, start, body[4 * start : 4 * (start + n)], total)
                        if full := packer.place(piece, n):
                            emit(full)
                        start += n
                if rows:
                    yield batch_of()
        left = packer.rest()
        for size in tail_lengths(sum(n for _, n in left), capacity):
            taken = []
            while size:
                (doc_id, start, body, total), n = left[0]
                m = min(n, size)
                taken.append(((doc_id, start, body[: 4 * m], total), m))
                size -= m
                left[:1] = [] if m == n else [((doc_id, start + m, body[4 * m :], total), n - m)]
            emit(taken)
        if rows:
            yield batch_of()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(tidy(run, CACHE), PIECES + (", ids array<int>" if with_ids else ""))
