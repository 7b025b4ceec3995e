"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters, digits and marks of any script; in scripts written without spaces (Chinese, Japanese, Thai,
Lao, Khmer, Burmese, ...) each character is a word. A document and an item that share a seed, a run of ``LEAST`` words, form a pair.
Within a pair the longest common run of words is marked on both sides, again and again, as long as an unmarked run of at least
``LEAST`` words is left; runs are found by Karp-Rabin hashes of width ``LEAST``. The marked share of the item is its coverage, so
passages whose parts were moved around, or that have text in between, are found too. A document with an item covered to
``COVERAGE`` is contaminated.

Documents pass a fixed-size bit table of the items' seeds first, and only the runs of words around its hits go on; the table's size
does not grow with the benchmark, and the exact seed join follows. Neither documents nor items are collected or broadcast.

Null and empty texts share nothing and are kept. Items of fewer than ``LEAST`` words are no evidence and match nothing. Rows that
repeat a doc_id are tiled each by itself; the best item wins, ties go to the smaller item_id. Other columns are ignored; an empty
table on either side contaminates nothing.
"""

from __future__ import annotations

import heapq
import unicodedata
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bit_table, tidy, without, written
from .words import NOT_ALNUM, in_pieces, shingle_hashes, slices_of, word_hashes

LEAST = 5
COVERAGE = 0.5
#: Bits of the table of seeds.
TABLE_BITS = 1 << 23
#: Places of equal seeds that are laid out at once within a pair.
MATCHES = 1 << 20


#: Names of characters of scripts without spaces between words begin so.
UNSPACED = (
    "CJK UNIFIED", "CJK COMPATIBILITY", "IDEOGRAPHIC", "HIRAGANA", "KATAKANA", "HENTAIGANA", "HALFWIDTH KATAKANA", "BOPOMOFO", "THAI", "LAO",
    "KHMER", "MYANMAR", "TIBETAN", "YI ", "NEW TAI LUE", "TAI THAM", "TAI LE", "TAI VIET", "JAVANESE", "BALINESE", "NUSHU", "TANGUT",
)


class _Words(dict):
    """For ``str.translate``: a space for what is in no word, spaces around characters that are words of their own."""

    def __missing__(self, code: int):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind[0] not in "LNM":
            # soft hyphens, joiners and the like are inside words and not seen
            to = "" if kind == "Cf" else " "
        elif code >= 0x0E00 and unicodedata.name(c, "").startswith(UNSPACED):
            to = f" {c} " if kind[0] != "M" else c
        else:
            to = c
        self[code] = to
        return to


_WORDS = _Words()


def _raw(texts: list[str | None]) -> list[bytes]:
    return [_spaced(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _spaced(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower().translate(_WORDS)


def words_of(texts: pa.Array):
    """Word hashes of the texts of a column, some texts at a time."""
    for some in slices_of(texts):
        raw = _raw(some)
        for a, b in in_pieces(raw):
            yield word_hashes(raw[a:b], NOT_ALNUM)


def seeds_of(words: np.ndarray, least: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``least`` words, signed for Spark."""
    if len(words) < least:
        return np.empty(0, np.int64)
    return shingle_hashes(words, np.array([0, len(words)]), least)[0].view(np.int64)


def _joined(i: np.ndarray, j: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (start in item, start in segment, seeds), those that follow one another on a diagonal made one."""
    along = np.lexsort((i, j - i))
    i, j, lengths = i[along], j[along], lengths[along]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (i[1:] != i[:-1] + lengths[:-1]) | (j[1:] != j[:-1] + lengths[:-1])
    starts = np.flatnonzero(new)
    return i[starts], j[starts], np.add.reduceat(lengths, starts) if len(starts) else lengths


def tiles(item: np.ndarray, segments: list[np.ndarray], least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """Greedy tiling of an item by the segments of a document: (start in item, segment, start in segment, length), longest first.

    Ties go to the earlier start in the item, then in the document.
    """
    own = seeds_of(item, least)
    order = np.argsort(own, kind="stable")
    ordered = own[order]
    heap: list[tuple[int, int, int, int]] = []
    for s, words in enumerate(segments):
        theirs = seeds_of(words, least)
        low, high = np.searchsorted(ordered, theirs, "left"), np.searchsorted(ordered, theirs, "right")
        counts = high - low
        if not counts.any():
            continue
        some, ends = [], np.cumsum(counts)
        a = 0
        while a < len(theirs):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MATCHES, "right")))
            n = counts[a:b]
            j = np.repeat(np.arange(a, b), n)
            i = order[np.repeat(low[a:b], n) + np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)]
            some.append(_joined(i, j, np.ones(len(i), dtype=np.int64)))
            a = b
        i, j, lengths = _joined(*map(np.concatenate, zip(*some, strict=True)))
        heap += zip((1 - least - lengths).tolist(), i.tolist(), [s] * len(i), j.tolist(), strict=True)
    heapq.heapify(heap)
    marked_item = np.zeros(len(item), dtype=bool)
    marked = [np.zeros(len(w), dtype=bool) for w in segments]
    out, left = [], len(item)
    while heap and left >= least:
        n, i, s, j = heapq.heappop(heap)
        n = -n
        taken = marked_item[i : i + n] | marked[s][j : j + n]
        if not taken.any():
            marked_item[i : i + n] = True
            marked[s][j : j + n] = True
            out.append((i, s, j, n))
            left -= n
            continue
        free = np.concatenate(([0], (~taken).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(free))
        for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, i + a, s, j + a))
    return out


def item_words(benchmark: DataFrame, least: int) -> DataFrame:
    """(item, item_id, words) of every item with enough words; ``item`` tells rows apart."""

    def run(batches):
        rows = count(TaskContext.get().partitionId() << 33)
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for words, offsets in words_of(batch.column(1)):
                got = [
                    (next(rows), ids[at + i], words[offsets[i] : offsets[i + 1]].tobytes())
                    for i in range(len(offsets) - 1)
                    if offsets[i + 1] - offsets[i] >= least
                ]
                at += len(offsets) - 1
                if got:
                    item, item_id, body = zip(*got, strict=True)
                    arrays = [pa.array(item, pa.int64()), pa.array(item_id, pa.int64()), pa.array(body, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["item", "item_id", "words"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, "item long, item_id long, words binary"), "items")


def item_seeds(items: DataFrame, least: int) -> DataFrame:
    """The distinct (seed, item) pairs, and how often the seed occurs in the item."""

    def run(batches):
        for batch in batches:
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seeds, times = np.unique(seeds_of(np.frombuffer(body, np.uint64), least), return_counts=True)
                arrays = [pa.array(seeds), pa.array(np.full(len(seeds), item)), pa.array(times, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["seed", "item", "times"])

    return written(items.select("item", "words").mapInArrow(run, "seed long, item long, times long"), "item-seeds")


def suspect_segments(docs: DataFrame, table: np.ndarray, least: int) -> DataFrame:
    """(row, doc_id, digest, starts, words, seeds): the runs of words of a document whose seeds may be an item's. A row without is null there."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table))
    size = len(table)

    def run(batches):
        known = np.unpackbits(shared.value, count=size).astype(bool)
        rows = count(TaskContext.get().partitionId() << 33)
        for batch in batches:
            ids, digests, at = batch.column(0), batch.column(2), 0
            for words, offsets in words_of(batch.column(1)):
                n = len(offsets) - 1
                hashes, places = shingle_hashes(words, offsets, least)
                hit = known[(hashes & np.uint64(size - 1)).astype(np.int64)]
                texts = np.repeat(np.arange(n), np.diff(places))
                starts_of, words_in, seeds_in = [None] * n, [None] * n, [None] * n
                where = np.flatnonzero(hit)
                for i in np.unique(texts[where]):
                    if offsets[i + 1] - offsets[i] < least:
                        continue
                    at_seed = np.flatnonzero(hit[places[i] : places[i + 1]])
                    own = words[offsets[i] : offsets[i + 1]]
                    breaks = np.flatnonzero(np.diff(at_seed) > 1) + 1
                    runs = [(int(r[0]), int(r[-1]) + least) for r in np.split(at_seed, breaks)]
                    starts_of[i] = [a for a, _ in runs]
                    words_in[i] = [own[a:b].tobytes() for a, b in runs]
                    seeds_in[i] = np.unique(hashes[places[i] : places[i + 1]][at_seed]).view(np.int64)
                arrays = [
                    pa.array([next(rows) for _ in range(n)], pa.int64()),
                    ids.slice(at, n),
                    digests.slice(at, n),
                    pa.array(starts_of, pa.list_(pa.int64())),
                    pa.array(words_in, pa.list_(pa.binary())),
                    pa.array(seeds_in, pa.list_(pa.int64())),
                ]
                at += n
                yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "digest", "starts", "words", "seeds"])

    schema = "row long, doc_id long, digest string, starts array<long>, words array<binary>, seeds array<long>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), digest_of("text").alias("digest"))
    return written(rows.mapInArrow(tidy(run), schema), "segments")


def digest_of(text: str) -> Column:
    """What tells texts apart when contaminated ones are taken out."""
    return F.md5(F.col(text).cast("string").cast("binary"))


def tiled_pairs(pairs: DataFrame, least: int) -> DataFrame:
    """(row, item_id, matched_words, item_words) of pairs (row, segments, item_id, words)."""

    def run(batches):
        for batch in batches:
            rows, segments, ids, words = (batch.column(i).to_pylist() for i in range(4))
            matched, sizes = [], []
            for s, w in zip(segments, words, strict=True):
                item = np.frombuffer(w, np.uint64)
                found = tiles(item, [np.frombuffer(x, np.uint64) for x in s], least)
                matched.append(sum(t[3] for t in found))
                sizes.append(len(item))
            arrays = [pa.array(x, pa.int64()) for x in (rows, ids, matched, sizes)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "item_id", "matched_words", "item_words"])

    return pairs.select("row", "segments", "item_id", "words").mapInArrow(
        tidy(run), "row long, item_id long, matched_words long, item_words long"
    )


def judge(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, contaminated, kept, item_id, matched_words, item_words) per document row; the last three are of the best covered
    item and null where no item shares enough seeds to be covered to ``coverage``."""
    return judged_rows(docs, benchmark, least, coverage).drop("digest")


def judged_rows(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """As ``judge``, with the digest of each row's text."""
    items = item_words(benchmark, least)
    seeds = item_seeds(items, least)
    rows = suspect_segments(docs, bit_table(seeds.select(F.col("seed").alias("hash")), TABLE_BITS), least)
    suspects = rows.where("starts IS NOT NULL")
    pairs = suspects.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("row", "item").agg(F.sum("times").alias("shared"))
    # a tile of n words holds n - least + 1 places of shared seeds, so n <= least * places; a seed counts as often as the item has it
    sized = items.withColumn("size", (F.octet_length("words") / 8).cast("long"))
    pairs = pairs.join(sized, "item").where(F.col("shared") * least >= coverage * F.col("size") - least)
    full = pairs.join(suspects.select("row", F.col("words").alias("segments")), "row")
    best = tiled_pairs(full, least).groupBy("row").agg(
        F.max_by(F.struct("item_id", "matched_words", "item_words"), F.struct(F.col("matched_words") / F.col("item_words"), -F.col("item_id"))).alias("best")
    )
    out = rows.select("row", "doc_id", "digest").join(best, "row", "left")
    bad = F.coalesce(F.col("best.matched_words") >= coverage * F.col("best.item_words"), F.lit(False))
    return out.select("digest", "doc_id", bad.alias("contaminated"), (~bad).alias("kept"), "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The rows whose text is not contaminated, with all their columns.

    A verdict depends on the text alone, so rows are told by a digest of it: a missing or repeated doc_id takes no clean row along.
    """
    bad = judged_rows(docs, benchmark, least, coverage).where("contaminated").select("digest")
    return without(docs, digest_of("text"), bad)
