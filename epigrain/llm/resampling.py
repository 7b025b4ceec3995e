"""Importance resampling towards a target: documents whose hashed n-grams look like the target's are drawn more often.

Features are all runs of one to three words, counted in buckets of their crc32. A crc32 can be carried on: the state after "a b" gives
that after "a b c" from the bytes " c" alone, and what a known word does to a state is a table lookup. So the vocabulary has a head
and a tail:

    head words      the most frequent words of the corpus, broadcast with their crc32 state and length: unigrams are looked up, and
                    features that end in one are states moved on by table, for a whole batch at once
    frequent pairs  the states of all pairs of the most frequent head words, broadcast as a square table
    tail            features that end in any other word take a direct crc32 of that word's bytes from the state before it

Both give the exact crc32 of the feature's bytes, so bucket totals and weights do not depend on the size of the head; it only saves
time. Counts cover all words of all documents. Documents are then drawn without replacement by the largest of weight plus Gumbel noise,
where the noise is a function of the doc_id.

Edge cases: a null text has no words, a null doc_id draws its noise as an empty one; rows that repeat a doc_id are documents of their
own (those alike in score as well take successive ranks in any order); an empty target leaves every gain to the corpus; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import tidy, worker_cache, written
from .words import in_pieces, slices_of

BUCKETS = 10_000
#: A head word is at least one in so many of all words, so there are at most so many; PAIR_WORDS of them have their pairs kept. With the
#: longest word of the head in bytes they bound the broadcast.
HEAD_WORDS, PAIR_WORDS, LONGEST_WORD = 1 << 18, 1_024, 60
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 200_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _tokens(texts: list[str | None]) -> list[list[bytes]]:
    """The words of each text as UTF-8; only A-Z is folded."""
    return [_WORD.findall(t.encode().lower()) if t else [] for t in texts]


def head_words(texts: DataFrame, most: int = HEAD_WORDS) -> list[bytes]:
    """Words that are at least one in ``most`` of all words, the most frequent first (ties: in byte order), counted over the whole table."""

    def count(batches):
        held: Counter = Counter()

        def hand_on():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for texts in slices_of(batch.column(0)):
                for words in _tokens(texts):
                    held.update(w for w in words if len(w) <= LONGEST_WORD)
                    if len(held) > HELD_WORDS:
                        yield hand_on()
        yield hand_on()

    counted = texts.select(F.col("text").cast("string")).mapInArrow(tidy(count), "word binary, n long")
    counts = written(counted.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") * most >= total).collect() if most else []
    return [bytes(r.word) for r in sorted(found, key=lambda r: (-r.n, bytes(r.word)))]


def _shift_tables(longest: int) -> np.ndarray:
    """What n bytes of zeros do to a crc32 state, for n up to ``longest``: a table of 256 for each of the state's four bytes."""
    single = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # one zero byte, by the low byte
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, longest + 1):
        before = out[n - 1]
        out[n] = (before >> np.uint32(8)) ^ single[before & np.uint32(255)]
    return out.reshape(longest + 1, -1)


class Features:
    """Bucket numbers of the n-grams of texts, by the head's states and by direct crc32 beyond it."""

    def __init__(self, head: list[bytes], pairs: int = PAIR_WORDS, buckets: int = BUCKETS):
        self.index = {w: i for i, w in enumerate(head)}
        self.buckets = buckets
        self.state = np.array([*map(zlib.crc32, head), 0], np.uint32)
        self.after_space = np.array([*(zlib.crc32(b" " + w) for w in head), 0], np.uint32)
        self.length = np.array([*(len(w) + 1 for w in head), 0], np.int64)
        self.shift = _shift_tables(int(self.length.max()))
        self.pairs = min(pairs, len(head))
        left, right = np.meshgrid(np.arange(self.pairs), np.arange(self.pairs), indexing="ij")
        self.pair_state = self._moved(self.state[left.ravel()], right.ravel())

    def _moved(self, states: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """The states after a space and a head word."""
        table, row = self.shift.reshape(-1), self.length[heads] * 1024
        out = self.after_space[heads]
        for k in range(4):
            out = out ^ table[row + (256 * k) + ((states >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64)]
        return out

    def _next(self, states: np.ndarray, heads: np.ndarray, words: list[bytes]) -> np.ndarray:
        """The states after a space and each word, whose place in the head is ``heads``, or -1."""
        known = heads >= 0
        out = np.empty(len(states), np.uint32)
        out[known] = self._moved(states[known], heads[known])
        tail = np.flatnonzero(~known)
        out[tail] = [zlib.crc32(b" " + words[i], s) for i, s in zip(tail.tolist(), states[tail].tolist())]
        return out

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, the bucket of every feature of all texts, and the text each belongs to."""
        tokens = _tokens(texts)
        counts = np.array([len(x) for x in tokens], np.int64)
        words = list(chain.from_iterable(tokens))
        if not words:
            return counts, np.empty(0, np.uint32), np.empty(0, np.int64)
        heads = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        text = np.repeat(np.arange(len(texts)), counts)
        one = self.state[heads]
        tail = np.flatnonzero(heads < 0)
        one[tail] = [zlib.crc32(words[i]) for i in tail.tolist()]
        at = np.flatnonzero(text[1:] == text[:-1])  # where a pair begins
        two = np.empty(len(at), np.uint32)
        kept = (heads[at] >= 0) & (heads[at] < self.pairs) & (heads[at + 1] >= 0) & (heads[at + 1] < self.pairs)
        two[kept] = self.pair_state[heads[at[kept]] * self.pairs + heads[at[kept] + 1]]
        rest = at[~kept]
        two[~kept] = self._next(one[rest], heads[rest + 1], [words[i + 1] for i in rest.tolist()])
        long = np.flatnonzero(text[at] == text[np.minimum(at + 2, len(text) - 1)]) if len(text) > 2 else np.empty(0, np.int64)
        long = long[at[long] + 2 < len(text)]
        third = at[long] + 2
        three = self._next(two[long], heads[third], [words[i] for i in third.tolist()])
        states = np.concatenate((one, two, three))
        return counts, states % np.uint32(self.buckets), np.concatenate((text, text[at], text[at[long]]))


def _made(shared) -> Features:
    """This worker's tables for a broadcast head."""
    key = (shared.value["key"],)
    made = worker_cache(CACHE)
    if key not in made:
        made.clear()
        made[key] = Features(shared.value["head"], shared.value["pairs"], shared.value["buckets"])
    return made[key]


CACHE = "n-gram states"


def share(spark: SparkSession, head: list[bytes], pairs: int = PAIR_WORDS, buckets: int = BUCKETS):
    """Broadcast a head: at most HEAD_WORDS words of LONGEST_WORD bytes; states and pairs are made from it by each worker."""
    key = zlib.crc32(b" ".join(head)), len(head), pairs, buckets
    return spark.sparkContext.broadcast({"key": key, "head": head, "pairs": pairs, "buckets": buckets})


def bucket_totals(texts: DataFrame, shared) -> np.ndarray:
    """How many features of all texts fall in each bucket: a task hands on one row per bucket, the driver gets one row per bucket."""

    def count(batches):
        made = _made(shared)
        totals = np.zeros(made.buckets, np.int64)
        for batch in batches:
            for texts in slices_of(batch.column(0)):
                for a, b in in_pieces([t or "" for t in texts]):
                    totals += np.bincount(made.of(texts[a:b])[1], minlength=made.buckets)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(totals[used], pa.int64())], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("string")).mapInArrow(tidy(count, CACHE), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(shared.value["buckets"], np.int64)
    for row in counted.collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of the smoothed shares of each bucket, in the target and in the source."""
    n, s_all, t_all = len(source), int(source.sum()) + len(source), int(target.sum()) + len(target)
    ratio = [float(int(target[b]) + 1) * float(s_all) / (float(int(source[b]) + 1) * float(t_all)) for b in range(n)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, shared) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    gains = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        made = _made(shared)
        for batch in batches:
            at = 0
            for texts in slices_of(batch.column(1)):
                for a, b in in_pieces([t or "" for t in texts]):
                    counts, buckets, text = made.of(texts[a:b])
                    weights = np.zeros(b - a, np.int64)
                    np.add.at(weights, text, gains.value[buckets])
                    sizes = np.bincount(text, minlength=b - a)
                    columns = [batch.column(0).slice(at + a, b - a), *(pa.array(x, pa.int64()) for x in (counts, sizes, weights))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run, CACHE), "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Adds the place of each row, from 1, in an order over the whole table, by a range partition; no task holds more than its range."""
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()  # a row per range
    before, table = 0, []
    for part, n in sorted(map(tuple, sizes)):
        table.append((part, before))
        before += n
    table = F.broadcast(rows.sparkSession.createDataFrame(table, "_part long, _before long"))
    joined = placed.withColumn("_part", F.shiftright("_at", 33)).join(table, "_part")
    return joined.withColumn(name, F.expr("_before + (_at & 8589934591L) + 1")).drop("_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, head: int = HEAD_WORDS, pairs: int = PAIR_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank is null for rows that are not drawn.

    ``percent`` of the rows with ``least_words`` words or more are drawn, rounded down: those of highest score, ties to the smaller doc_id.
    """
    shared = share(docs.sparkSession, head_words(docs, head), pairs)
    gains = bucket_gains(bucket_totals(docs, shared), bucket_totals(target, shared))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weigh(docs, gains, shared).withColumn("score", F.col("weight") + noise).withColumn("_row", F.monotonically_increasing_id())
    scored = written(scored, "scored")  # once written, its row numbers stay
    long = scored.where(F.col("n_words") >= least_words)
    drawn = percent * long.count() // 100
    placed = ranked(long, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")])
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*columns).unionByName(short.select(*columns))
