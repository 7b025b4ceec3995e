"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1-, 2- and 3-grams per language come from one pass over all training texts and one grouped sum. The matrix of
log probabilities has ``buckets`` rows and one column per language; it is broadcast, and texts are scored in numpy, batch by
batch, by looking up only the n-grams that occur in them.

Text is lower-cased per character, what is not a letter is a gap, and no n-gram spans a gap. A null text, a text without letters,
and every text when nothing could be learned get ``und`` with score 0. A null lang is not learned from. Equal scores go to the
language that sorts first. Rows keep their other columns; ``lang`` is never looked at when predicting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, release, tidy
from .words import slices_of

BUCKETS = 1 << 16
SMOOTHING = 0.1
UNKNOWN = "und"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """The lower-case code point of each letter, 0 for everything else."""
    global _FOLD
    if _FOLD is None:
        fold = np.zeros(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                fold[i] = ord(low) if len(low) == 1 else i
        _FOLD = fold
    return _FOLD


def _bucket(key: np.ndarray, order: int, buckets: int) -> np.ndarray:
    mixed = (key * np.uint64(4) + np.uint64(order)) * _MULTIPLIER
    return ((mixed >> np.uint64(32)) & np.uint64(buckets - 1)).astype(np.int32)


def ngrams(texts: list[str], buckets: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket numbers of the 1-, 2- and 3-grams that begin at each place (``buckets`` where there is none), and where each text begins.

    ``buckets`` is a power of two.
    """
    joined = np.frombuffer(("\n" + "\n".join(texts) + "\n\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = _fold()[joined]
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1] + 0
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    keep[starts] = True
    before = np.cumsum(keep) - 1
    codes, starts = codes[keep].astype(np.uint64), before[starts]
    shift = np.uint64(20)
    one = np.where(codes != 0, _bucket(codes, 0, buckets), buckets)
    two = codes[:-1] << shift | codes[1:]
    two = np.where(two != 0, _bucket(two, 1, buckets), buckets)
    three = (codes[:-2] << shift | codes[1:-1]) << shift | codes[2:]
    three = np.where((codes[1:-1] != 0) & ((codes[:-2] != 0) | (codes[2:] != 0)), _bucket(three, 2, buckets), buckets)
    fill = np.full(2, buckets, dtype=np.int32)
    n = len(codes)
    return [one[:n], np.concatenate((two, fill))[:n], np.concatenate((three, fill))[:n]], starts


def _pieces(texts: list[str | None], most: int = 500_000) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  #: float32, a row per language and a column per bucket, and one more that is 0
    log_prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        buckets = self.log_prob.shape[1] - 1
        for a, b in _pieces(texts):
            grams, starts = ngrams([t or "" for t in texts[a:b]], buckets)
            seen = np.add.reduceat((grams[0] < buckets).astype(np.int64), starts)
            total = np.empty((len(self.languages), b - a))
            for k in range(len(self.languages)):
                row = self.log_prob[k]
                total[k] = np.add.reduceat((row[grams[0]] + row[grams[1]] + row[grams[2]]).astype(np.float64), starts)
            total += self.log_prior[:, None]
            best = total.argmax(axis=0) if len(self.languages) else np.zeros(b - a, int)
            if len(self.languages):
                share = 1.0 / np.exp(total - total.max(axis=0)).sum(axis=0)
            for i in range(b - a):
                known = bool(seen[i]) and bool(self.languages)
                names.append(self.languages[best[i]] if known else UNKNOWN)
                scores.append(float(share[i]) if known else 0.0)
        return names, scores


def train(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> LanguageModel:
    """Learn from every row with a language. What reaches the driver is at most languages x buckets counts."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        texts_of: dict[str, int] = {}
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            by: dict[str, list[str]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(t or "")
            for name, texts in by.items():
                texts_of[name] = texts_of.get(name, 0) + len(texts)
                total = sums.setdefault(name, np.zeros(buckets + 1, dtype=np.int64))
                for a, b in _pieces(texts):
                    for g in ngrams(texts[a:b], buckets)[0]:
                        total += np.bincount(g, minlength=buckets + 1)
        for name, total in sums.items():
            at = np.flatnonzero(total[:-1])
            rows = np.concatenate((at, [-1])).astype(np.int32), np.concatenate((total[at], [texts_of[name]]))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows[0])), *map(pa.array, rows)], ["lang", "bucket", "n"])

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counts = rows.mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    names, bucket, n = got["lang"].to_pylist(), got["bucket"].to_numpy(), got["n"].to_numpy()
    languages = sorted(set(names))
    place = {x: i for i, x in enumerate(languages)}
    which = np.array([place[x] for x in names], dtype=int)
    table = np.zeros((len(languages), buckets))
    texts = np.zeros(len(languages))
    real = bucket >= 0
    table[which[real], bucket[real]] = n[real]
    texts[which[~real]] = n[~real]
    smooth = table + SMOOTHING
    log_prob = np.zeros((len(languages), buckets + 1), dtype=np.float32)
    log_prob[:, :buckets] = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    prior = np.log(texts / texts.sum()) if len(languages) else texts
    return LanguageModel(languages, log_prob, prior)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` and the predicted language with its posterior probability (0 to 1). Columns of the names in ``out``
    are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<name: string, score: double>")
    def judge(texts: pa.Array) -> pa.Array:
        release()
        names, scores = [], []
        for some in slices_of(texts):
            name, score = shared.value.score(some)
            names += name
            scores += score
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["name", "score"])

    (judged,) = fresh(docs, "judged")
    scored = docs.withColumn(judged, judge(F.col(text).cast("string")))
    return scored.withColumns({out[0]: F.col(f"{judged}.name"), out[1]: F.col(f"{judged}.score")}).drop(judged)
