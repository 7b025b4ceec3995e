"""Document quality with site evidence: a classifier per document, combined with host and path posteriors.

The document classifier is a ridge logistic regression on presence features in hashed buckets: words, word beginnings, word shapes
with their share of the text, and the share of immediate repetition. It is fitted on at most ``TRAINING_DOCS`` labelled documents
(those with the smallest id hashes) and on the ``MODEL_FEATURES`` features that tell the classes apart best, if they do so as
``SIGNIFICANT`` standard errors would (likelihood ratio). Its log-odds less those of the base rate are a document's evidence.

Sites get beta-binomial posteriors by grouped aggregation over all labels: a host's rate is shrunk toward the global rate, a path's
toward its host's, with prior strengths estimated from the spread between sites (method of moments). A document's log-odds are its
classifier evidence plus the log-odds of its path's posterior mean; sparse or unseen sites so get the rate of the level above.

Two targets are judged so: low quality and toxicity. A document is kept if both probabilities are below ``REJECT``.

Null texts are empty: they have no features and get their site's rate. Null hosts or paths are a site of their own. Null labels count
as not given; labels that repeat a doc_id count as bad if one says bad. Without labels every probability is 0 and all are kept.
Rows that repeat a doc_id are judged each by itself. Names in ``ADDED`` are replaced, other columns stay. Empty tables give empty
results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, release, tidy, written
from .words import FOLD, NOT_ALNUM, SPACE, in_pieces, mix, slices_of

BUCKETS = 1 << 20
TRAINING_DOCS = 20_000
SIGNIFICANT = 4.0
#: Features that a target's classifier has at most, those that tell most.
MODEL_FEATURES = 1024
STEPS, RIDGE = 200, 1e-4
SMOOTHING = 0.5
REJECT = 0.5
TARGETS = ("low", "toxic")
#: Limits of an estimated prior strength, in labelled documents.
STRENGTHS = (10.0, 1e6)
BEGINNING = 4
ADDED = ("p_low", "p_toxic", "kept")

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _shape_classes() -> np.ndarray:
    kinds = np.arange(256, dtype=np.uint64) + np.uint64(10)
    kinds[48:58], kinds[65:91], kinds[97:123], kinds[128:] = 1, 2, 3, 3
    return kinds


_CLASSES = _shape_classes()


def _runs(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edges = np.concatenate(([0], edges))
    return edges[0::2], edges[1::2]


def _hashes(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each run of values; runs lie end to end."""
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(values)) - np.repeat(first, lengths)
    powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(lengths.max()), _PRIME))))
    return mix(np.add.reduceat((values + np.uint64(1)) * powers[place], first) ^ lengths.astype(np.uint64))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the distinct features of each text, sorted."""
    raw_texts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    found = []
    for a, b in in_pieces(raw_texts):
        part = raw_texts[a:b]
        raw = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
        begins = np.cumsum([0] + [len(t) + 1 for t in part])
        keys = []
        starts, ends = _runs(NOT_ALNUM[raw])
        if len(starts):
            lengths, inside = ends - starts, np.flatnonzero(~NOT_ALNUM[raw])
            text = np.searchsorted(begins, starts, "right") - 1
            low = FOLD[raw[inside]].astype(np.uint64)
            words = _hashes(low, lengths)
            keys.append((text, words))
            place = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            long = lengths > BEGINNING
            if long.any():
                head = (place < BEGINNING) & np.repeat(long, lengths)
                keys.append((text[long], _hashes(low[head], np.full(int(long.sum()), BEGINNING)) ^ np.uint64(0xA5)))
            again = np.zeros(len(words), dtype=bool)
            again[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
            counts = np.bincount(text, minlength=len(part))
            share = np.bincount(text[again], minlength=len(part)) / np.maximum(counts, 1)
            some = np.flatnonzero(share > 0)
            keys.append((some, mix(np.minimum(share[some] * 10, 9).astype(np.uint64) + np.uint64(1000))))
        starts, ends = _runs(SPACE[raw])
        if len(starts):
            kinds = _CLASSES[raw]
            keep = ~SPACE[raw]
            keep[1:] &= (kinds[1:] != kinds[:-1]) | SPACE[raw[:-1]]
            word = np.repeat(np.arange(len(starts)), ends - starts)[keep[~SPACE[raw]]]
            shapes = _hashes(kinds[keep], np.bincount(word, minlength=len(starts)))
            text = np.searchsorted(begins, starts, "right") - 1
            order = np.lexsort((shapes, text))
            text, shapes = text[order], shapes[order]
            new = np.ones(len(text), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (shapes[1:] != shapes[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.concatenate((first, [len(text)])))
            level = np.floor(-np.log2(times / np.bincount(text, minlength=len(part))[text[first]])).astype(np.uint64)
            keys.append((text[first], mix(shapes[first] ^ np.uint64(0x5A5A))))
            keys.append((text[first], mix(shapes[first] + np.minimum(level, np.uint64(4)) * _PRIME)))
        if keys:
            text = np.concatenate([k[0] for k in keys]).astype(np.int64)
            bucket = np.concatenate([(k[1] >> np.uint64(40)) & np.uint64(BUCKETS - 1) for k in keys]).astype(np.int64)
            found.append(np.unique((text + a) * BUCKETS + bucket))
    both = np.concatenate(found) if found else np.empty(0, np.int64)
    return both // BUCKETS, both % BUCKETS


def _targets(labels: DataFrame) -> DataFrame:
    """One row per labelled doc_id: low and toxic as 0, 1 or null."""
    return (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg((1 - F.min("quality").cast("int")).alias("low"), F.max("toxic").cast("int").alias("toxic"))
    )


@dataclass
class DocumentModel:
    weights: np.ndarray  #: per target and bucket, 0 for what is no feature of the model
    offsets: np.ndarray  #: per target: intercept less the log-odds of the training set

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """The classifier's log-odds beyond the base rate, a row per target."""
        text, bucket = features(texts)
        sums = [np.bincount(text, self.weights[k, bucket], len(texts)) for k in range(len(TARGETS))]
        return np.stack(sums) + self.offsets[:, None]


def logistic(rows: np.ndarray, columns: np.ndarray, marks: np.ndarray, n_columns: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression on presence features, by Adam over all rows."""
    n = len(marks)
    value, mean, spread = np.zeros(n_columns + 1), np.zeros(n_columns + 1), np.zeros(n_columns + 1)
    value[-1] = np.log((marks.sum() + SMOOTHING) / (n - marks.sum() + SMOOTHING))
    for step in range(1, STEPS + 1):
        odds = np.bincount(rows, value[columns], n) + value[-1]
        miss = 1 / (1 + np.exp(-np.clip(odds, -50, 50))) - marks
        slope = np.concatenate((np.bincount(columns, miss[rows], n_columns) / n + RIDGE * value[:-1], [miss.mean()]))
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope**2
        value -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return value[:-1], float(value[-1])


def _likelihood_ratio(good: Column, bad: Column, all_good: int, all_bad: int) -> Column:
    """G statistic of a feature against the class, which holds for small counts; about a squared number of standard errors."""
    share = (good + bad) / (all_good + all_bad)

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    present = term(good, share * all_good) + term(bad, share * all_bad)
    absent = term(all_good - good, (1 - share) * all_good) + term(all_bad - bad, (1 - share) * all_bad)
    return 2 * (present + absent)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCS, features_each: int = MODEL_FEATURES) -> DocumentModel:
    """Learn from at most ``most`` labelled documents. Only the chosen features and their places in these documents reach the driver."""
    chosen = _targets(labels).orderBy(F.xxhash64("_id"), "_id").limit(most)
    # the chosen ids are bounded by ``most``: 24 bytes a row
    chosen = chosen.select(F.col("_id").alias("key"), "low", "toxic")
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    known = texts.join(F.broadcast(chosen), "key").select("key", "low", "toxic", "text")
    # rows that repeat an id count once, the first in the order of a hash, so the bound holds for rows too
    known = known.groupBy("key", "low", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    known = written(known.drop("key"), "labelled")
    names = ["n00", "n01", "n10", "n11"]

    def marks_of(batch):
        return [np.array([-1 if x is None else x for x in batch.column(i).to_pylist()], dtype=int) for i in (0, 1)]

    def small(batches):
        return (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256))

    def count(batches):
        total = np.zeros((4, BUCKETS), dtype=np.int32)
        sizes = np.zeros(4, dtype=np.int64)
        for batch in small(batches):
            marks = marks_of(batch)
            text, bucket = features(batch.column(2).to_pylist())
            for k in range(4):
                of = marks[k // 2] == k % 2
                sizes[k] += of.sum()
                total[k] += np.bincount(bucket[of[text]], minlength=BUCKETS).astype(np.int32)
        at = np.flatnonzero(total.any(axis=0))
        rows = [np.concatenate((at, [-1])), *[np.concatenate((total[k, at], [sizes[k]])) for k in range(4)]]
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)) for r in rows], ["bucket", *names])

    counted = known.mapInArrow(tidy(count), "bucket long, " + ", ".join(f"{n} long" for n in names))
    sums = written(counted.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]), "features")
    sizes = sums.where("bucket = -1").first()
    model = DocumentModel(np.zeros((len(TARGETS), BUCKETS), dtype=np.float32), np.zeros(len(TARGETS)))
    if sizes is None:
        return model
    picked = []
    for k in range(len(TARGETS)):
        good, bad = names[2 * k], names[2 * k + 1]
        ratio = _likelihood_ratio(F.col(good), F.col(bad), sizes[good], sizes[bad])
        best = sums.where("bucket >= 0").select("bucket", ratio.alias("g")).where(F.col("g") >= SIGNIFICANT**2)
        picked.append(sorted(r.bucket for r in best.orderBy(F.desc("g"), "bucket").limit(features_each).collect()))
    places = np.unique(np.array([b for p in picked for b in p], dtype=np.int64))
    if not len(places):
        return model
    wanted = docs.sparkSession.sparkContext.broadcast(places)

    def present(batches):
        for batch in small(batches):
            marks = marks_of(batch)
            text, bucket = features(batch.column(2).to_pylist())
            at = np.minimum(np.searchsorted(wanted.value, bucket), len(wanted.value) - 1)
            hit = wanted.value[at] == bucket
            lists = np.split(at[hit].astype(np.int32), np.searchsorted(text[hit], np.arange(1, batch.num_rows)))
            arrays = [pa.array(m.astype(np.int32)) for m in marks] + [pa.array(lists[: batch.num_rows], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["low", "toxic", "places"])

    got = known.mapInArrow(tidy(present), "low int, toxic int, places array<int>").toArrow()
    lists = got["places"].combine_chunks()
    lengths = np.asarray(lists.value_lengths()).astype(int)
    rows, columns = np.repeat(np.arange(len(lengths)), lengths), np.asarray(lists.flatten())
    for k, target in enumerate(TARGETS):
        marks = got[target].to_numpy()
        told = marks >= 0
        bad = (marks == 1).sum()
        if not bad or bad == told.sum():
            continue
        mine = np.isin(places, picked[k])[columns] & told[rows]
        number = np.cumsum(told) - 1
        weights, intercept = logistic(number[rows[mine]], columns[mine], (marks[told] == 1).astype(float), len(places))
        model.weights[k, places] = weights
        model.offsets[k] = intercept - np.log(bad / (told.sum() - bad))
    return model


def _strength(groups: DataFrame, n: str, bad: str, above: str) -> float:
    """Prior strength of a level by the method of moments: how much its rates spread beyond chance around the rate above."""
    rate = F.col(bad) / F.col(n)
    got = groups.where(F.col(n) > 0).agg(
        F.sum(F.col(n) * (rate - F.col(above)) ** 2).alias("spread"),
        F.sum(F.col(above) * (1 - F.col(above))).alias("chance"),
        F.sum(n).alias("n"),
        F.sum(F.col(n) * F.col(above) * (1 - F.col(above))).alias("binomial"),
    ).first()
    if not got.n:
        return STRENGTHS[1]
    between = (got.spread - got.chance) / got.n
    if between <= 0:
        return STRENGTHS[1]
    return min(max(got.binomial / got.n / between - 1, STRENGTHS[0]), STRENGTHS[1])


def site_rates(docs: DataFrame, labels: DataFrame, host: str, path: str) -> tuple[DataFrame, dict[str, float]]:
    """(host, path, rate per target) for every path with a label, and the global rates. Counts cover all labelled documents."""
    light = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.coalesce(F.col(path), F.lit("")).alias("path"))
    known = light.join(_targets(labels), "_id")
    sums = [f(t) for t in TARGETS for f in (lambda t: F.count(t).alias(f"n_{t}"), lambda t: F.coalesce(F.sum(t), F.lit(0)).alias(f"bad_{t}"))]
    paths = written(known.groupBy("host", "path").agg(*sums), "path-counts")
    total = paths.agg(*[F.sum(c).alias(c) for c in paths.columns[2:]]).first()
    overall = {t: ((total[f"bad_{t}"] or 0) + SMOOTHING) / (total[f"n_{t}"] + 2 * SMOOTHING) if total[f"n_{t}"] else 0.0 for t in TARGETS}
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in paths.columns[2:]])
    for t in TARGETS:
        hosts = hosts.withColumn(f"above_{t}", F.lit(overall[t]))
    for t in TARGETS:
        s = _strength(hosts, f"n_{t}", f"bad_{t}", f"above_{t}")
        hosts = hosts.withColumn(f"host_{t}", (F.col(f"bad_{t}") + s * overall[t]) / (F.col(f"n_{t}") + s))
    paths = written(paths.join(hosts.select("host", *[f"host_{t}" for t in TARGETS]), "host"), "path-rates")
    for t in TARGETS:
        s = _strength(paths, f"n_{t}", f"bad_{t}", f"host_{t}")
        paths = paths.withColumn(f"rate_{t}", (F.col(f"bad_{t}") + s * F.col(f"host_{t}")) / (F.col(f"n_{t}") + s))
    rated = paths.select("host", "path", *[f"rate_{t}" for t in TARGETS], *[f"host_{t}" for t in TARGETS])
    return written(rated, "site-rates"), overall


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``docs`` with p_low, p_toxic and kept. ``host`` and ``path`` name the columns of the two site levels."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rates, overall = site_rates(docs, labels, host, path)

    @F.arrow_udf("struct<low: double, toxic: double>")
    def evidence(texts: pa.Array) -> pa.Array:
        release()
        parts = [model.value.evidence(some) for some in slices_of(texts)]
        low, toxic = np.concatenate(parts, axis=1) if parts else (np.empty(0), np.empty(0))
        return pa.StructArray.from_arrays([pa.array(low), pa.array(toxic)], ["low", "toxic"])

    found, site, only = fresh(docs, "evidence", "site", "only")
    paths = rates.select(F.struct(*[c for c in rates.columns if c not in {f"host_{t}" for t in TARGETS}]).alias(site))
    hosts = rates.select(F.struct("host", *[F.col(f"host_{t}").alias(t) for t in TARGETS]).alias(only)).distinct()
    scored = docs.withColumn(found, evidence(F.col("text").cast("string")))
    here, below = F.coalesce(F.col(host), F.lit("")), F.coalesce(F.col(path), F.lit(""))
    joined = scored.join(paths, (here == F.col(f"{site}.host")) & (below == F.col(f"{site}.path")), "left")
    joined = joined.join(hosts, here == F.col(f"{only}.host"), "left")

    def probability(t: str) -> Column:
        if overall[t] <= 0:
            return F.lit(0.0)
        rate = F.coalesce(F.col(f"{site}.rate_{t}"), F.col(f"{only}.{t}"), F.lit(overall[t]))
        odds = F.col(f"{found}.{t}") + F.log(rate / (1 - rate))
        return 1 / (1 + F.exp(-odds))

    added = {f"p_{t}": probability(t) for t in TARGETS}
    out = joined.withColumns(added).withColumn("kept", (F.col("p_low") < REJECT) & (F.col("p_toxic") < REJECT))
    names = [c for c in docs.columns if c not in ADDED]
    return out.select(*names, *ADDED)
