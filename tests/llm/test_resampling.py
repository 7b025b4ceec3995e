import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from epigrain.llm import resampling

SMALL = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def buckets_of(text):
    words = words_of(text)
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return [zlib.crc32(g.encode()) % 10000 for g in grams]


def plain(docs, target):
    source = Counter(b for _, t in docs for b in buckets_of(t))
    wanted = Counter(b for t in target for b in buckets_of(t))
    S, T = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (S + 10000) / ((source[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        found = buckets_of(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    long = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(long[: 5 * len(long) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def rows_of(frame):
    assert frame.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_the_query_matches_a_plain_version(spark):
    from epigrain.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert rows_of(QUERIES["op13_importance_resampling"](spark, SMALL)) == plain(docs, target)


def test_any_head_gives_the_same_rows(spark, documents):
    draw = random.Random(1)
    some = ["The", "cat", "Été", "x1", "z" * 90, "漢", "a", "\U0001f600b"]
    docs = [(i, draw.choice([" ", ", ", "\n"]).join(draw.choice(some) for _ in range(draw.randint(0, 60)))) for i in range(120)]
    docs += [(None, "the cat " * 20), (7, None), (8, ""), (9, "one"), (9, "one two"), (3, docs[3][1]), (500, "word " * 30000)]
    target = ["the cat", "cat the cat x1", None]
    frame = documents(docs)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    want = plain(docs, target)
    for head, pairs in ((0, 0), (1, 1), (3, 2), (100, 1024)):
        assert rows_of(resampling.resample(frame, goal, head=head, pairs=pairs)) == want


def test_features_of_a_batch_are_those_of_each_text():
    made = resampling.Features([b"a", b"b", b"\xc3\xa9"], 2)
    texts = ["a b é a", None, "", "a", "a b", "q a b r", "A,B!c É"]
    counts, buckets, text = made.of(texts)
    assert counts.tolist() == [len(words_of(t)) for t in texts]
    for i, t in enumerate(texts):
        assert sorted(buckets[text == i].tolist()) == sorted(buckets_of(t))
    assert len(made.of([None, ""])[1]) == 0
    assert np.array_equal(np.sort(resampling.Features([]).of(texts)[1]), np.sort(buckets))


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(documents([]), none).count() == 0
    docs = [(i, f"word{i} " * 25) for i in range(40)]
    assert rows_of(resampling.resample(documents(docs), none)) == plain(docs, [])


def test_equal_rows_take_successive_ranks(spark, documents):
    docs = [(1, "same words here " * 10)] * 60 + [(2, "others " * 30)] * 40
    ranks = sorted(r.rank for r in resampling.resample(documents(docs), documents([(0, "same words")])).collect() if r.rank)
    assert ranks == [1, 2, 3, 4, 5]
