import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from epigrain.llm import spelling

SMALL = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, least_length=7, slip_every=31):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if slip_every and h % slip_every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            seen[word] += 1
    return {w: n for w, n in seen.items() if n >= 2 and len(w) >= least_length}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=10):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def got(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_the_query_matches_all_pairs(spark):
    from epigrain.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_variants(plain_counts(rows))
    result = QUERIES["op12_spelling_variants"](spark, SMALL)
    assert result.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert result.count() == len(want) and got(result) == want
    assert any(r[1] for r in want) and any(r[4] > 1 for r in want)


def test_random_words_of_few_letters(spark):
    draw = random.Random(3)
    counts = {"".join(draw.choice("abé") for _ in range(draw.randint(1, 6))): draw.choice([1, 1, 2, 10, 30, 100, 1000, 1000]) for _ in range(500)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)
    assert got(spelling.variants(frame)) == plain_variants(counts)


def test_chains_are_followed_and_ties_go_to_the_first_word(spark):
    counts = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "aaabbbb": 10000, "bbbbbbb": 5, "bbbbbb": 50, "bbbbbbc": 50}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = {r.word: r for r in spelling.variants(frame).collect()}
    assert rows["aaaaaaa"].root == "aaabbbb" and rows["bbbbbbb"].form == "bbbbbb" and rows["bbbbbbb"].form_n == 50
    assert got(spelling.variants(frame)) == plain_variants(counts)


def test_words_of_texts_with_nulls_long_words_and_signs(spark, documents):
    long = "xy" * 30_000
    rows = [(1, None), (2, ""), (None, "Straßenbahn Écolees"), (3, f"straßenbahn {long} {long[:-1]}"), (4, f"{long},{long[:-1]}"), (4, "×÷×÷abcĀabcdefgh"), (4, "×÷×÷abc abcdefgh"), (5, "Écolees")]
    frame = documents(rows)
    counts = {r.word: r.n for r in spelling.word_counts(frame, slip_every=31).collect()}
    assert counts == plain_counts(rows)
    plain = {r.word: r.n for r in spelling.word_counts(frame).collect()}
    assert plain == plain_counts(rows, slip_every=None) and long in plain
    near = {r.word: r.n_near for r in spelling.variants(spelling.word_counts(frame)).collect()}
    assert near[long] == near[long[:-1]] == 1


def test_an_empty_table(spark, documents):
    assert spelling.variants(spelling.word_counts(documents([]))).count() == 0


def test_paths_number_each_prefix_once(spark):
    draw = random.Random(5)
    words = {"".join(draw.choice("abc") for _ in range(draw.randint(1, 9))) for _ in range(3000)}
    frame = spark.createDataFrame([(w,) for w in words], "word string").repartition(5)
    rows = spelling.trie_paths(frame).orderBy(F.col("word")).collect()
    assert [r.id for r in rows] == list(range(len(words))) and [r.word for r in rows] == sorted(words)
    number = {}
    for r in rows:
        for i, node in enumerate(r.path):
            assert number.setdefault(r.word[: i + 1], node) == node
    assert len(set(number.values())) == len(number) and max(number.values()) == len(number)
