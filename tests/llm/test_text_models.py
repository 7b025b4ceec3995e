import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from epigrain.llm import language, site_quality

SF = "/root/testdata/sf0.01"


def test_language_scores_match_a_plain_version(spark, documents):
    learn = [("en", "The cat is on the mat."), ("en", "this, that"), ("fr", "Le chat est là"), ("de", "Die Katze ist schön"), (None, "zzz"), ("fr", None)]
    frame = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(learn)], "doc_id long, text string, lang string")
    model = language.train(frame)
    assert model.languages == ["de", "en", "fr"]

    def grams(text):
        grams, starts = language.ngrams([text])
        return Counter(int(g) for a in grams for g in a if g < language.BUCKETS)

    counts = {x: sum((grams(t or "") for y, t in learn if y == x), Counter()) for x in model.languages}
    prior = {x: sum(y == x for y, _ in learn) / 5 for x in model.languages}
    for text in ["the chat", "Katze", "schön ist là", "x"]:
        logs = {}
        for x in model.languages:
            total = sum(counts[x].values()) + language.SMOOTHING * language.BUCKETS
            logs[x] = math.log(prior[x]) + sum(n * math.log((counts[x][g] + language.SMOOTHING) / total) for g, n in grams(text).items())
        best = max(sorted(logs), key=logs.get)
        (name,), (score,) = model.score([text])
        assert name == best
        assert score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel=1e-4)
    got = language.predict(documents([(1, None), (2, "12 :-)"), (3, ""), (4, "the mat")]), model)
    assert [(r.lang_pred, r.score == 0) for r in got.orderBy("doc_id").collect()] == [("und", True)] * 3 + [("en", False)]
    assert "kept" in got.columns and got.where("lang = 'en'").count() == 4


def test_a_text_is_scored_alike_in_any_batch():
    texts = ["Ab cd", "", "é", "1", "x " * 300, None]
    for i, t in enumerate(texts):
        grams, starts = language.ngrams([x or "" for x in texts])
        alone, _ = language.ngrams([t or ""])
        ends = [*starts[1:].tolist(), len(grams[0])]
        for a, b in zip(grams, alone):
            together = sorted(x for x in a[starts[i] : ends[i]].tolist() if x < language.BUCKETS)
            assert together == sorted(x for x in b.tolist() if x < language.BUCKETS)


def test_letters_of_every_plane_are_letters(spark, documents):
    model = language.train(spark.createDataFrame([(1, "\U00030000\U000313ab", "zh"), (2, "abc", "en")], "doc_id long, text string, lang string"))
    got = language.predict(documents([(1, "\U00030000"), (2, "\U0001f600")]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["zh", "und"]


def test_columns_with_the_names_of_helpers_stay(spark):
    frame = spark.createDataFrame([(1, "the text", "en", "s", 5, 6, 7)], "doc_id long, text string, lang string, source string, judged int, evidence int, site int")
    got = language.predict(frame, language.train(frame)).first()
    assert (got.judged, got.lang_pred) == (5, "en")
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    judged = site_quality.judge(frame, marks).first()
    assert (judged.evidence, judged.site) == (6, 7)


def test_without_training_rows(spark, documents):
    model = language.train(documents([]))
    assert [r.lang_pred for r in language.predict(documents([(1, "words")]), model).collect()] == ["und"]


def test_held_out_language_accuracy(spark):
    from epigrain.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op5_language_naive_bayes"](spark, SF).where("held_out").join(docs, "doc_id")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count() > 100


def test_held_out_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learn = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    got = site_quality.judge(docs, learn).join(labels.join(learn, "doc_id", "left_anti"), "doc_id")
    bad = F.expr("quality = 0 OR toxic = 1")
    assert got.where(bad & F.col("kept")).count() <= 0.25 * got.where(bad).count()
    assert got.where(~bad & ~F.col("kept")).count() <= 0.05 * got.where(~bad).count()


def test_site_rates_shrink_sparse_sites(spark):
    docs, labels = [], []
    for i in range(2000):
        host = "bad.example" if i % 4 == 0 else "good.example"
        docs.append((i, "text", host, "a"))
        labels.append((i, 0 if host == "bad.example" and i % 8 == 0 else 1, 0))
    docs += [(5000, "text", "tiny.example", "a"), (5001, None, None, None)]
    labels += [(5000, 0, None), (7777, 0, 1), (None, 0, 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rates, overall = site_quality.site_rates(frame, marks, "source", "lang")
    rate = {r.host: r.rate_low for r in rates.collect()}
    assert rate["good.example"] < overall["low"] < rate["bad.example"] and abs(rate["bad.example"] - 0.5) < 0.05
    assert abs(rate["tiny.example"] - overall["low"]) < 0.1
    judged = site_quality.judge(frame, marks)
    assert judged.count() == len(docs) and judged.columns == ["doc_id", "text", "source", "lang", "p_low", "p_toxic", "kept"]


def test_quality_without_labels_or_documents(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in site_quality.judge(documents([(1, None), (2, "a b")]), none).collect()] == [True, True]
    some = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert site_quality.judge(documents([]), some).count() == 0
