import random

import numpy as np

from epigrain.llm import decontamination as dc


def brute_tiles(item, doc, least):
    """Marks the longest common unmarked run, first in the item and then in the document, until none is long enough."""
    a, b, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and a[i + n] and b[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        a[i : i + n], b[j : j + n] = [False] * n, [False] * n
        out.append((i, 0, j, n))


def test_tiles_match_brute_force():
    draw = random.Random(3)
    for _ in range(150):
        item = [draw.randrange(5) for _ in range(draw.randint(0, 25))]
        doc = [draw.randrange(5) for _ in range(draw.randint(0, 40))]
        got = dc.tiles(np.array(item, np.uint64), [np.array(doc, np.uint64)], 3)
        assert sum(t[3] for t in got) == sum(t[3] for t in brute_tiles(item, doc, 3))
        for i, _, j, n in got:
            assert item[i : i + n] == doc[j : j + n]


def test_planted_passages(spark, documents):
    draw = random.Random(9)
    words = [f"word{i}" for i in range(500)]

    def prose(n):
        return " ".join(draw.choice(words) for _ in range(n))

    items = [(i, prose(40)) for i in range(30)] + [(90, "too few words"), (91, None), (92, "")]
    mixed = items[3][1].split()
    texts = {
        1: prose(300),
        2: prose(100) + " " + items[0][1].upper() + ", " + prose(100),
        3: " ".join(mixed[25:]) + " " + prose(60) + " " + " ".join(mixed[:25]),
        4: " ".join(items[5][1].split()[:12]) + " " + prose(50),
        5: None, 6: "", 7: "too few words", 8: prose(20_000) + " " + items[7][1],
    }
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, row int")
    docs = documents([*texts.items(), (4, prose(30)), (None, items[9][1])])
    got = dc.judge(docs, bench)
    bad = {r.doc_id: (r.item_id, r.matched_words, r.item_words) for r in got.where("contaminated").collect()}
    assert bad == {2: (0, 40, 40), 3: (3, 40, 40), 8: (7, 40, 40), None: (9, 40, 40)}
    assert got.count() == 10 and got.where("kept").count() == 6
    assert sorted(r.doc_id for r in dc.clean(docs, bench).collect()) == [1, 4, 4, 5, 6, 7]
    assert dc.clean(docs, bench).columns == docs.columns
    assert dc.judge(docs, bench.limit(0)).where("kept").count() == 10
    assert dc.judge(documents([]), bench).count() == 0


def test_an_item_that_repeats_itself(spark, documents):
    refrain = " ".join(f"line{i}" for i in range(10))
    items = [(1, " ".join([refrain] * 20)), (2, "ha " * 300)]
    texts = {1: f"before it {items[0][1]} and after", 2: items[1][1] + "ho", 3: f"once only {refrain} and no more", 4: "ha " * 100 + "ho"}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.judge(documents(texts.items()), bench)
    bad = {r.doc_id: (r.item_id, r.matched_words, r.item_words) for r in got.where("contaminated").collect()}
    assert bad == {1: (1, 200, 200), 2: (2, 300, 300)}


def test_tiles_laid_out_in_parts(monkeypatch):
    draw = random.Random(4)
    cases = [([draw.randrange(3) for _ in range(40)], [draw.randrange(3) for _ in range(60)]) for _ in range(40)]

    def all_tiles():
        return [dc.tiles(np.array(a, np.uint64), [np.array(b, np.uint64)], 3) for a, b in cases]

    whole = all_tiles()
    monkeypatch.setattr(dc, "MATCHES", 7)
    assert all_tiles() == whole


def test_words_of_all_scripts(spark, documents):
    chinese, thai = "北京是中华人民共和国的首都，人口众多。", "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"
    dashed = "the well known author—born in “Lisbon”—wrote seven long novels"
    items = [(1, chinese), (2, thai), (3, dashed)]
    texts = {
        1: "前言" + chinese + "后记", 2: "ก่อน" + thai, 3: dashed.replace("—", " - ").replace("“", '"').replace("”", '"'),
        4: "上海很大", 5: "北京是很大的城市",
    }
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.judge(documents(texts.items()), bench)
    assert {r.doc_id: r.item_id for r in got.where("contaminated").collect()} == {1: 1, 2: 2, 3: 3}
    assert got.count() == 5


def test_a_clean_row_stays_whatever_its_id(spark):
    passage = " ".join(f"asked{i}" for i in range(30))
    docs = [(None, passage), (None, "quite another text"), (7, "x " + passage), (7, "a clean one"), (8, None), (8, "")]
    frame = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in docs], "doc_id long, text string, _bad string, place int, value int")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = dc.clean(frame, items)
    assert got.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([d for d in docs if not d[1] or "asked" not in d[1]], key=repr)
