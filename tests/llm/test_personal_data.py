import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from epigrain.llm import personal_data as P
from epigrain.llm.sequence_tagger import NEVER, Tagger, allowed

SMALL = "/root/testdata/sf0.001"


def plain_base(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in re.sub("[^0-9]", "", m[0])]
        if 16 <= len(d) <= 19 and (sum(d[::-1][0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[::-1][1::2])) % 10 == 0:
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


@pytest.fixture(scope="module")
def tagger(spark):
    return P.train(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_base_spans_match_the_patterns():
    draw = random.Random(2)
    parts = ["a", "b.c", "@", ".", "@x.de", "1", "23", "255.", "256", "0", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "é", "٣", "+1 (310) 555-4510", "1.2.3.4", "%"]
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert P.base_spans(text) == plain_base(text), text
    digits = "".join(draw.choice("0123456789") for _ in range(60_000))
    assert P.base_spans(digits + ".1.1.1") == [] and P.base_spans("a" * 200_000) == []
    assert P.base_spans("0" * 5000 + "1.2.3.4") == [(1, 0, 5007)]


def test_gradient_is_that_of_the_loss():
    draw = np.random.default_rng(1)
    t = Tagger(6, 2, 3, dtype=np.float64)
    for k in t.p:
        t.p[k] = t.p[k] + draw.normal(0, 0.1, t.p[k].shape)
    classes, tags = draw.integers(0, 6, (7, 4)), np.zeros((7, 4), int)
    classes[2:4, 0], tags[2:4, 0], classes[3, 2], tags[3, 2] = [1, 2], [1, 2], 4, 3
    _, g = t.loss_and_gradient(classes, tags)
    for k, p in t.p.items():
        for at in itertools.islice(np.ndindex(p.shape), 40):
            kept, e = p[at], 1e-6
            p[at] = kept + e
            up = t.loss_and_gradient(classes, tags)[0]
            p[at] = kept - e
            down = t.loss_and_gradient(classes, tags)[0]
            p[at] = kept
            assert g[k][at] == pytest.approx((up - down) / (2 * e), abs=1e-5)


def path_score(t, e, path):
    s = t.steps()
    return sum(e[i, y] + s[x, y] for i, (x, y) in enumerate(zip((0, *path), path)))


def test_decoding_finds_the_best_path_and_the_bound_holds():
    draw = np.random.default_rng(3)
    t = Tagger(5, 2, 2, dtype=np.float64)
    t.p["step"] = draw.normal(0, 1, t.p["step"].shape)
    assert not allowed(2)[0, 2] and allowed(2)[1, 2] and not allowed(2)[1, 4]
    for _ in range(60):
        e = draw.normal(0, 2, (5, 1, 5)) - np.array([0, 1, 1, 1, 1]) * draw.integers(0, 6)
        got = t.decode(e)[:, 0].tolist()
        best = max(itertools.product(range(5), repeat=5), key=lambda p: path_score(t, e[:, 0], p))
        assert path_score(t, e[:, 0], got) == pytest.approx(path_score(t, e[:, 0], best))
        assert path_score(t, e[:, 0], got) > NEVER
        if not t.may_hold_spans(e).any():
            assert path_score(t, e[:, 0], best) == pytest.approx(path_score(t, e[:, 0], [0] * 5))


def test_windows_cover_a_text_and_overlap():
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 959, 960, 961, 5000):
        found = P.windows_of(n)
        assert [a for a, _ in found] == [k * (P.WINDOW - P.OVERLAP) for k in range(len(found))]
        assert sorted(set(x for a, b in found for x in range(a, b))) == list(range(n))
        assert all(b - a == P.WINDOW for a, b in found[:-1])
    places, rows = P.placed([(0, a, b) for a, b in P.windows_of(5000)] + [(1, 0, 9)] * 200)
    used = set()
    for (r, c), (a, b) in zip(places, P.windows_of(5000) + [(0, 9)] * 200):
        assert r < rows and c + b - a <= P.WINDOW
        cells = {(r, x) for x in range(c, c + b - a + 1)}
        assert not cells & used
        used |= cells


def test_the_best_set_is_that_of_all_subsets():
    draw = random.Random(4)
    for _ in range(200):
        spans = [(draw.randrange(2), a := draw.randrange(12), a + draw.randint(1, 6), float(draw.randint(1, 9))) for _ in range(7)]

        def apart(some):
            return all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(some, 2))

        most = max(sum(s[3] for s in some) for n in range(8) for some in itertools.combinations(spans, n) if apart(some))
        got = P.best_set(spans)
        assert apart(got) and sum(s[3] for s in got) == pytest.approx(most) and set(got) <= set(spans)


def test_a_text_is_tagged_alike_in_any_batch(tagger):
    texts = ["write to jane.roe (at) example (dot) com now", "", "word " * 700 + "call (310) 555-4510 soon " + "word " * 300, "x", "1.2.3[.]4 " * 90]
    alone = [P.added_spans(tagger, [t], [[]])[0] for t in texts]
    assert P.added_spans(tagger, texts * 3, [[]] * 15) == alone * 3
    assert any(alone)


def test_unusual_forms_are_found_and_others_left_alone(tagger):
    draw = random.Random(11)
    words = [w for t in ["the thing that was on in and reading thoned for other under and tion"] for w in t.split()]
    hit = all_ = wrong = 0
    for k in range(300):
        kind = k % 4
        span = P.written_span(draw, kind, lambda: draw.choice(words))
        left, right = (" ".join(draw.choice(words) for _ in range(40)) + " " for _ in range(2))
        text = f"{left}{span} {right}"
        base = P.base_spans(text)
        if base:
            continue
        added = P.added_spans(tagger, [text], [base])[0]
        all_ += 1
        hit += (kind, len(left), len(left) + len(span)) in added
        wrong += any(not (a < len(left) + len(span) and len(left) < b) for _, a, b in added)
    assert all_ > 80 and hit >= 0.5 * all_ and wrong <= 0.02 * all_
    clean = [" ".join(draw.choice(words) for _ in range(200)) + f" {draw.randrange(10**6)} 2024-01-31 12:30:55" for _ in range(100)]
    assert [t[a:b] for t, found in zip(clean, P.added_spans(tagger, clean, [[]] * 100)) for _, a, b in found] == []


def test_the_query_keeps_base_spans_and_is_whole(spark):
    from epigrain.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op11_personal_data"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base = plain_base(d.text or "")
        row = got[d.doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        names = [f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert row.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(row.spans.split(",")) or not names


def test_nulls_long_texts_and_repeated_rows(spark, documents, tagger):
    long = "word " * 40_000 + "a@b.cd " + "x" * 100_000
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (3, long), (3, long), (4, "漢字 +1 (310) 555-4510 é")]
    out = P.find(documents(rows), tagger)
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = sorted((r.doc_id or 0, r.spans) for r in out.collect())
    assert got == [(0, "email:0:6"), (1, ""), (2, ""), (3, "email:200000:200006"), (3, "email:200000:200006"), (4, "phone:3:20")]
    assert P.find(documents([]), tagger).count() == 0
    assert P.train(documents([(1, None), (2, " ")])) is None
    assert P.find(documents(rows[:3]), None).count() == 3
