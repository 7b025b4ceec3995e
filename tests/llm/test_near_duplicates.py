import random
import re

import pytest

from epigrain.llm import near_duplicates as nd
from epigrain.llm import components
from epigrain.llm.components import connected_components


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        first = min(ids) if ids else None
        out.append((doc_id, len(sets[i]), first, doc_id == first))
    return sorted(out, key=repr)


def corpus(seed, families, copies, edits):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(families):
        base = [draw.choice(words) for _ in range(draw.choice([3, 12, 60, 150]))]
        for _ in range(draw.randint(1, copies)):
            text = list(base)
            for _ in range(draw.randint(0, edits)):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append((len(rows) * 7 % 10007, " ".join(text).upper() if draw.random() < 0.1 else " ".join(text)))
    return rows


@pytest.mark.parametrize("width,seed", [(4, 1), (5, 2)])
def test_components_match_brute_force(documents, width, seed):
    rows = corpus(seed, 40, 12, 9)
    rows += [(20001, None), (20002, ""), (20003, " \n\t"), (5, rows[0][1]), (None, rows[0][1]), (None, "alone here"), (20004, "one two"), (20005, "One TWO")]
    got = sorted((tuple(r) for r in nd.components(documents(rows), width, 0.8).collect()), key=repr)
    assert got == brute(rows, width, 80)


def test_a_crowded_region_over_several_tasks(documents, monkeypatch):
    """One family of variants that mostly agree below the similarity, tasks of few rows, few neighbours: still exact."""
    monkeypatch.setattr(nd, "TASK_ROWS", 700)
    monkeypatch.setattr(nd, "NEIGHBOURS", 2)
    monkeypatch.setattr(nd, "BLOCK", 40)
    monkeypatch.setattr(nd, "BOTTOM", 100)
    draw = random.Random(5)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(draw.randint(1, 8)):
            text[draw.randrange(150)] = f"x{draw.random()}"
        rows.append((i, " ".join(text)))
    got = sorted((tuple(r) for r in nd.components(documents(rows), 4, 0.8).collect()), key=repr)
    assert got == brute(rows, 4, 80)


def test_empty_table(documents):
    assert nd.components(documents([]), 4).count() == 0


@pytest.mark.parametrize("most", [0, 1000])
def test_connected_components_of_a_chain_and_a_star(spark, monkeypatch, most):
    monkeypatch.setattr(components, "TASK_LINKS", most)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_a_similarity_below_the_forests_is_refused(documents):
    import pytest

    with pytest.raises(ValueError):
        nd.components(documents([(1, "a b c d e f")]), similarity=0.5)
