import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epigrain.functions.alphabet import AMINO_ACIDS
from epigrain.operators import communities, network


def enumerate_edges(peptides):
    """Definition: try every edit of every peptide, keep the first one that gives a member."""
    members, out = set(peptides), {}
    for s in peptides:
        for p in range(1, len(s) + 1):
            for a in AMINO_ACIDS:
                t = s[: p - 1] + a + s[p:]
                if t in members and t != s:
                    out.setdefault((s, t, "Substitution"), f"{s[p - 1]}_{p}_{a}")
                t = s[: p - 1] + a + s[p - 1 :]
                if t in members:
                    out.setdefault((s, t, "Insertion"), f"-_{p}_{a}")
            t = s[: p - 1] + s[p:]
            if t in members:
                out.setdefault((s, t, "Deletion"), f"{s[p - 1]}_{p}_-")
    return out


@pytest.mark.parametrize("letters,seed", [("AC", 1), ("ACDX", 2), ("AWY", 3)])
def test_pairs_match_enumeration(spark, peptide_frame, letters, seed):
    rng = random.Random(seed)
    peptides = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([2, 3, 4, 6]))) for _ in range(120)})
    rows = network.neighbor_pairs(peptide_frame(peptides)).collect()
    got = {(r["aaseq1"], r["aaseq2"], r["mut_pattern"]): r["mut_type"] for r in rows}
    assert len(rows) == len(got) and got == enumerate_edges(peptides)


def test_single_length_has_no_indels(peptide_frame):
    rows = network.neighbor_pairs(peptide_frame(["ACD", "ACE", "WWW"])).collect()
    assert {r["mut_pattern"] for r in rows} == {"Substitution"} and len(rows) == 2


def test_unknown_symbol_is_reported(peptide_frame):
    with pytest.raises(Exception, match="sequences may hold"):
        network.neighbor_pairs(peptide_frame(["AC?", "ACD"])).collect()


def scored(spark, values):
    return spark.createDataFrame(list(values.items()), "peptide string, score double")


def test_weights_ties_and_clamp(spark):
    scores = scored(spark, {"AAA": 1.0, "AAC": 1.0, "AAD": 5000.0, "AAE": 0.0})
    edges = network.neighbor_weighted(network.neighbor_pairs(scores.select("peptide")), scores).collect()
    by_pair = {(e["aaseq1"], e["aaseq2"]): e for e in edges}
    assert ("AAA", "AAC") in by_pair and ("AAC", "AAA") in by_pair
    assert by_pair["AAA", "AAD"]["edge_weight"] == 0.001 and by_pair["AAA", "AAD"]["score_ratio"] == 5000.0
    assert ("AAD", "AAA") not in by_pair
    assert by_pair["AAE", "AAA"]["score_ratio"] == math.inf and by_pair["AAE", "AAA"]["edge_weight"] == 0.001


def test_ego_graphs(spark):
    scores = scored(spark, {"AAA": 1.0, "AAC": 2.0, "ADC": 3.0, "WDC": 4.0, "AAAA": 9.0})
    edges = network.neighbor_weighted(network.neighbor_pairs(scores.select("peptide")), scores)
    members = {}
    for r in network.ego_members(edges).collect():
        members.setdefault(r["target"], set()).add(r["node"])
    assert members["AAC"] == {"AAC", "AAA", "ADC"} and members["WDC"] == {"WDC", "ADC"}
    kept = {(r["target"], r["aaseq1"], r["aaseq2"]) for r in network.ego_edges(edges).collect()}
    want = {
        (t, e["aaseq1"], e["aaseq2"])
        for e in edges.collect()
        for t, m in members.items()
        if e["aaseq1"] in m and e["aaseq2"] in m
    }
    assert kept == want
    only = network.ego_edges(edges, spark.createDataFrame([("WDC",)], "peptide string"))
    assert {r["target"] for r in only.collect()} == {"WDC"}
    incoming = [r for r in network.ego_pairs(edges).collect() if r["target"] == "AAC" and not r["outgoing"]]
    assert incoming and all(r["score_ratio"] == r["score1"] / r["score2"] for r in incoming)
    deletion = [r for r in network.ego_pairs(edges).collect() if r["mut_pattern"] == "Insertion"]
    assert deletion and all(r["aa1"] == "-" for r in deletion)


def test_walks_separate_two_cliques():
    w = np.zeros((8, 8))
    w[:4, :4] = w[4:, 4:] = 1
    np.fill_diagonal(w, 0)
    w[3, 4] = w[4, 3] = 1
    assert communities.walk_communities(w).tolist() == [0, 0, 0, 0, 1, 1, 1, 1]
    assert communities.walk_communities(np.zeros((1, 1))).tolist() == [0]


def test_clusters_and_escape_potential(spark):
    scores = scored(spark, {"AAA": 0.2, "AAC": 0.4, "AAD": 0.9})
    edges = network.neighbor_weighted(network.neighbor_pairs(scores.select("peptide")), scores)
    summary = communities.ego_clusters(edges, scores)
    assert summary.where("role = 'Target'").count() == 3 and summary.count() == 9
    out = {r["peptide"]: r for r in communities.escape_potential(summary, "score").collect()}
    assert out["AAA"]["cluster_diff_min"] == -math.inf and out["AAA"]["cluster_diff_max"] == -math.inf
    assert out["AAA"]["diff_max"] == pytest.approx(0.7) and out["AAD"]["diff_min"] == pytest.approx(0.7)


def test_escape_potential_with_two_clusters(spark):
    rows = [("T", "T", "Target", "C1", 0.5), ("T", "a", "Neighbor", "C1", 0.7), ("T", "b", "Neighbor", "C2", 0.1),
            ("T", "c", "Neighbor", "C3", 0.9)]
    summary = spark.createDataFrame(rows, "target string, peptide string, role string, cluster_id string, score double")
    r = communities.escape_potential(summary, "score").first()
    assert r["cluster_id"] == "C1" and r["cluster_average"] == pytest.approx(0.6)
    assert r["cluster_diff_max"] == pytest.approx(0.3) and r["cluster_diff_min"] == pytest.approx(0.5)


def test_consensus(spark):
    rows = [("k", "ACD"), ("k", "ACE"), ("k", "AWF"), ("k", "AWG"), ("s", "WYW")]
    members = spark.createDataFrame(rows, "cluster_id string, peptide string")
    got = {r["cluster_id"]: r["consensus"] for r in communities.cluster_consensus(members).collect()}
    assert got == {"k": "AXX", "s": "WYW"}


def alignment(member, target):
    """Pairs (member residue or -, target position or None) of the cheapest alignment, differences as late as they can be."""
    n, m = len(member), len(target)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (member[i - 1] != target[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    assert cost[n][m] <= 1
    out, i, j = [], n, m
    while i or j:
        if i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((member[i], None, j))
        elif j and cost[i][j] == cost[i][j - 1] + 1:
            j -= 1
            out.append(("-", j, None))
        else:
            i, j = i - 1, j - 1
            out.append((member[i], j, None))
    return out


def test_consensus_of_unequal_lengths_matches_dynamic_programming(spark):
    import random
    from collections import Counter

    draw = random.Random(9)
    rows, want = [], {}
    for k in range(60):
        target = "".join(draw.choice("ACD") for _ in range(draw.randint(3, 8)))
        members = [target] if k % 3 else []
        for _ in range(draw.randint(1, 7)):
            i, a = draw.randrange(len(target)), draw.choice("ACD")
            members.append(draw.choice([target[:i] + a + target[i + 1 :], target[:i] + a + target[i:], target[:i] + target[i + 1 :], target + a]))
        rows += [(k, target, m) for m in members]
        columns = {2 * j + 2: Counter() for j in range(len(target))}
        for m in members:
            for residue, j, after in alignment(m, target):
                columns.setdefault(2 * j + 2 if after is None else 2 * after + 1, Counter())[residue] += 1
        text = ""
        for c in sorted(columns):
            counts = Counter({r: n for r, n in columns[c].items()})
            counts["-"] = len(members) - sum(n for r, n in counts.items() if r != "-")
            many = [r for r, n in counts.items() if n and 2 * n >= len(members)]
            text += many[0] if len(many) == 1 and many[0] != "-" else "X"
        want[k] = (len(members), text)
    frame = spark.createDataFrame(rows, "cluster_id int, target string, peptide string")
    got = {r.cluster_id: (r.size, r.consensus) for r in communities.aligned_consensus(frame, ["cluster_id"]).collect()}
    assert got == want
    assert communities.aligned_consensus(frame.limit(0), ["cluster_id"]).count() == 0
    with pytest.raises(Exception, match="no single edit"):
        communities.aligned_consensus(spark.createDataFrame([("ACDEF", "AC")], "target string, peptide string")).collect()


def test_prioritize_order(spark):
    scores = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.1)], "peptide string, immunogenicity_score double")
    features = spark.createDataFrame(
        [("a", 0.5, 0.3), ("b", 0.5, 0.1), ("c", 0.9, 0.0)], "peptide string, cluster_average double, cluster_diff_min double"
    )
    originals = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "peptide string")
    assert [r["peptide"] for r in communities.prioritize(scores, features, originals).collect()] == ["b", "a", "c"]


def test_isolated(spark, peptide_frame):
    peptides = peptide_frame(["AAA", "AAC", "WWWWW"])
    edges = network.neighbor_pairs(peptides)
    assert communities.isolated_count(peptides, edges.select(F.col("aaseq1"), F.col("aaseq2"))).first()[0] == 1


def test_equal_ego_graphs_are_cut_once_and_in_whole_whatever_the_batches(monkeypatch):
    edges = [(t, t, t + x, 1.0) for t in ("AAAA", "CCCC", "DDDD") for x in "EF"] + [(t, t + "E", t + "F", 1.0) for t in ("AAAA", "CCCC", "DDDD")]
    rows = pa.Table.from_pylist([dict(zip(("target", "aaseq1", "aaseq2", "weight"), e)) for e in sorted(edges)])
    cuts = []
    monkeypatch.setattr(communities, "walk_communities", lambda w, cut=communities.walk_communities: cuts.append(w) or cut(w))
    got = pa.Table.from_batches(communities._cluster_egos(iter(rows.to_batches(max_chunksize=2)))).to_pylist()
    assert len(cuts) == 1
    assert [(r["target"], r["peptide"], r["role"], r["cluster_id"]) for r in got] == [
        (t, t + x, "Neighbor" if x else "Target", "Cluster1") for t in ("AAAA", "CCCC", "DDDD") for x in ("", "E", "F")
    ]
