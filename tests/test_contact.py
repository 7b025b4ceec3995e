import random

import numpy as np
import pyarrow as pa
import pytest

from epigrain.functions.alphabet import AMINO_ACIDS
from epigrain.functions.names import CPP_STATS, FeatureName
from epigrain.operators import contact_profile as cp
from epigrain.operators import fragments, single_receptor
from epigrain.sources import contact_scales


def brute_score(peptide, fragment, matrix):
    w = len(fragment)
    return max(
        sum(matrix[AMINO_ACIDS.index(f), AMINO_ACIDS.index(peptide[o + j])] for j, f in enumerate(fragment))
        for o in range(len(peptide) - w + 1)
    )


def test_score_golden():
    m = np.zeros((20, 20))
    for (a, b), v in {("C", "A"): 0.1, ("D", "C"): 0.2, ("C", "C"): 0.9, ("D", "D"): 0.7}.items():
        m[AMINO_ACIDS.index(a), AMINO_ACIDS.index(b)] = v
    got = cp.gapless_scores(cp.encode("ACD")[None, :], cp.encode("CD")[None, :], m)
    assert got[0, 0] == pytest.approx(1.6)


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 8])
def test_scores_match_brute_force(width):
    rng = random.Random(width)
    m = np.random.default_rng(1).random((20, 20))
    peptides = ["".join(rng.choice(AMINO_ACIDS) for _ in range(9)) for _ in range(6)]
    frags = ["".join(rng.choice(AMINO_ACIDS) for _ in range(width)) for _ in range(15)]
    got = cp.gapless_scores(np.stack([cp.encode(p) for p in peptides]), np.stack([cp.encode(f) for f in frags]), m)
    assert got == pytest.approx(np.array([[brute_score(p, f, m) for f in frags] for p in peptides]))


def affine_global_local(peptide, fragment, matrix, gap_open=100.0, gap_extend=100.0):
    """Whole fragment against any stretch of the peptide, affine gaps, by dynamic programming."""
    ninf = -1e18
    n, m = len(fragment), len(peptide)
    best = [[0.0] * (m + 1)] + [[ninf] * (m + 1) for _ in range(n)]
    up = [[ninf] * (m + 1) for _ in range(n + 1)]
    left = [[ninf] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(m + 1):
            up[i][j] = max(best[i - 1][j] - gap_open - gap_extend, up[i - 1][j] - gap_extend)
            if j:
                left[i][j] = max(best[i][j - 1] - gap_open - gap_extend, left[i][j - 1] - gap_extend)
                match = best[i - 1][j - 1] + matrix[AMINO_ACIDS.index(fragment[i - 1]), AMINO_ACIDS.index(peptide[j - 1])]
            else:
                match = ninf
            best[i][j] = max(match, up[i][j], left[i][j])
    return max(best[n])


def test_gap_free_equals_affine_alignment():
    rng = random.Random(5)
    m = np.random.default_rng(2).random((20, 20))
    for _ in range(100):
        p = "".join(rng.choice(AMINO_ACIDS) for _ in range(rng.randint(8, 11)))
        f = "".join(rng.choice(AMINO_ACIDS) for _ in range(rng.randint(3, 8)))
        assert affine_global_local(p, f, m) == pytest.approx(brute_score(p, f, m))


@pytest.fixture(scope="module")
def setting(spark):
    rng = random.Random(9)
    peptides = ["".join(rng.choice(AMINO_ACIDS) for _ in range(rng.randint(3, 6))) for _ in range(7)]
    rows = [
        (lib, n, seed, i, "".join(rng.choice(AMINO_ACIDS) for _ in range(n)))
        for lib in ("Deduplicated", "Weighted")
        for n in (3, 4)
        for seed in (1, 2)
        for i in range(1, 31)
    ]
    library = spark.createDataFrame(rows, "library string, frag_len int, seed int, id long, fragment string")
    scales = contact_scales.contact_matrices(contact_scales.rule_scale(spark))
    return spark.createDataFrame([(p,) for p in peptides], "peptide string").distinct(), library, scales


def as_dict(df, keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


KEYS = ("peptide", "aaindex_id", "frag_len", "library", "seed")


def test_stats_match_brute_force(setting):
    peptides, library, scales = setting
    stats = as_dict(cp.cpp_stats(peptides, library, scales, depth=20, frag_lens=(3, 4)), KEYS)
    sample = cp.library_sample(library, 20).collect()
    matrices = cp.scale_matrices(scales)
    assert len({(r["library"], r["frag_len"], r["seed"], r["id"]) for r in sample}) == 8 * 20
    seen = 0
    for (peptide, scale, n, lib, seed), row in stats.items():
        frags = [r["fragment"] for r in sample if (r["library"], r["frag_len"], r["seed"]) == (lib, n, seed)]
        x = np.array([[brute_score(peptide, f, matrices[scale]) for f in frags]])
        want = dict(zip(CPP_STATS, cp.describe_rows(x)[0]))
        assert all(row[s] == pytest.approx(v) for s, v in want.items() if not np.isnan(v))
        seen += 1
    short = sum(len(r["peptide"]) < 4 for r in peptides.collect())
    assert seen == peptides.count() * 2 * 2 * 2 * 2 - short * 2 * 2 * 2


def test_scores_equal_up_to_rounding_are_constant(spark):
    """Fragments that permute the same residues score alike on a uniform peptide, in another order of addition."""
    scales = spark.createDataFrame(
        [("S", a, b, {"A": 0.1, "C": 0.2, "D": 0.3}.get(b, 0.0)) for a in "ACDEFGHIKLMNPQRSTVWY" for b in "ACDEFGHIKLMNPQRSTVWY"],
        "aaindex_id string, aa1 string, aa2 string, value double",
    )
    fragments_ = ["ACD", "ADC", "CAD", "CDA", "DAC", "DCA"]
    library = spark.createDataFrame(
        [("Mock", 3, 1, i, f) for i, f in enumerate(fragments_)], "library string, frag_len int, seed int, id long, fragment string"
    )
    peptide = spark.createDataFrame([("GGGGGGGG",)], "peptide string")
    row = cp.cpp_stats(peptide, library, scales, depth=6, frag_lens=(3,)).where("aaindex_id = 'S'").first()
    assert row["SD"] == 0.0 and row["Skew"] is None and row["Kurt"] is None


def test_wide_batches_are_cut(setting, monkeypatch):
    peptides, library, scales = setting
    whole = as_dict(cp.cpp_features(peptides, library, scales, depth=20, frag_lens=(3, 4)), ("peptide", "library"))
    monkeypatch.setattr(cp, "CELLS", 60)
    cut = as_dict(cp.cpp_features(peptides, library, scales, depth=20, frag_lens=(3, 4)), ("peptide", "library"))
    assert whole == cut


def test_seeds_are_resumed(setting, tmp_path, monkeypatch):
    peptides, library, scales = setting
    options = dict(depth=20, frag_lens=(3, 4))
    whole = as_dict(cp.cpp_features(peptides, library, scales, **options), ("peptide", "library"))
    scored = []
    plain = cp.cpp_features
    monkeypatch.setattr(cp, "cpp_features", lambda *a, seeds, **o: scored.append(seeds) or plain(*a, seeds=seeds, **o))
    first = cp.cpp_features_resumed(peptides, library, scales, str(tmp_path), [1], **options)
    assert scored == [[1]] and first.count() == len(whole)
    both = cp.cpp_features_resumed(peptides, library, scales, str(tmp_path), [1, 2], **options)
    assert scored == [[1], [2]]
    got = as_dict(both, ("peptide", "library"))
    assert set(got) == set(whole) and both.columns == list(next(iter(whole.values())).asDict())
    for key, row in whole.items():
        assert [got[key][c] for c in both.columns[3:]] == pytest.approx([row[c] for c in both.columns[3:]], nan_ok=True)
    cp.cpp_features_resumed(peptides.limit(2), library, scales, str(tmp_path), [1], **options)
    cp.cpp_features_resumed(peptides, library, scales, str(tmp_path), [1], depth=10, frag_lens=(3, 4))
    assert scored == [[1], [2], [1], [1]]


def test_feature_list_prunes(setting):
    peptides, library, scales = setting
    wide = cp.cpp_features(peptides, library, scales, depth=10, feature_set=["CPP_SYN01_Mean_3", "Peptide_Length"])
    assert wide.columns == ["peptide", "frag_depth", "library", "CPP_SYN01_Mean_3"]
    assert cp.parameter_pairs(["CPP_X_Mean_3", "CPP_X_SD_3", "PeptDesc_Z1_Min_4"]) == [("X", 3)]
    assert cp.expand_scale_ids(["A", "Binv"], ["A", "Ainv", "B", "Binv"]) == ["A", "Ainv", "Binv"]


def test_feature_names():
    name = FeatureName.decode("CPP_SYN01inv_Q10_8")
    assert name.encode() == "CPP_SYN01inv_Q10_8" and name.frag_len == 8
    assert FeatureName.decode("Peptide_Length") is None


def test_matrices_mirror_rescale_and_literal_na(spark, tmp_path):
    path = tmp_path / "scales.csv"
    path.write_text("AAIndexID,Description,PMID,Author,Title,Reference,AA,AN,NN\nS1,d,1,a,t,r,1,3,5\n")
    rows = {(r["aaindex_id"], r["aa1"], r["aa2"]): r["value"] for r in
            contact_scales.read_contact_matrices(spark, str(path)).collect()}
    assert rows["S1", "A", "N"] == rows["S1", "N", "A"] == 0.5 and rows["S1", "N", "N"] == 1.0
    assert rows["S1inv", "N", "N"] == 0.0 and rows["S1inv", "A", "A"] == 1.0
    path.write_text("AAIndexID,Description,PMID,Author,Title,Reference,AA,NA\nS1,NA,NA,NA,NA,NA,1,2\n")
    assert contact_scales.read_pair_table(spark, str(path)).where("pair = 'NA' and value = 2").count() == 1


def test_fragment_frequencies(spark):
    sequences = ["CASSL", "AAA", "CASSL", "AC"]
    df = spark.createDataFrame([(s,) for s in sequences], "cdr3b string")
    want = {}
    for s in sequences:
        for n in (2, 3):
            for i in range(len(s) - n + 1):
                for f in (s[i : i + n], s[i : i + n][::-1]):
                    want[n, f] = want.get((n, f), 0) + 1
    rows = fragments.fragment_freq(df, "cdr3b", (2, 3)).collect()
    assert {(r["frag_len"], r["fragment"]): r["count"] for r in rows} == want
    for n in (2, 3):
        assert sum(r["freq"] for r in rows if r["frag_len"] == n) == pytest.approx(1.0)


def test_fragment_library(spark):
    # One window holds most of the mass, so it owns most of the cumulative range.
    df = spark.createDataFrame([("AAAA",)] * 90 + [("CDEF",)] * 10, "cdr3b string")
    lib = fragments.fragment_library(df, "cdr3b", (3,), depth=400, seeds=(1, 2)).cache()
    counts = {r["library"]: r["count"] for r in lib.groupBy("library").count().collect()}
    assert counts == {"Deduplicated": 800, "Weighted": 800, "Mock": 800}
    share = {r["library"]: r["s"] for r in lib.groupBy("library").agg({"fragment": "count"}).selectExpr(
        "library", "`count(fragment)` as s").collect()}
    assert share["Weighted"] == 800
    weighted = lib.where("library = 'Weighted' and fragment = 'AAA'").count() / 800
    uniform = lib.where("library = 'Deduplicated' and fragment = 'AAA'").count() / 800
    assert weighted == pytest.approx(0.9, abs=0.05) and uniform == pytest.approx(0.2, abs=0.06)
    assert lib.where("library = 'Mock' and length(fragment) = 3").count() == 800
    wide = fragments.library_wide(lib, ("Mock", "Weighted"), (3,), (1, 2))
    assert wide.count() == 400 and set(wide.columns) == {"id", "Mock_3_1", "Mock_3_2", "Weighted_3_1", "Weighted_3_2"}
    assert fragments.library_sample(lib, 25).groupBy("library", "seed").count().where("count <> 25").count() == 0


def test_single_receptor(spark, setting):
    _, _, scales = setting
    matrices = cp.scale_matrices(scales)
    pairs = spark.createDataFrame([("ACDEFGHI", "CASSLGQYF"), ("ACDE", "CA"), ("WYW", "CASSL")], "peptide string, cdr3b string")
    rows = as_dict(single_receptor.scpp_stats(pairs, scales, None, (3, 4)), ("peptide", "cdr3b", "aaindex_id", "frag_len"))
    for (p, t, scale, n), row in rows.items():
        w = min(n, len(t))
        frags = [t[i : i + w] for i in range(len(t) - w + 1)]
        x = np.array([brute_score(p, f, matrices[scale]) for f in frags + [f[::-1] for f in frags]])
        assert (row["Max"], row["Min"], row["Mean"]) == pytest.approx((x.max(), x.min(), x.mean()))
        if np.ptp(x) > 1e-9:
            assert row["SD"] == pytest.approx(x.std(ddof=1))
    assert ("WYW", "CASSL", "SYN01", 4) not in rows and ("ACDE", "CA", "SYN01", 4) in rows
    wide = as_dict(single_receptor.scpp_features(pairs, scales, None, (3, 4)), ("peptide", "cdr3b"))
    assert wide["ACDEFGHI", "CASSLGQYF"]["sCPP_SYN01_Max_3"] == rows["ACDEFGHI", "CASSLGQYF", "SYN01", 3]["Max"]


def test_contacts_of_a_pair_are_looked_up_once_per_scale():
    looked_up = []

    class Scale:
        def __getitem__(self, at):
            looked_up.append(np.broadcast(*at).size)
            return matrix[at]

    matrix = np.random.default_rng(3).random((20, 20))
    pairs = [("ACDEFGHI", "KLMNPQRSTV"), ("AAAACCCC", "WYWYWYWYWY"), (None, "WYWYWYWYWY")]
    got = {n: stats for _, n, _, stats in single_receptor._pair_stats(*(pa.array(c, pa.string()) for c in zip(*pairs)), [3, 4], {"S": Scale()})}
    assert sum(looked_up) == 2 * 8 * 10
    for n, stats in got.items():
        for (peptide, receptor), row in zip(pairs, stats):
            windows = [receptor[i : i + n] for i in range(len(receptor) - n + 1)]
            best = [
                max(sum(matrix[AMINO_ACIDS.index(a), AMINO_ACIDS.index(b)] for a, b in zip(f, peptide[o:])) for o in range(len(peptide) - n + 1))
                for w in windows for f in (w, w[::-1])
            ]
            assert row[:3] == pytest.approx([max(best), min(best), np.mean(best)])


def test_receptor_statistics_are_made_at_all_default_lengths(spark, tmp_path):
    from epigrain.plans import feature_queries

    docs = [(1, "ACDEFGHIK and LMNPQRSTVW"), (2, "CASSLGQAYEQYF ACDEFGHI")]
    rows = [(i, text, "en", "src") for i, text in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = feature_queries.q_scpp_stats(spark, str(tmp_path)).groupBy("peptide", "cdr3b", "aaindex_id").agg({"frag_len": "collect_set"}).collect()
    assert {(r.peptide, r.cdr3b) for r in got} == {("ACDEFGHIK", "ACDEFGHIK"), ("LMNPQRSTVW", "ACDEFGHIK"), ("ACDEFGHI", "ACDEFGHI")}
    assert all(sorted(r[3]) == [3, 4, 5, 6, 7, 8] for r in got)
