from epigrain.functions.alphabet import AMINO_ACIDS
from epigrain.operators import sequences


def column(df, name):
    return sorted(r[name] for r in df.select(name).collect())


def test_windows_and_guard(peptide_frame):
    rows = sequences.sliding_window(peptide_frame(["ABCDE"]), width=3).orderBy("start").collect()
    assert [(r["start"], r["window"]) for r in rows] == [(1, "ABC"), (2, "BCD"), (3, "CDE")]
    assert sequences.sliding_window(peptide_frame(["ABCDE", ""]), width=6).count() == 0


def test_window_shrinks_to_shortest(peptide_frame):
    assert column(sequences.sliding_window_fitted(peptide_frame(["AC", "DEF"]), width=3), "window") == ["AC", "DE", "EF"]


def test_filter_upper_cases_and_keeps_duplicates(peptide_frame):
    df = peptide_frame(["acdefghi", "ACDEFGHI", "ACDEFGHX", "ACD", None])
    assert column(sequences.sequence_filter(df), "peptide") == ["ACDEFGHI", "ACDEFGHI"]


def enumerate_mutants(s):
    out = {s}
    for i in range(len(s)):
        out.add(s[:i] + s[i + 1 :])
        for a in AMINO_ACIDS:
            out.add(s[:i] + a + s[i + 1 :])
            out.add(s[:i] + a + s[i:])
    return out


def test_mutants_match_enumeration(peptide_frame):
    sources = ["AC", "AAC", "CCC", "ACDX", "YAWAA"]
    want = {m for s in sources for m in enumerate_mutants(s) if 2 <= len(m) <= 4}
    got = column(sequences.insilico_mutagenesis(peptide_frame(sources), lengths=range(2, 5)), "peptide")
    assert got == sorted(want)


def test_insertions_are_never_appended(peptide_frame):
    got = set(column(sequences.insilico_mutagenesis(peptide_frame(["AC"]), lengths=[3]), "peptide"))
    assert {m for m in got if m.startswith("AC")} == {"ACC"} and "WAC" in got


def test_peptide_basic(peptide_frame):
    row = sequences.peptide_basic(peptide_frame(["ACCA"])).first()
    assert (row["Peptide_Length"], row["Peptide_ContainA"], row["Peptide_ContainD"]) == (4, 1.0, 0.0)
