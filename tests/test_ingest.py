import pytest

from epigrain.operators import ingest, relational
from epigrain.sources import epitopes
from pyspark.sql import functions as F


@pytest.fixture
def files(tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_bytes(
        b"Peptide,Immunogenicity,MHC,Dataset\r\nACDEFGHI,Positive,NA,A\r\nACDEFGHI,Negative,B7,A\r\n"
        b'ACDEFGHK,Negative,"A2, B8",A\r\nacdefghk,Positive,A1,A\r\nACDEFGHX,Positive,A1,A\r\nACD,Positive,A1,A\r\n'
    )
    b.write_text("Peptide,Immunogenicity,MHC,Dataset\nACDEFGHI,Positive,,B\nWWWWWWWW,NA,A1,B\n")
    return [str(a), str(b)]


def test_import(spark, files):
    raw = epitopes.read_epitope_csv(spark, files)
    assert raw.where("mhc is null").count() == 2
    got = {r["peptide"]: r for r in epitopes.import_epitopes(spark, other_files=files).collect()}
    assert set(got) == {"ACDEFGHI", "ACDEFGHK", "WWWWWWWW"}
    assert got["ACDEFGHI"]["immunogenicity"] == "Positive" and got["ACDEFGHI"]["immunogenicity_contradiction"]
    assert got["ACDEFGHI"]["dataset"] == "A|B" and got["ACDEFGHI"]["mhc"] == "B7"
    assert got["ACDEFGHK"]["mhc"] == "A2|B8" and got["ACDEFGHK"]["host"] == ""
    assert got["WWWWWWWW"]["immunogenicity"] == "Negative" and not got["WWWWWWWW"]["immunogenicity_contradiction"]
    s = ingest.contradiction_summary(epitopes.import_epitopes(spark, other_files=files)).first()
    assert (s["n_peptides"], s["n_contradicting"], s["n_positive"]) == (3, 1, 1)


def test_assay_export(spark, tmp_path):
    names = [f"Col {i}" for i in range(1, 51)]
    names[11], names[40] = "Description", "Description"
    names[49], names[45] = "Immunogen Organism Species", "Immunogen Organism Species"
    names[20:25] = ["Qualitative Measure", "Assay Group", "Allele Name", "Allele Evidence Code", "Name"]
    rows = []
    for peptide, measure, group in (("ACDEFGHI", "Positive-High", "IFNg release"), ("ACDEFGHK", "Negative", "proliferation"),
                                    ("ACDEFGHL", "Positive", "binding")):
        row = ["x"] * 50
        row[11], row[40], row[49] = peptide, "other", "Virus"
        row[20:25] = [measure, group, "HLA-A2", "typing", "Homo sapiens"]
        rows.append(row)
    path = tmp_path / "assay.csv"
    lines = [["Banner"] * 50, names, *rows]
    path.write_text("\n".join(",".join(line) for line in lines) + "\n")
    got = {r["peptide"]: r for r in epitopes.read_assay_export(spark, str(path)).collect()}
    assert set(got) == {"ACDEFGHI", "ACDEFGHK"}
    r = got["ACDEFGHI"]
    assert (r["immunogenicity"], r["host"], r["organism"], r["dataset"]) == ("Positive", "Homo sapiens", "Virus", "IEDB")


def test_compressed_columns(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None), (3, "b")], "id int, tags string")
    long = [(r["id"], r["tags"]) for r in relational.compressed_to_long(df, "tags").orderBy("id", "tags").collect()]
    assert long == [(1, "a"), (1, "b"), (2, None), (3, "b")]
    wide = {r["id"]: (r["a"], r["b"]) for r in relational.compressed_to_dummy(df, "tags").collect()}
    assert wide == {1: (1.0, 1.0), 2: (0.0, 0.0), 3: (0.0, 1.0)}


def test_mutate_if(spark):
    df = spark.createDataFrame([(1, 5), (None, 6)], "a int, b int")
    out = relational.mutate_if(df, F.col("a") == 1, a=F.lit(7), b=F.col("a") + 1).collect()
    assert {(r["a"], r["b"]) for r in out} == {(7, 8), (None, 6)}
    with pytest.raises(ValueError):
        relational.mutate_if(df, F.lit(True), c=F.lit(1))


def test_keep_first_venn_rescale_grid(spark):
    df = spark.createDataFrame([("k", 2, "x"), ("k", 1, "y"), (None, 3, "z")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in relational.keep_first(df, ["k"], ["o"]).collect()} == {("k", "y"), (None, "z")}
    sets = spark.createDataFrame([("i", "A"), ("i", "B"), ("j", "A"), ("j", "A")], "item string, s string")
    assert {r["region"]: r["n_items"] for r in relational.venn_regions(sets, "item", "s", ["A", "B"]).collect()} == {
        "A&B": 1, "A": 1}
    with pytest.raises(ValueError):
        relational.venn_regions(sets, "item", "s", list("ABCDEF"))
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 4.0)], "g string, v double")
    assert sorted(r["rescaled"] for r in relational.rescale(flat, ["g"], "v").collect()) == [0.0, 0.5, 0.5, 1.0]
    grid = relational.parameter_grid(spark, library=["A", "B"], seed=[1, 2, 3])
    assert grid.distinct().count() == 6
    assert relational.select_matching(grid, "^lib", ["seed"]).columns == ["seed", "library"]
    assert relational.inverse_columns(grid).columns == ["seed", "library"]


def test_except_moves_each_item_once(spark):
    from epigrain.operators import relational

    rows = [("a", "en")] * 4 + [("a", "de"), ("b", "en"), ("b", None), ("c", "fr"), ("d", None), ("e", "en"), ("e", "en")]
    df = spark.createDataFrame(rows, "word string, lang string")
    out = relational.set_except(df, "word", F.col("lang") == "en", F.col("lang") != "en")
    want = df.where("lang = 'en'").select("word").subtract(df.where("lang <> 'en'").select("word"))
    assert sorted(r.word for r in out.collect()) == sorted(r.word for r in want.collect()) == ["b", "e"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
