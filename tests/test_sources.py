import pytest

from epigrain.sources import binding, clonotypes, features_io


def test_peptide_export_and_commands(spark, peptide_frame, tmp_path):
    peptides = peptide_frame([f"ACDEFGH{a}" for a in "ACDEF"] + ["ACDEFGHIK"] + ["A" * 12])
    chunks = binding.peptide_chunks(peptides, 2)
    sizes = {(r["length"], r["chunk"]): r["count"] for r in chunks.groupBy("length", "chunk").count().collect()}
    assert sizes == {(8, 1): 2, (8, 2): 2, (8, 3): 1, (9, 1): 1, (12, 1): 1}
    binding.write_fasta(chunks, str(tmp_path / "fasta"))
    text = "".join(p.read_text() for p in (tmp_path / "fasta").rglob("*.txt"))
    assert ">ACDEFGHIK\nACDEFGHIK\n" in text and text.count(">") == 7
    commands = {(r["mhc_class"], r["file_name"]): r["command"] for r in binding.tool_commands(chunks).collect()}
    assert len(commands) == 5
    assert commands["MHCI", "Peptides_9mer_1.fasta"].endswith(
        " -l 9 -xls -xlsfile ./Peptides/Peptides_9mer_1.xls -f ./Peptides/Peptides_9mer_1.fasta"
    )
    assert commands["MHCII", "Peptides_12mer_1.fasta"].startswith("./netMHCIIpan -a DRB1_0101,")
    binding.write_commands(binding.tool_commands(chunks), str(tmp_path / "scripts"))
    assert binding.peptide_chunks(peptides).select("chunk").distinct().count() == 1


def test_binding_import(spark, tmp_path):
    header = "Pos\tPeptide\tID\t" + "\t".join("nM\tRank" for _ in range(6)) + "\tAve\n"
    row = lambda p, i, ranks: f"0\t{p}\t{i}\t" + "\t".join(f"9\t{r}" for r in ranks) + "\t1\n"
    (tmp_path / "a.xls").write_text(header + row("PEPA", "i1", [2, 10, 10.5, 1, 50, 3]) + row("PEXA", "i2", [1] * 6))
    (tmp_path / "b.xls").write_text(header + row("PEPZ", "i1", [1] * 6))
    wide = binding.read_binding(spark, [str(tmp_path / "a.xls"), str(tmp_path / "b.xls")], "MHCII")
    out = binding.binding_tables(wide, "MHCII")
    long = {r["hla_restriction"]: r["binder_category"] for r in out["long"].collect()}
    assert long["DRB1"] == "StrongBinder" and long["DRB3"] == "WeakBinder" and long["DRB4"] == "NonBinder"
    coded = out["bind"].collect()
    assert len(coded) == 1 and coded[0]["peptide"] == "PEPA" and (coded[0]["DRB1"], coded[0]["DRB4"]) == (3, 1)
    with pytest.raises(ValueError):
        binding.read_binding(spark, str(tmp_path / "a.xls"), "MHCI")


def test_binder_codes(spark):
    rows = spark.createDataFrame([(0.5,), (2.0,), (3.0,), (None,)], "rank double")
    got = {r[0]: (r[1], r[2]) for r in rows.select(
        "rank", binding.binder_category(rows["rank"]).alias("c"), binding.binder_code(rows["rank"]).alias("k")).collect()}
    assert got == {0.5: ("StrongBinder", 3), 2.0: ("WeakBinder", 2), 3.0: ("NonBinder", 1), None: (None, None)}


def test_clone_files(spark, tmp_path):
    for accession, rows in {"SRR1": ["TRBV1\tCASSL", "TRAV1\tCAAA", "TRBV2\tCAS*L"], "SRR2": ["TRBV1\tCASSL", "TRBV1\tcassl"]}.items():
        (tmp_path / accession).mkdir()
        (tmp_path / accession / "clones.txt").write_text("allVHitsWithScore\taaSeqCDR3\n" + "\n".join(rows) + "\n")
    table = clonotypes.read_clone_files(spark, str(tmp_path), accession_index=-2)
    rows = clonotypes.clonotypes(table)
    assert {(r["aa_seq_cdr3"], r["accession"]) for r in rows.collect()} == {
        ("CASSL", "SRR1"), ("CASSL", "SRR2"), ("cassl", "SRR2")}
    assert clonotypes.clonotypes(table, upper_only=True).count() == 2
    support = {r["aa_seq_cdr3"]: r["n"] for r in clonotypes.clonotype_support(rows).collect()}
    assert support == {"CASSL": 2, "cassl": 1}
    assert clonotypes.list_files(spark, str(tmp_path), "*.txt").count() == 2


def test_scripts(spark, tmp_path):
    files = spark.createDataFrame(
        [("S1_pass.fastq.gz",), ("S2_pass_1.fastq.gz",), ("S2_pass_2.fastq.gz",), ("S3_pass.fastq.gz",)], "file_name string"
    )
    done = spark.createDataFrame([("S3",)], "accession string")
    runs = clonotypes.read_counts(files)
    scripts = {r["accession"]: r["script"].split("\n") for r in
               clonotypes.assembly_commands(runs, "D:", "mixcr.jar", rnaseq=True, done=done).collect()}
    assert set(scripts) == {"S1", "S2"} and len(scripts["S1"]) == 7
    assert "S2_pass_1.fastq.gz D:\\S2_pass_2.fastq.gz" in scripts["S2"][1]
    # Both layouts assemble the extended alignments.
    assert all("alignments_extended.vdjca D:" in s[5] for s in scripts.values())
    accessions = spark.createDataFrame([("S1",), ("S3",), ("S1",)], "accession string")
    commands = clonotypes.dump_commands(accessions, "/out", "fastq-dump", done)
    assert [r["accession"] for r in commands.collect()] == ["S1"]
    clonotypes.write_script(commands, "command", str(tmp_path / "script"))
    assert sum("--accession S1" in p.read_text() for p in (tmp_path / "script").glob("*.txt")) == 1


def test_feature_files_and_resume(spark, tmp_path):
    table = spark.createDataFrame([("A", "Weighted", 10, 1.0), ("A", "Mock", 20, 2.0)], "peptide string, library string, frag_depth int, x double")
    features_io.save_features(table, str(tmp_path / "f"))
    assert features_io.read_features(spark, str(tmp_path / "f"), "Mock", 20).first()["x"] == 2.0
    assert features_io.read_features(spark, str(tmp_path / "f")).count() == 2
    assert features_io.parameters_from_file_name("dir/FeatureDF_Weighted.10000.parquet") == ("Weighted", "10000")
    calls = []

    def build(seed):
        calls.append(seed)
        return spark.range(seed)

    for seeds in ((1, 2), (1, 2, 3)):
        assert features_io.resume_seeds(spark, str(tmp_path / "r"), "s", seeds, build, depth=1).count() == sum(seeds)
    assert calls == [1, 2, 3]
    features_io.resume_seeds(spark, str(tmp_path / "r"), "s", (1,), build, depth=2)
    assert calls == [1, 2, 3, 1]
    features_io.save_csv(table, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def _export(folder, rows):
    folder.mkdir()
    names = {12: "Description", 20: "Qualitative Measure", 21: "Assay Group", 22: "Allele Name", 23: "Allele Evidence Code", 30: "Name", 50: "Organism Species"}
    lines = [",".join(f"Part {i}" for i in range(1, 51)), ",".join(names.get(i, f"Column {i}") for i in range(1, 51))]
    for k in range(rows):
        own = {12: f"PEP{k}", 20: "Positive-High", 21: "proliferation", 22: '"A, ""x"""'}
        lines.append(",".join(own.get(i, "x") for i in range(1, 51)))
    (folder / "export.csv").write_text("\n".join(lines) + "\n")
    return folder / "export.csv"


def test_a_large_assay_export_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    from epigrain.sources import epitopes

    read, to_raw = [], epitopes.ingest.to_raw
    monkeypatch.setattr(epitopes.ingest, "to_raw", lambda rows, **c: read.append(rows.rdd.getNumPartitions()) or to_raw(rows, **c))
    file = _export(tmp_path / "plain", 2000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = epitopes.read_assay_export(spark, str(file.parent), epitopes.evidence_table(spark, ["proliferation"]))
        assert read[0] > 4
        assert sorted(r.peptide for r in got.collect()) == sorted(f"PEP{k}" for k in range(2000))
        assert {r.mhc for r in got.select("mhc").distinct().collect()} == {'A, "x"'}
        whole = file.read_text().replace("PEP7,", '"PEP7\nB",', 1)
        file.write_text(whole)
        spread_over = epitopes.read_assay_export(spark, str(file.parent), epitopes.evidence_table(spark, ["proliferation"]))
        assert sorted(r.peptide for r in spread_over.collect()) == sorted(f"PEP{k}" if k != 7 else "PEP7\nB" for k in range(2000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_large_accession_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from epigrain.plans import scan_queries

    rows = spark.range(0, 60_000, 1, 8).select(F.concat(F.lit("AC"), F.md5(F.col("id").cast("string"))).alias("word"), F.lit("en").alias("lang"), F.lit("src0").alias("source"))
    monkeypatch.setattr(scan_queries, "word_rows", lambda *_: rows)
    seen, read = [], scan_queries.clonotypes.read_clone_files
    monkeypatch.setattr(scan_queries.clonotypes, "read_clone_files", lambda s, root, i: seen.append(root) or read(s, root, i))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        scan_queries.q_scan_clone_files(spark, "")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert spark.read.format("binaryFile").load(f"{seen[0]}/source=src0/*_clones.txt").count() > 1


def test_an_assay_export_of_queries_takes_less_room_than_its_named_cells(spark, tmp_path, monkeypatch):
    from epigrain.plans import scan_queries

    words = ["ACDEFGHIK", "PEPTIDES", "LMNPQRST", "na", "with", 'AC"DE']
    docs = [(i, " ".join(words * 20), "de" if i % 2 else "en", f"src{i % 3}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(scan_queries, "_folder", lambda spark, label: str(tmp_path / label))
    got = scan_queries.q_scan_assay_export(spark, str(tmp_path)).collect()
    seen = {}
    for r in got:
        seen[r.peptide] = seen.get(r.peptide, 0) + r.n
    assert {r.immunogenicity_evidence for r in got} == {"ev0"} and {r.immunogenicity for r in got} == {"Positive", "Negative"}
    assert seen == {"ACDEFGHIK": 48 * 20, "PEPTIDES": 48 * 20, "LMNPQRST": 48 * 20, "WITH": 48 * 20, "AC": 48 * 20, "DE": 48 * 20}
    named = 60 * 20 * sum(len(w) + len("Positive-High,ev0,en, src0,src0,src0,en") for w in words)
    assert sum(p.stat().st_size for p in (tmp_path / "assays").glob("part-*")) < named
