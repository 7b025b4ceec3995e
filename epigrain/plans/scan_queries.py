"""Queries over files: each writes a file of the kind from the given tables to the shared folder and scans it back."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.alphabet import AMINO_ACIDS
from ..operators import diagnostics, relational, scoring
from ..operators.descriptors import split_features
from ..session import checkpoint_dir, stage
from ..sources import binding, clonotypes, contact_scales, epitopes, features_io
from .diagnostic_queries import q_auc_delong
from .inputs import OBSERVATIONS_SQL, PEPTIDES_SQL, WORDS_SQL, hash_sql, observations, peptides, table, word_rows
from .profile_queries import _SCALE_PAIRS_SQL
from .registry import ORACLES, query, r, rounded

_COUNTED = "peptide, immunogenicity, mhc, dataset"


def _folder(spark, label: str) -> str:
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query(
    "scan_epitope_csv",
    f"""WITH {OBSERVATIONS_SQL},
seen AS (SELECT peptide, immunogenicity, CASE WHEN organism = 'de' OR host = 'src1' THEN NULL ELSE mhc END AS mhc, dataset FROM raw)
SELECT {_COUNTED}, count(*) AS n FROM seen GROUP BY ALL""",
)
def q_scan_epitope_csv(spark, sf_dir):
    """Missing restrictions are written as an empty text and as the text NA."""
    raw = observations(spark, sf_dir)
    mhc = F.when(F.col("organism") == "de", "").when(F.col("host") == "src1", "NA").otherwise(F.col("mhc"))
    path = _folder(spark, "epitopes")
    written = raw.select(
        F.col("peptide").alias("Peptide"), F.col("immunogenicity").alias("Immunogenicity"), mhc.alias("MHC"), F.col("dataset").alias("Dataset")
    )
    written.where("Peptide <> 'NA'").write.option("header", True).csv(path)
    # the word NA is a missing peptide in such files; it is put back to keep the count of all rows
    back = epitopes.read_epitope_csv(spark, path).unionByName(
        written.where("Peptide = 'NA'").selectExpr(
            "Peptide AS peptide", "Immunogenicity AS immunogenicity", "CASE WHEN MHC NOT IN ('', 'NA') THEN MHC END AS mhc", "Dataset AS dataset"
        ),
        allowMissingColumns=True,
    )
    return back.groupBy(*_COUNTED.split(", ")).agg(F.count("*").alias("n"))


@query(
    "scan_assay_export",
    f"""WITH {OBSERVATIONS_SQL}
SELECT peptide, CASE WHEN immunogenicity = 'Positive' THEN 'Positive' ELSE 'Negative' END AS immunogenicity,
  immunogenicity_evidence, mhc, host, organism, count(*) AS n
FROM raw WHERE immunogenicity_evidence = 'ev0' AND peptide <> 'NA' GROUP BY ALL""",
)
def q_scan_assay_export(spark, sf_dir):
    """An export of 50 columns with a banner line, then the header line as a row of its own; most cells are alike, so files are compressed."""
    named = {
        12: ("Description", "peptide"), 20: ("Qualitative Measure", "measure"), 21: ("Assay Group", "immunogenicity_evidence"),
        22: ("Allele Name", "mhc"), 23: ("Allele Evidence Code", "dataset"), 30: ("Name", "host"), 50: ("Organism Species", "organism"),
    }
    raw = observations(spark, sf_dir).where("peptide <> 'NA'").withColumn(
        "measure", F.when(F.col("immunogenicity") == "Positive", "Positive-High").otherwise("Negative")
    )
    banner = [f"Part {i}" for i in range(1, 51)]
    header = {banner[i - 1]: [named.get(i, (f"Column {i}",))[0]] for i in range(1, 51)}
    body = raw.select(*[(F.col(named[i][1]) if i in named else F.lit("x")).alias(banner[i - 1]) for i in range(1, 51)])

    def with_header(batches):
        top = pa.RecordBatch.from_pydict(header)
        yield top
        for batch in batches:  # a column of them that is never null has another schema
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in batch.columns], schema=top.schema)

    path = _folder(spark, "assays")
    body.mapInArrow(with_header, body.schema).write.option("header", True).option("compression", "gzip").csv(path)
    evidence = table(spark, sf_dir, "labels").where("toxic = 0").select(F.concat(F.lit("ev"), "toxic").alias("evidence")).distinct()
    back = epitopes.read_assay_export(spark, path, evidence)
    return back.groupBy("peptide", "immunogenicity", "immunogenicity_evidence", "mhc", "host", "organism").agg(F.count("*").alias("n"))


@query("scan_lookup", "SELECT DISTINCT source AS Source FROM documents")
def q_scan_lookup(spark, sf_dir):
    path = _folder(spark, "lookup")
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("Source"), F.lit(1).alias("Unused")).distinct()
    features_io.save_csv(sources, path)
    return epitopes.read_lookup(spark, path)


@query(
    "scan_matrix_csv",
    f"""WITH {WORDS_SQL}, {_SCALE_PAIRS_SQL},
u AS (SELECT *, 0 AS prio FROM given UNION ALL SELECT aaindex_id, reverse(pair), value, 1 FROM given),
f AS (SELECT aaindex_id, pair, value FROM u QUALIFY row_number() OVER (PARTITION BY aaindex_id, pair ORDER BY prio) = 1),
s AS (SELECT * FROM f UNION ALL SELECT aaindex_id || 'inv', pair, -value FROM f),
m AS (SELECT aaindex_id, min(value) AS lo, max(value) AS hi FROM s GROUP BY 1)
SELECT aaindex_id, substr(pair, 1, 1) AS aa1, substr(pair, 2, 1) AS aa2,
       {r('CASE WHEN hi = lo THEN 0.5 ELSE (value - lo) / (hi - lo) END', 'value', 9)}
FROM s JOIN m USING (aaindex_id)""",
)
def q_scan_matrix_csv(spark, sf_dir):
    """One line per language and a column per residue pair, NA among them; empty cells are missing."""
    clean = word_rows(spark, sf_dir).where(F.col("word").rlike(f"^[{AMINO_ACIDS}]{{2,}}$"))
    places = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    counted = clean.select("lang", F.explode(places).alias("pair")).groupBy("lang", "pair").agg(F.count("*").alias("n"))
    pairs = [a + b for a in AMINO_ACIDS for b in AMINO_ACIDS]
    wide = counted.groupBy(F.col("lang").alias("AAIndexID")).pivot("pair", pairs).agg(F.first("n"))
    docs = [F.lit("text").alias(c) for c in contact_scales.DOC_COLUMNS]
    path = _folder(spark, "scales")
    features_io.save_csv(wide.select("AAIndexID", *docs, *pairs), path)
    return rounded(contact_scales.read_contact_matrices(spark, path), ["value"], 9)


@query(
    "scan_clone_files",
    f"""WITH {WORDS_SQL}
SELECT word AS aa_seq_cdr3, source AS accession, count(*) AS n FROM w
WHERE lang <> 'de' AND regexp_full_match(word, '[{AMINO_ACIDS}]+') GROUP BY 1, 2""",
)
def q_scan_clone_files(spark, sf_dir):
    """Clone tables in a folder per accession, found by their names; other files beside them are left alone."""
    root = _folder(spark, "clones")
    rows = word_rows(spark, sf_dir).select(
        F.when(F.col("lang") != "de", "TRBV5-1*00(100)").otherwise("TRAV1-2*00(90)").alias("allVHitsWithScore"),
        F.col("word").alias("aaSeqCDR3"),
        "source",
        F.col("source").alias("accession"),
    )
    # the files of a large accession are written by several tasks
    rows.hint("rebalance", "source").write.partitionBy("source").option("header", True).option("sep", "\t").csv(root)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = jvm.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(jvm.Path(f"{root}/source=*/part-*.csv")):
        files.rename(found.getPath(), jvm.Path(f"{found.getPath().toString().removesuffix('.csv')}_clones.txt"))
    table_ = clonotypes.read_clone_files(spark, root, -2)
    kept = clonotypes.clonotypes(table_.withColumn("accession", F.replace("accession", F.lit("source="), F.lit(""))))
    return kept.groupBy("aa_seq_cdr3", "accession").agg(F.count("*").alias("n"))


_RANKS = binding.SUPERTYPES["MHCII"]


@query(
    "scan_binding_tsv",
    f"""WITH {WORDS_SQL}
SELECT DISTINCT 'P' || word AS id, word AS peptide, {", ".join(f"({hash_sql(f"'{t}'", 'word')} % 1000) / 50.0::DOUBLE AS {t}" for t in _RANKS)}
FROM w WHERE length(word) BETWEEN 8 AND 11""",
)
def q_scan_binding_tsv(spark, sf_dir):
    from ..functions.hashing import seeded_hash

    words = word_rows(spark, sf_dir).where(F.length("word").between(8, 11)).select("word").distinct()
    ranks = [((seeded_hash(t, F.col("word")) % 1000) / F.lit(50.0)).alias(f"Rank{i}") for i, t in enumerate(_RANKS)]
    path = _folder(spark, "binding")
    rows = words.select(F.lit(1).alias("Pos"), F.col("word").alias("Peptide"), F.concat(F.lit("P"), "word").alias("ID"), *ranks)
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return binding.read_binding(spark, path, "MHCII")


@query(
    "resume_seeds",
    f"""WITH {PEPTIDES_SQL}
SELECT CAST(s AS INTEGER) AS seed, peptide, {hash_sql("CAST(s AS VARCHAR)", "peptide")} AS draw FROM pep, (SELECT unnest([1, 2, 3]) AS s)""",
)
def q_resume_seeds(spark, sf_dir):
    """Two seeds are finished first; a second call builds the third only."""
    from ..functions.hashing import seeded_hash

    root, source, built = _folder(spark, "resume"), stage(peptides(spark, sf_dir)), []

    def build(seed):
        built.append(seed)
        return source.select(F.lit(seed).alias("seed"), "peptide", seeded_hash(seed, F.col("peptide")).alias("draw"))

    features_io.resume_seeds(spark, root, "draws", [1, 2], build, depth=10)
    out = features_io.resume_seeds(spark, root, "draws", [1, 2, 3], build, depth=10)
    if built != [1, 2, 3]:
        raise RuntimeError(f"finished seeds were built again: {built}")
    return out


@query(
    "select_matching",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_discount, l_extendedprice FROM lineitem",
)
def q_select_matching(spark, sf_dir):
    return relational.select_matching(table(spark, sf_dir, "lineitem"), "^l_(quantity|tax|disc|ext)", ["l_orderkey", "l_linenumber"])


@query(
    "auc_label",
    f"""SELECT "group", printf('AUC: %.1f%% [%.1f%%-%.1f%%]', auc, ci_lo, ci_up) AS label FROM ({ORACLES["auc_delong"]})""",
)
def q_auc_label(spark, sf_dir):
    return diagnostics.auc_label(q_auc_delong(spark, sf_dir)).select("group", "label")


@query(
    "split_features",
    """SELECT doc_id, CAST(length(text) AS INTEGER) AS size, lang AS library, CAST(doc_id % 3 AS INTEGER) AS frag_depth FROM documents""",
)
def q_split_features(spark, sf_dir):
    """Split by (language, depth) and put together again with the key of each part."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.length("text").alias("size"), F.col("lang").alias("library"), (F.col("doc_id") % 3).cast("int").alias("frag_depth")
    )
    keys = [tuple(k) for k in docs.select("library", "frag_depth").distinct().collect()]
    parts = [
        part.withColumns({"library": F.lit(library), "frag_depth": F.lit(int(depth))})
        for (library, depth), part in split_features(docs, keys).items()
    ]
    return relational.union_by_name(*parts)


@query(
    "training_overlap",
    f"""WITH {OBSERVATIONS_SQL} SELECT count(DISTINCT e.peptide) AS n_overlapping FROM raw e
WHERE e.organism <> 'en' AND e.peptide IN (SELECT peptide FROM raw WHERE organism = 'en')""",
)
def q_training_overlap(spark, sf_dir):
    raw = observations(spark, sf_dir).select("peptide", "organism")
    return scoring.training_overlap(raw.where("organism = 'en'"), raw.where("organism <> 'en'"))
