"""Queries over observation ingest and the table idioms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash
from ..functions.names import decode_columns
from ..operators import ingest, relational
from .inputs import OBSERVATIONS_SQL, WORDS_SQL, hash_sql, observations, table, word_rows
from .registry import query, r, rounded

_CLEAN = "regexp_full_match(peptide, '[ACDEFGHIKLMNPQRSTVWY]{8,11}')"


def _agg(column: str) -> str:
    return f"coalesce(string_agg(DISTINCT {column}, '|' ORDER BY {column}), '')"


@query(
    "epitope_import",
    f"""WITH {OBSERVATIONS_SQL}
SELECT peptide,
  CASE WHEN bool_or(immunogenicity = 'Positive') THEN 'Positive' ELSE 'Negative' END AS immunogenicity,
  bool_or(immunogenicity = 'Positive') AND bool_or(immunogenicity = 'Negative') AS immunogenicity_contradiction,
  {_agg('immunogenicity_evidence')} AS immunogenicity_evidence,
  replace({_agg('mhc')}, ', ', '|') AS mhc, {_agg('mhc_evidence')} AS mhc_evidence,
  {_agg('host')} AS host, {_agg('organism')} AS organism, {_agg('dataset')} AS dataset
FROM raw WHERE {_CLEAN} GROUP BY peptide""",
)
def q_epitope_import(spark, sf_dir):
    return ingest.epitope_import(observations(spark, sf_dir))


@query(
    "epitope_contradiction",
    f"""WITH {OBSERVATIONS_SQL},
e AS (SELECT peptide, bool_or(immunogenicity = 'Positive') AS p, bool_or(immunogenicity = 'Negative') AS n
      FROM raw WHERE {_CLEAN} GROUP BY peptide)
SELECT count(*) AS n_peptides, count(*) FILTER (p AND n) AS n_contradicting,
       {r('count(*) FILTER (p AND n) / count(*)', 'share_contradicting', 9)}, count(*) FILTER (p) AS n_positive,
       {r('count(*) FILTER (p) / count(*)', 'share_positive', 9)} FROM e""",
)
def q_epitope_contradiction(spark, sf_dir):
    summary = ingest.contradiction_summary(ingest.epitope_import(observations(spark, sf_dir)))
    return rounded(summary, ["share_contradicting", "share_positive"], 9)


@query(
    "label_from_text",
    """SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL WHEN contains(text, 'Positive') THEN 'Positive'
       ELSE 'Negative' END AS label FROM conversations""",
)
def q_label_from_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", ingest.label_from_text(F.col("text")).alias("label"))


@query(
    "evidence_semi",
    """SELECT o_orderkey, o_orderpriority FROM orders
       WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'O' GROUP BY 1
                                 HAVING count(*) > (SELECT count(*) / 15.2 FROM orders))""",
)
def q_evidence_semi(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    share = orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "O").alias("n"))
    total = orders.agg((F.count("*") / 15.2).alias("t")).scalar()
    accepted = share.where(F.col("n") > total).select("o_orderpriority")
    return ingest.evidence_semi(
        orders.select("o_orderkey", "o_orderpriority"), accepted, "o_orderpriority"
    ).select("o_orderkey", "o_orderpriority")


_COMPRESSED_SQL = """comp AS (SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types
                     FROM events GROUP BY user_id)"""


def _compressed(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("types"))


@query(
    "compressed_to_long",
    f"WITH {_COMPRESSED_SQL} SELECT user_id, unnest(string_split(types, '|')) AS types FROM comp",
)
def q_compressed_to_long(spark, sf_dir):
    return relational.compressed_to_long(_compressed(spark, sf_dir), "types")


# The event types of the test tables.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    "compressed_to_dummy",
    f"""WITH {_COMPRESSED_SQL} SELECT user_id, types,
    {", ".join(f"CAST(list_contains(string_split(types, '|'), '{t}') AS DOUBLE) AS {t}" for t in EVENT_TYPES)}
    FROM comp""",
)
def q_compressed_to_dummy(spark, sf_dir):
    return relational.compressed_to_dummy(_compressed(spark, sf_dir), "types")


@query(
    "mutate_if",
    """SELECT event_id, event_type,
       CASE WHEN event_type = 'error' THEN round(value * 2, 6) ELSE value END AS value,
       CASE WHEN event_type = 'error' THEN 'flagged' ELSE props END AS props FROM events""",
)
def q_mutate_if(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    return relational.mutate_if(
        events, F.col("event_type") == "error", value=F.round(F.col("value") * 2, 6), props=F.lit("flagged")
    )


@query(
    "keep_first",
    """SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""",
)
def q_keep_first(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return relational.keep_first(orders, ["o_custkey"], [-F.col("o_totalprice"), "o_orderkey"])


@query(
    "union_by_name",
    """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS brand FROM customer
       UNION ALL SELECT p_partkey, p_name, NULL, p_brand FROM part""",
)
def q_union_by_name(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS key", "c_name AS name", "c_mktsegment AS segment"
    )
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey AS key", "p_name AS name", "p_brand AS brand")
    return relational.union_by_name(customers, parts)


@query(
    "sort_by_median",
    f"""WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS med FROM events GROUP BY 1)
SELECT event_id, event_type, value, {r('med', 'group_median', 9)} FROM events JOIN m USING (event_type)""",
)
def q_sort_by_median(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return rounded(relational.sort_by_median(events, "event_type", "value", descending=True), ["group_median"], 9)


@query("fast_unique", f"WITH {WORDS_SQL} SELECT DISTINCT word FROM w ORDER BY word")
def q_fast_unique(spark, sf_dir):
    return relational.fast_unique(word_rows(spark, sf_dir), "word")


@query(
    "venn_regions",
    """WITH t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS place FROM (SELECT DISTINCT event_type FROM events)),
m AS (SELECT user_id, bit_or(1 << place::INT) AS mask FROM events JOIN t USING (event_type) GROUP BY 1),
n AS (SELECT mask, count(*) AS n_items FROM m GROUP BY mask)
SELECT CAST(mask AS INTEGER) AS mask, n_items,
       (SELECT string_agg(event_type, '&' ORDER BY place) FROM t WHERE (mask >> place::INT) & 1 = 1) AS region
FROM n""",
)
def q_venn_regions(spark, sf_dir):
    """All event types that occur are the sets."""
    events = table(spark, sf_dir, "events")
    found = sorted(r[0] for r in events.select("event_type").where("event_type IS NOT NULL").distinct().collect())
    return relational.venn_regions(events, "user_id", "event_type", found)


@query(
    "rescale_minmax",
    f"""WITH m AS (SELECT c_nationkey, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1)
SELECT c_custkey, c_nationkey,
  {r('CASE WHEN hi = lo THEN 0.5 ELSE (c_acctbal - lo) / (hi - lo) END', 'rescaled', 9)}
FROM customer JOIN m USING (c_nationkey)""",
)
def q_rescale_minmax(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return rounded(relational.rescale(customers, ["c_nationkey"], "c_acctbal").drop("c_acctbal"), ["rescaled"], 9)


@query("semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def q_semi_join(spark, sf_dir):
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relational.semi_join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), buyers, "c_custkey")


@query(
    "set_except",
    f"""WITH {WORDS_SQL}
SELECT word FROM w WHERE lang = 'en' EXCEPT SELECT word FROM w WHERE lang <> 'en'""",
)
def q_set_except(spark, sf_dir):
    rows = word_rows(spark, sf_dir)
    return relational.set_except(rows, "word", F.col("lang") == "en", F.col("lang") != "en")


@query(
    "melt",
    """SELECT s_suppkey, variable, value FROM (
         SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM supplier)
       UNPIVOT (value FOR variable IN (nation, balance))""",
)
def q_melt(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "CAST(s_nationkey AS DOUBLE) AS nation", "s_acctbal AS balance"
    )
    return suppliers.unpivot(["s_suppkey"], ["nation", "balance"], "variable", "value")


@query(
    "pivot",
    f"""SELECT user_id, {", ".join(r(f"avg(value) FILTER (event_type = '{t}')", t, 9) for t in EVENT_TYPES)}
FROM events GROUP BY user_id""",
)
def q_pivot(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    wide = events.groupBy("user_id").pivot("event_type", list(EVENT_TYPES)).avg("value")
    return rounded(wide, EVENT_TYPES, 9)


@query(
    "param_grid",
    """SELECT n_name AS library, frag_len, seed FROM nation, (VALUES (3), (4), (5), (6), (7), (8)) AS l(frag_len),
       (VALUES (1), (2), (3), (4), (5)) AS s(seed)""",
)
def q_param_grid(spark, sf_dir):
    grid = table(spark, sf_dir, "nation").select(F.col("n_name").alias("library"))
    for name, values in (("frag_len", range(3, 9)), ("seed", range(1, 6))):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


@query(
    "inverse_cols",
    "SELECT l_returnflag, l_tax, l_discount, l_quantity, l_orderkey FROM lineitem",
)
def q_inverse_cols(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return relational.inverse_columns(li)


@query(
    "extract_parameters",
    """WITH n AS (SELECT DISTINCT 'CPP_' || replace(p_brand, '#', '') || CASE WHEN p_size % 2 = 0 THEN 'inv' ELSE '' END
                  || '_' || p_type || '_' || p_size AS feature FROM part)
SELECT regexp_replace(split_part(feature, '_', 2), 'inv$', '') AS aaindex_id,
       CAST(split_part(feature, '_', 4) AS INTEGER) AS frag_len, count(*) AS n_features FROM n GROUP BY 1, 2""",
)
def q_extract_parameters(spark, sf_dir):
    suffix = F.when(F.col("p_size") % 2 == 0, "inv").otherwise("")
    brand = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    names = table(spark, sf_dir, "part").select(
        F.concat_ws("_", F.lit("CPP"), F.concat(brand, suffix), "p_type", F.col("p_size").cast("string")).alias("feature")
    )
    parts = decode_columns(F.col("feature"))
    return (
        names.distinct()
        .select(F.regexp_replace(parts["subject"], "inv$", "").alias("aaindex_id"), parts["frag_len"].alias("frag_len"))
        .groupBy("aaindex_id", "frag_len")
        .agg(F.count("*").alias("n_features"))
    )


@query(
    "join_meta_features",
    """SELECT d.doc_id, l.quality, d.n_chars, d.lang FROM documents d JOIN labels l USING (doc_id)""",
)
def q_join_meta_features(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(documents, "doc_id")


@query(
    "shuffled_rows",
    f"SELECT c_custkey, {hash_sql(chr(39) + '7' + chr(39), 'CAST(c_custkey AS VARCHAR)')} AS draw FROM customer",
)
def q_shuffled_rows(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return customers.withColumn("draw", seeded_hash(7, F.col("c_custkey"))).orderBy("draw", "c_custkey")
