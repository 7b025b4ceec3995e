"""The registered queries of this subpackage, and the SQL that can check them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_text import extract
from .language import predict, train
from .near_duplicates import components
from .packing import pack
from . import decontamination, personal_data, resampling, site_quality, spelling, url_lists
from . import quality_rules as rules
from .shared import written
from .token_files import token_digests
from .warc import page_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_harmonic_packing")
def harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, 2048)


@query("op10_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first_id FROM d GROUP BY hex),
b AS (SELECT d.*, first_id, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
        (16 * (strpos('0123456789abcdef', substr(hex, (5 * i) // 4 + 1, 1)) - 1)
            + strpos('0123456789abcdef', substr(hex, (5 * i) // 4 + 2, 1)) - 1) >> (3 - (5 * i) % 4)) & 31)::INT, 1)) AS letters
      FROM d JOIN f USING (hex))
SELECT page_id, payload_bytes, array_to_string(letters, '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""


@query("op3_warc_round_trip", WARC_SQL)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_round_trip(table(spark, sf_dir, "pages"))


@query("op5_language_naive_bayes")
def language_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


RULES_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{rules.WORD}+') AS words,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{rules.WORD}')) AS lines FROM t),
p AS (SELECT rid, i, words[i:i + 4] AS win FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM p) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM r) GROUP BY rid),
g AS (SELECT w.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        list_filter(lines, lambda l: regexp_matches(l, '{rules.SENTENCE_END.replace("'", "''")}')
            AND {rules.SYMBOL_RATE} * (length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g'))) <= length(regexp_replace(l, '{rules.SPACE_RUN}', '', 'g'))
            AND len(regexp_extract_all(regexp_replace(l, '{rules.SPACE_RUN}', '  ', 'g'), '{rules.SEPARATOR_WORD}')) < {rules.MAX_SEPARATORS}
            AND NOT (regexp_matches(lower(l), '{rules.NOTICE}') AND len(regexp_extract_all(l, '{rules.WORD}+')) < {rules.NOTICE_WORDS})
        ) AS good FROM w LEFT JOIN c USING (rid)),
s AS (SELECT doc_id, len(words)::BIGINT AS n_words, n_repeat_words, len(lines)::BIGINT AS n_lines,
        length(regexp_replace(text, '{rules.SPACE_RUN}', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        (len(lines) - len(good))::BIGINT AS n_removed_lines,
        length(regexp_replace(array_to_string(good, chr(10)), '{rules.SPACE_RUN}', '', 'g')) AS left_chars FROM g),
b AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 100 * (word_chars - left_chars) <= {rules.MAX_LOST_PERCENT} * word_chars AS kept, n_lines, n_removed_lines
FROM b
"""


@query("op2_line_first_rules", RULES_SQL)
def line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_removed_lines",
    )


@query("op7_template_removal")
def template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


NEAR_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS joint FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
        WHERE 100 * joint >= 80 * (na.size + nb.size - joint)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT doc_id, coalesce(max(size), 0)::BIGINT AS n_shingles, min(reach) AS component_id, doc_id = min(reach) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


@query("op1_lsh_forest", NEAR_SQL)
def lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), width=4, similarity=0.8)


@query("op8_string_tiling")
def string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_site_quality")
def site_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return site_quality.judge(docs, labels).select("doc_id", "p_low", "p_toxic", "kept")


#: The pages have no dates: a capture is made on the day of its page_id in the year, and lists are derived from all hosts seen.
LISTS_SQL = f"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 365)::INT AS fetched_at,
        lower(regexp_extract(url, '{url_lists.HOST}', 1)) AS host, lower(regexp_extract(url, '{url_lists.PATH}', 1)) AS path FROM pages),
h AS (SELECT host, min(page_id) AS lo, count(*) AS n FROM c WHERE host <> '' GROUP BY host),
d AS (SELECT regexp_extract(host, '[^.]+[.][^.]+$') AS domain, min(page_id) AS lo FROM c WHERE host <> '' GROUP BY 1),
f AS (SELECT host || '/' || split_part(path, '/', 2) || '/' AS dir, min(page_id) AS lo FROM c
      WHERE host <> '' AND len(string_split(path, '/')) > 2 GROUP BY 1),
e AS (SELECT 'hosts' AS list_name, false AS allows, host AS pattern, 'add' AS action, DATE '2024-01-01' + (lo % 200)::INT AS dated FROM h
      UNION ALL SELECT 'hosts', false, host, 'remove', DATE '2024-01-01' + (lo % 200 + n % 90 + 1)::INT FROM h
      UNION ALL SELECT 'hosts', false, host, 'add', DATE '2024-10-27' FROM h
      UNION ALL SELECT 'domains', false, domain, 'add', DATE '2024-01-01' + (lo % 331)::INT FROM d WHERE domain <> ''
      UNION ALL SELECT 'allowed', true, dir, 'add', DATE '2024-01-01' + (lo % 300)::INT FROM f
      UNION ALL SELECT 'allowed', true, dir, 'remove', DATE '2024-01-01' + (lo % 300 + 45)::INT FROM f),
i AS (SELECT list_name, allows, pattern, dated AS since, action,
        lead(dated) OVER (PARTITION BY list_name, pattern ORDER BY dated) AS until
      FROM (SELECT list_name, allows, pattern, dated, max(action) AS action FROM e GROUP BY ALL)),
r AS (SELECT *, row_number() OVER () AS rid FROM c),
m AS (SELECT rid, list_name, allows FROM r JOIN i ON i.action = 'add' AND fetched_at >= since AND (until IS NULL OR fetched_at < until)
      AND host <> '' AND (host = pattern OR ends_with(host, '.' || pattern)
        OR (contains(pattern, '/') AND starts_with(host || path, pattern)))),
g AS (SELECT rid, count(*) FILTER (NOT allows) AS n_block, count(*) FILTER (allows) AS n_allow,
        array_to_string(list_sort(list(DISTINCT list_name)), ',') AS lists FROM m GROUP BY rid)
SELECT page_id, url, fetched_at, coalesce(n_block, 0) > 0 AND coalesce(n_allow, 0) = 0 AS blocked, coalesce(n_block, 0) AS n_block,
    coalesce(n_allow, 0) AS n_allow, coalesce(lists, '') AS lists FROM r LEFT JOIN g USING (rid)
"""


def dated_lists(captures: DataFrame) -> DataFrame:
    """List entries made from the hosts, registered domains and first directories of all captures."""
    seen = captures.select("page_id", url_lists.host_of(F.col("url")).alias("host"), F.lower(F.regexp_extract("url", url_lists.PATH, 1)).alias("path")).where("host <> ''")
    hosts = seen.groupBy("host").agg(F.min("page_id").alias("lo"), F.count(F.lit(1)).alias("n"))
    domains = seen.groupBy(F.regexp_extract("host", "[^.]+[.][^.]+$", 0).alias("domain")).agg(F.min("page_id").alias("lo")).where("domain <> ''")
    folders = seen.where(F.size(F.split("path", "/")) > 2)
    folders = folders.groupBy(F.concat("host", F.lit("/"), F.split_part("path", F.lit("/"), F.lit(2)), F.lit("/")).alias("dir")).agg(F.min("page_id").alias("lo"))

    def entry(rows, name, allows, pattern, action, day):
        at = F.expr(f"date_add(DATE '2024-01-01', cast({day} AS int))")
        return rows.select(F.lit(name).alias("list_name"), F.lit(allows).alias("allows"), F.col(pattern).alias("pattern"), F.lit(action).alias("action"), at.alias("at"))

    parts = [
        entry(hosts, "hosts", False, "host", "add", "lo % 200"),
        entry(hosts, "hosts", False, "host", "remove", "lo % 200 + n % 90 + 1"),
        entry(hosts, "hosts", False, "host", "add", "300"),
        entry(domains, "domains", False, "domain", "add", "lo % 331"),
        entry(folders, "allowed", True, "dir", "add", "lo % 300"),
        entry(folders, "allowed", True, "dir", "remove", "lo % 300 + 45"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("op6_temporal_url_lists", LISTS_SQL)
def temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.expr("date_add(DATE '2024-01-01', cast(page_id % 365 AS int))")
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_at"))
    return url_lists.judge(captures, written(dated_lists(captures), "url-lists"))


def crc32_sql(data: str) -> str:
    """SQL of the unsigned crc32 of a list of bytes, half a byte at a time; the table of 16 is made from the polynomial."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)

    def half(x: str) -> str:
        return f"xor({x} >> 4, [{', '.join(f'{t}::BIGINT' for t in table)}][({x} & 15) + 1])"

    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: {half(half('xor(c, b)'))}), 4294967295::BIGINT)"


def utf8_sql(text: str) -> str:
    """SQL of the bytes of a text."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    return f"list_transform(range(octet_length(encode({text}))), lambda i: {byte})"


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

VARIANTS_SQL = f"""
WITH RECURSIVE t AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all({_FOLDED}, '[a-zÀ-ÿ]+')) AS run FROM documents),
r AS (SELECT doc, run, count(*) AS times, {crc32_sql(utf8_sql("doc || ':' || run"))} AS h FROM t WHERE length(run) >= 7 GROUP BY doc, run),
w AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0
    THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM r)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
c AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM c a JOIN c b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT c.word, w.word FROM c JOIN w ON w.word = c.rest UNION SELECT w.word, c.word FROM c JOIN w ON w.word = c.rest),
e AS (SELECT p.a AS word, count(*) AS n_near, arg_min(struct_pack(f := w.word, m := w.n), struct_pack(x := -w.n, y := w.word)) AS best
      FROM p JOIN w ON w.word = p.b GROUP BY p.a),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best.m >= 10 * w.n THEN best.f END AS form,
      CASE WHEN best.m >= 10 * w.n THEN best.m END AS form_n FROM w LEFT JOIN e USING (word)),
u AS (SELECT word, word AS top, 0 AS step FROM f UNION ALL SELECT u.word, f.form, step + 1 FROM u JOIN f ON f.word = u.top WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(top, step) AS root FROM u GROUP BY word) USING (word)
"""

_N_GRAMS = """list_concat(words, list_concat(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]),
    list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])))"""


def _words_sql(table: str, key: str) -> str:
    return f"""SELECT {key} AS doc_id, row_number() OVER () AS rid, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM {table}"""


RESAMPLE_SQL = f"""
WITH d AS MATERIALIZED ({_words_sql("documents", "doc_id")}),
b AS ({_words_sql("benchmark", "item_id")}),
df AS MATERIALIZED (SELECT rid, f, count(*) AS n FROM (SELECT rid, unnest({_N_GRAMS}) AS f FROM d) GROUP BY ALL),
bf AS MATERIALIZED (SELECT f, count(*) AS n FROM (SELECT unnest({_N_GRAMS}) AS f FROM b) GROUP BY f),
h AS MATERIALIZED (SELECT f, {crc32_sql(utf8_sql("f"))} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN h USING (f) GROUP BY 1),
t AS (SELECT bucket, sum(n) AS t FROM bf JOIN h USING (f) GROUP BY 1),
a AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000 AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000 AS t_all),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * s_all / ((coalesce(s, 0)::DOUBLE + 1) * t_all)))::BIGINT AS gain
      FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), a),
x AS (SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY rid),
y AS (SELECT doc_id, rid, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
      ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS u FROM d LEFT JOIN x USING (rid)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM y),
k AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM z WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM z LEFT JOIN k USING (rid)
"""


@query("op12_spelling_variants", VARIANTS_SQL)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), slip_every=31))


@query("op13_importance_resampling", RESAMPLE_SQL)
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_personal_data")
def personal_data_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal_data.find(docs, personal_data.train(docs))
