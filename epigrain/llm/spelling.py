"""Spelling variants: words one edit apart, found by joining numbered trie nodes.

The words of a corpus are put in order, once as they are and once reversed, by a range partition. Walking words in order gives each
node of their trie a number where it first occurs; what two neighbouring partitions share is numbered again by a table with one row
per partition. A word without its i-th letter is then two integers, the node of the letters before and the reversed node of those
after; a word parted before its i-th letter is two as well. Equal pairs are exactly the words that differ by one edit:

    skipped = skipped     one letter replaced
    skipped = parted      one letter deleted, or inserted seen from the other side

A pair is met by at most one parted word, and by at most one skipped word per letter of the alphabet, so no group grows with the
data. Of equal letters in a row only the first is skipped towards parted words, so every two near words meet exactly once. Nothing
is hashed and no word is compared with another, and a word of any length costs its length.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Maximal runs of these are words: ASCII letters and the second half of Latin-1, its two signs included.
LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Node numbers held at once by a task.
CELLS = 500_000


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, slip_every: int | None = None) -> DataFrame:
    """(word, n): the letter runs of whole texts, A-Z in lower case, of so many letters and occurrences at least.

    ``slip_every`` makes slips of the pen on purpose: let h be the crc32 of ``<doc_id>:<run>``; if ``slip_every`` divides h the letter
    at h modulo the run's length is left out. A null text has no words, a null doc_id counts as an empty one; other columns are ignored.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"),
    )
    ascii_only = F.octet_length("run") == F.length("run")
    runs = runs.select("doc", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("word"))
    if slip_every is not None:
        runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "word").cast("binary")))
        at = F.expr("cast(h % length(word) AS int)")
        without = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        runs = runs.withColumn("word", F.when(F.col("h") % slip_every == 0, without).otherwise(F.col("word")))
        runs = runs.where(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _shared(a: str, b: str) -> int:
    """The letters that two words have in common at their beginnings."""
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


def _walk(batches):
    """Number the trie nodes of a partition's sorted words, from 1, where they first occur: (part, at, word, path)."""
    part, last, path, made, at = TaskContext.get().partitionId(), "", [], 0, 0
    for batch in batches:
        words = batch.column(0).to_pylist()
        begin = 0
        while begin < len(words):
            flat, ends = [], [0]
            for word in words[begin:]:
                k = _shared(last, word)
                del path[k:]
                path.extend(range(made + 1, made + 1 + len(word) - k))
                made, last = made + len(word) - k, word
                flat.extend(path)
                ends.append(len(flat))
                if len(flat) > CELLS:
                    break
            n = len(ends) - 1
            paths = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            columns = [pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), batch.column(0).slice(begin, n), paths]
            yield pa.RecordBatch.from_arrays(columns, ["part", "at", "word", "path"])
            begin, at = begin + n, at + n


def trie_paths(words: DataFrame) -> DataFrame:
    """(word, id, path) for distinct words: ``path[i]`` is the number of the node of the first i + 1 letters, ``id`` the word's place
    in code-point order. The root is 0. The driver sees one row per range partition: its first and last word and the last one's path.
    """
    ordered = words.select("word").repartitionByRange("word").sortWithinPartitions("word")
    local = written(ordered.mapInArrow(_walk, "part int, at long, word string, path array<long>"), "trie")
    seams = local.groupBy("part").agg(
        F.min_by("word", "at").alias("first"), F.max_by("word", "at").alias("last"), F.max_by("path", "at").alias("path"),
        F.max(F.element_at("path", -1)).alias("made"), F.count(F.lit(1)).alias("words"),
    )
    rows, last, above, nodes, place = [], "", [], 0, 0
    for seam in sorted(seams.collect(), key=lambda r: r.part):
        k = _shared(last, seam.first)
        carry, base = above[:k], nodes - k
        rows.append((seam.part, carry, base, place))
        last, above = seam.last, [carry[x - 1] if x <= k else base + x for x in seam.path]
        nodes, place = nodes + seam.made - k, place + seam.words
    table = words.sparkSession.createDataFrame(rows, "part int, carry array<long>, base long, place long")
    joined = local.join(F.broadcast(table), "part")
    return joined.select("word", F.expr("place + at").alias("id"), F.expr("transform(path, x -> if(x <= size(carry), carry[cast(x - 1 AS int)], base + x))").alias("path"))


def near_words(counts: DataFrame) -> DataFrame:
    """(id, word, n, n_near, best_n, best_id): how many words are one edit away, and the most frequent of them (ties: the first in order).

    ``id`` is the place of a word in code-point order. Words without a near one have 0 and nulls.
    """
    counts = written(counts.select("word", "n"), "words")
    forward = written(trie_paths(counts).join(counts, "word"), "forward-trie")
    backward = trie_paths(counts.select(F.reverse("word").alias("word")))
    backward = backward.select(F.reverse("word").alias("word"), F.col("path").alias("back"))
    both = forward.join(backward, "word").selectExpr(
        "id", "n", "size(path) AS len", "concat(array(0L), path) AS f", "concat(array(0L), back) AS r", "split(word, '') AS letter"
    )
    skipped = both.selectExpr(
        "id", "n", "true AS skip", "inline(transform(sequence(0, len - 1), i -> struct(f[i] AS before, r[len - 1 - i] AS after, i = 0 OR letter[i] <> letter[i - 1] AS opens)))"
    )
    parted = both.selectExpr("id", "n", "false AS skip", "inline(transform(sequence(0, len), i -> struct(f[i] AS before, r[len - i] AS after, true AS opens)))")
    groups = skipped.unionByName(parted).groupBy("before", "after").agg(
        F.expr("collect_list(if(skip, struct(n, -id AS place, opens), null))").alias("found"),
        F.expr("max(if(skip, null, struct(n, -id AS place)))").alias("whole"),
    )
    groups = groups.where("size(found) > 1 OR size(found) = 1 AND whole IS NOT NULL").selectExpr("sort_array(found, false) AS found", "whole")
    replaced = """transform(found, (x, i) -> struct(-x.place AS id, cast(size(found) - 1 AS long) AS near,
        if(size(found) > 1, struct(found[if(i = 0, 1, 0)].n AS n, found[if(i = 0, 1, 0)].place AS place), null) AS best))"""
    deleted = "transform(filter(found, x -> x.opens AND whole IS NOT NULL), x -> struct(-x.place AS id, 1L AS near, whole AS best))"
    opened = "filter(found, x -> x.opens)"
    inserted = f"""if(whole IS NOT NULL AND size({opened}) > 0, array(struct(-whole.place AS id, cast(size({opened}) AS long) AS near,
        struct({opened}[0].n AS n, {opened}[0].place AS place) AS best)), array())"""
    met = groups.selectExpr(f"inline(concat({replaced}, {deleted}, {inserted}))").where("near > 0")
    near = met.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
    return forward.select("id", "word", "n").join(near, "id", "left").selectExpr(
        "id", "word", "n", "coalesce(n_near, 0L) AS n_near", "best.n AS best_n", "-best.place AS best_id"
    )


def variants(counts: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table of distinct words and counts.

    ``form`` is the most frequent near word (ties: the first in code-point order) if it is ``ratio`` times as frequent or more; ``root``
    follows forms to the last one and is the word itself where there is none. Counts grow by ``ratio`` (2 at least) with every form,
    so a chain has under 64 links and doubling ends after six rounds. An empty table gives an empty one.
    """
    words = written(near_words(counts).withColumn("form_id", F.expr(f"if(best_n >= {max(2, int(ratio))} * n, best_id, null)")), "near-words")
    links = written(words.where("form_id IS NOT NULL").selectExpr("id", "form_id AS top"), "forms")
    while True:
        above = links.selectExpr("id AS top", "top AS next")
        further = written(links.join(above, "top", "left").selectExpr("id", "top AS was", "coalesce(next, top) AS top"), "forms")
        links = further.select("id", "top")
        if further.where("was <> top").isEmpty():
            break
    names = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    tops = words.select(F.col("id").alias("top"), F.col("word").alias("root"))
    return (
        words.join(links, "id", "left").withColumn("top", F.coalesce("top", "id"))
        .join(names, "form_id", "left").join(tops, "top")
        .select("word", "form", "root", "n", "n_near", "form_n")
    )
