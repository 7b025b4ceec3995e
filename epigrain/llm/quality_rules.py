"""Line-first cleaning with DataFrame functions only.

Each line that holds a word is judged by itself:

* punctuation: some word of the line ends a sentence (``.``, ``!``, ``?``, an ellipsis, then closing quotes or brackets at most);
* symbols: at most one in ``SYMBOL_RATE`` of its word characters is one of ``SYMBOLS``;
* navigation: fewer than ``MAX_SEPARATORS`` words of the line are bare separators such as ``|`` or ``>``;
* boilerplate: the line has no notice phrase, or is long enough (``NOTICE_WORDS``) to be prose that mentions one.

Failing lines are removed, and a document is rejected when the lines removed hold more than ``MAX_LOST`` of its word characters.
Base rules reject documents of few words or with much repetition of five-word windows first.

Words are runs of ``[^\\x20\\x09-\\x0D]``, lines are parted by line feeds. A null or empty text has no word: counts are 0, the base
fails, the document goes. Rows that repeat a doc_id are judged each by itself; extra columns are ignored (their names may clash
with output names); an empty table gives an empty result. There is no limit on a text's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MAX_SEPARATORS = 2
NOTICE_WORDS = 25
SYMBOL_RATE = 5
MAX_LOST_PERCENT = 50

#: Marks that end a sentence in the scripts of the world. Fixed values.
TERMINALS = ".!?…‥։؟۔܀܁܂߹।॥၊။።፧፨᙮᠃᠉។៕‼‽⁇⁈⁉⸮。．！？｡꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫"
_CLOSING = "[\"'”’»)\\]）」』】》〉]*([\\x20\\x09-\\x0D]|$)"
SENTENCE_END = f"[{TERMINALS}]{_CLOSING}"
#: The same for the marks that most lines end with, and where all others lie: a line without these needs no further look.
COMMON_END, OTHER_MARKS = f"[.!?…]{_CLOSING}", "[\u0589-\uff61‥]"
SEPARATORS = "[|>»›·•/]"
SEPARATOR_WORD = "(^|[\\x20\\x09-\\x0D])[|>»›·•/]+($|[\\x20\\x09-\\x0D])"
NOTICE = (
    "(cookie policy|accept (all )?cookies|privacy policy|terms of (use|service)|all rights reserved|enable javascript|"
    "sign in|log in|sign up|subscribe (now|to)|click here|read more|skip to (main )?content|back to top|"
    "share (this|on)|follow us)"
)
WORD = "[^\\x20\\x09-\\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def covered_words(windows: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window whose hash occurs at least twice; ``windows`` has a hash for each starting word."""

    def starts(rows: Column) -> Column:
        """Starting places of repeated windows, ascending; rows are (hash, place) in order."""
        n = F.size(rows)

        def repeated(row: Column, i: Column) -> Column:
            same = [F.get(rows, j)["h"] == row["h"] for j in (i - 1, i + 1)]
            return F.coalesce(same[0], F.lit(False)) & (i > 0) | F.coalesce(same[1], F.lit(False)) & (i + 1 < n)

        return F.sort_array(F.transform(F.filter(rows, repeated), lambda row: row["p"]))

    def total(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(places, i + 1) - p, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    rows = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return let(let(rows, starts), total)


def line_fails(line: Column) -> Column:
    """Whether a line with words is to be removed."""
    ended = line.rlike(COMMON_END) | (line.rlike(OTHER_MARKS) & line.rlike(SENTENCE_END))
    spaced = F.regexp_replace(line, SPACE_RUN, "  ")  # neighbouring separators then share no space
    separators = line.rlike(SEPARATORS) & (F.size(F.split(spaced, SEPARATOR_WORD)) - 1 >= MAX_SEPARATORS)
    short = F.size(F.split(F.btrim(line, F.lit(SPACES)), SPACE_RUN)) < NOTICE_WORDS
    symbols = SYMBOL_RATE * (F.length(line) - without(line, SYMBOLS)) > without(line, SPACES)
    return ~ended | symbols | separators | (short & F.lower(line).rlike(NOTICE))


def judge(docs: DataFrame) -> DataFrame:
    """Counts, verdicts and the cleaned text of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select(
        "doc_id", "text", words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    n = F.size("words")
    windows = F.when(
        n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>"))
    good = F.filter("lines", lambda line: ~line_fails(line))
    rows = rows.select(
        "doc_id", "text", "lines", n.cast("long").alias("n_words"), windows.alias("windows"), good.alias("good")
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.select(
        "doc_id",
        "n_words",
        without(F.col("text"), SPACES).cast("long").alias("word_chars"),
        (F.length("text") - without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, covered_words(F.col("windows"))).otherwise(F.lit(0).cast("bigint")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_removed_lines"),
        F.array_join("good", "\n").alias("clean_text"),
    )
    lost = F.col("word_chars") - without(F.col("clean_text"), SPACES)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumns({"lost_chars": lost.cast("long"), "base_failed": failed})
    return rows.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("word_chars")))
