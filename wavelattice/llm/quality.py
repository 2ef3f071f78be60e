"""Line-first quality rules, in DataFrame functions only.

Each line is judged alone: it fails if it ends without closing punctuation
(punctuation rule), is a row of menu entries (navigation rule), or holds a
stock phrase of web pages (boilerplate rule). Failing lines are removed. A
document is kept if what the failing lines took is at most MAX_LOST of its word
characters. Before that come counts over the whole text, with two base rules.

Everything is an expression on one row: no shuffle, no Python.

Defined results: null and empty texts have no words and fail the base rule;
repeated rows give repeated result rows; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Closing punctuation, possibly followed by closing quotes or brackets.
CLOSED = r"[.!?:;…。！？][\x22'”’»)\]]*[\x20\x09-\x0D]*\z"
#: A menu row has three separators or more between short entries.
NAVIGATION = r"([|›»•·][^|›»•·]*){3}|^[\x20\x09-\x0D]*(home|menu|login|log in|sign in|sign up|next|previous|back to top|search)[\x20\x09-\x0D]*[.!]?[\x20\x09-\x0D]*\z"
#: Phrases of web pages.
BOILERPLATE = r"cookie policy|privacy policy|terms of use|terms of service|all rights reserved|enable javascript|lorem ipsum|click here|subscribe to our|share this"
MAX_LOST = 0.5
REPEAT_WINDOW = 8


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Number of words that lie in a window of words found twice or more."""

    def count(ws: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(ws) - F.lit(window - 1)), lambda i: F.xxhash64(F.slice(ws, i, window)))

        def covered(hs: Column) -> Column:
            ranked = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

            def positions(r: Column) -> Column:
                last = F.size(r) - 1
                same = lambda a, b: r[a]["h"] == r[b]["h"]
                twice = F.filter(r, lambda x, k: ((k > 0) & same(F.greatest(k - 1, F.lit(0)), k)) | ((k < last) & same(F.least(k + 1, last), k)))
                return F.sort_array(F.transform(twice, lambda x: x["i"]))

            def total(p: Column) -> Column:
                step = F.transform(p, lambda x, k: F.when(k == F.size(p) - 1, F.lit(window)).otherwise(F.least(F.lit(window), p[F.least(k + 1, F.size(p) - 1)] - x)))
                return F.aggregate(step, F.lit(0).cast("long"), lambda acc, x: acc + x)

            return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(let(ranked, positions), total))

        return F.when(F.size(ws) < window, F.lit(0).cast("long")).otherwise(let(grams, covered))

    return let(words, count)


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long")


def line_fails(line: Column) -> Column:
    """True for a line with a word that one of the line rules removes."""
    return F.rlike(line, F.lit(WORD)) & (
        ~F.rlike(line, F.lit(CLOSED)) | F.rlike(F.lower(line), F.lit(NAVIGATION)) | F.rlike(F.lower(line), F.lit(BOILERPLATE))
    )


def quality(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """Per row of docs: doc_id, the counts, base_failed, kept, lost_chars and clean_text (null unless kept)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_t"))
    words = F.array_remove(F.split("_t", SPACE + "+"), "")
    lines = F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    counted = base.select(
        "doc_id",
        "_t",
        let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeated_words(ws).alias("r"))).alias("_w"),
        word_chars(F.col("_t")).alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.filter(F.split("_t", "\n"), lambda x: ~line_fails(x)).alias("_kept"),
    )
    return counted.select(
        "doc_id",
        F.col("_w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("_w.r").alias("n_repeat_words"),
        ((F.col("_w.n") < 20) | (100 * F.col("_w.r") > 30 * F.col("_w.n"))).alias("base_failed"),
        (F.col("word_chars") - word_chars(F.array_join("_kept", "\n"))).alias("lost_chars"),
        F.array_join("_kept", "\n").alias("clean_text"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= max_lost * F.col("word_chars"))).withColumn(
        "clean_text", F.when(F.col("kept"), F.col("clean_text"))
    )
