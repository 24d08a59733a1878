"""Line-first cleaning and the document rules that follow from it (column expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from junctura.llm.common import SPACE, text_of

WORD = r"[^\x20\x09-\x0D]+"
# What the line rules look for.
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[#*$%&|<>!=_~^]"
SEPARATORS = r"[|»›•·]"
NAVIGATION = (r"(?i)^[\x20\x09-\x0D]*(home|menu|next|previous|back to top|skip to content|log ?in|sign ?in|sign ?up|register|search|share|"
              r"sitemap|contact us|contact|about us|about|faq|help)[\x20\x09-\x0D]*$")
BOILERPLATE = (r"(?i)(all rights reserved|cookie policy|accept cookies|uses cookies|privacy policy|terms of use|terms of service|"
               r"enable javascript|subscribe to our newsletter|click here to|powered by)")
BOILERPLATE_WORDS = 30
MIN_WORDS = 50
MAX_LOST_PERCENT = 40


def line_fails(line: Column) -> Column:
    """Punctuation: three marks or more and over one for each two words. Navigation:
    two separators or more, one for each four words, or a lone menu word. Boilerplate:
    a stock phrase in a line of at most thirty words. A line without words passes."""
    words = F.regexp_count(line, F.lit(WORD))
    marks = F.regexp_count(line, F.lit(MARKS))
    bars = F.regexp_count(line, F.lit(SEPARATORS))
    return (((marks >= 3) & (2 * marks > words)) | ((bars >= 2) & (4 * bars >= words)) | line.rlike(NAVIGATION)
            | (line.rlike(BOILERPLATE) & (words <= BOILERPLATE_WORDS)))


def measure(docs: DataFrame, *, max_lost_percent: int = MAX_LOST_PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, counts, verdict and ``clean_text`` (the lines that pass) for each row of
    ``docs`` (doc_id, text); nulls count as empty texts, rows that repeat are measured
    each for itself, other columns are ignored. A text without words fails."""
    a = docs.select("doc_id", text_of().alias("text"))
    a = a.select("doc_id", "text", F.array_remove(F.split("text", SPACE + "+"), "").alias("words"), F.split("text", "\n", -1).alias("lines"))
    windows = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))),
                          lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    b = a.select("*", windows.alias("w3"), F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("full"),
                 F.transform("lines", lambda x: line_fails(x)).alias("fails"))
    c = b.select("*", F.when(F.size(F.array_distinct("w3")) < F.size("w3"),
                             F.array_sort(F.transform("w3", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("order"))
    same = lambda s, t: F.coalesce(s["h"] == t["h"], F.lit(False))
    again = F.filter("order", lambda s, i: same(s, F.get("order", i + 1)) | same(s, F.when(i > 0, F.get("order", i - 1))))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2))))
    passing = F.array_join(F.filter("lines", lambda x, i: ~F.get("fails", i)), "\n")
    lost = F.length(F.array_join(F.filter("lines", lambda x, i: F.get("fails", i)), ""))
    d = c.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("order").isNotNull(), F.size(covered)), F.lit(0)).cast("long").alias("n_repeat_words"),
        lost.cast("long").alias("lost_chars"), F.length("text").cast("long").alias("n_chars"), passing.alias("clean_text"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (100 * F.col("lost_chars") <= max_lost_percent * F.col("n_chars")))


def clean(docs: DataFrame, **how) -> DataFrame:
    """doc_id and the text without failing lines, of the documents that are kept."""
    return measure(docs, **how).where("kept").select("doc_id", F.col("clean_text").alias("text"))
