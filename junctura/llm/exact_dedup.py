"""Exact deduplication by a two-pass Bloom filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from junctura.llm import bloom
from junctura.llm.common import SPACE, release, staged, text_of

OUT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def exact_groups(docs: DataFrame, *, bits_per_key: int = 16, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): which row of its group of equal
    texts stays.

    Texts are equal when they are identical without white space; a null text is empty.
    Of a group the text with the most code points stays, then the smallest doc_id (a
    null id comes last); of rows that repeat an id one stays.

    Pass one fills a filter with the bits that two or more hashes set; pass two takes
    the rows whose bits are all in it. Only these meet in a shuffle, as digests and
    ids; all others stay where they are as groups of one. Corpora with more keys than
    the filter can hold go through in slices of the hash range, one filter a slice,
    so the filter never outgrows ``max_filter_bytes``."""
    digests = staged(docs.select("doc_id", F.length(text_of()).alias("chars"), F.sha2(F.regexp_replace(text_of(), SPACE + "+", ""), 256).alias("text_sha256"))
                     .withColumn("h", F.xxhash64("text_sha256")).withColumn("row", F.monotonically_increasing_id()), "digests")
    n = digests.count()
    slices = max(1, -(-n * bits_per_key // (max_filter_bytes * 8)))
    out = []
    for s in range(slices):
        part = digests.where(F.pmod("h", F.lit(slices)) == s) if slices > 1 else digests
        f = bloom.build(part, "h", -(-n // slices), twice=True, bits_per_key=bits_per_key, max_bytes=max_filter_bytes)
        flagged = part.withColumn("maybe", f.holds(F.col("h")))
        out.append(flagged)
    flagged = out[0]
    for more in out[1:]:
        flagged = flagged.union(more)
    flagged = staged(flagged, "flagged")
    release(digests)
    single = flagged.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = flagged.where("maybe").select("doc_id", "chars", "text_sha256", "row")
    best = F.max(F.struct("chars", F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("low"), (-F.col("row")).alias("first")))
    groups = staged(maybe.groupBy("text_sha256").agg(best.alias("b"), F.count("*").alias("group_size"))
                    .select("text_sha256", (-F.col("b.low")).alias("keep_id"), (-F.col("b.first")).alias("keep_row"), "group_size"), "groups")
    joined = maybe.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    return single.select(*OUT).union(joined.select(*OUT))


def exact_dedup(docs: DataFrame, **how) -> DataFrame:
    """The documents that stay, with all their columns. Rows that repeat an id of a
    kept document with an equal text are one document."""
    gone = staged(exact_groups(docs, **how).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("doc_id is not null and not kept").select("doc_id"), "gone")
    return bloom.without_ids(docs, gone, gone.count())
