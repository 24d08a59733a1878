"""How filters interact: which of them removes what in every order of application."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from junctura.llm.common import release, staged, text_of

FILTERS = "ABCDE"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
FLAGS = ("good", "toxic")


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def failures(text: Column) -> Column:
    """The letters of the filters that a text fails by itself, as an array: A under 50
    words, B under 65 % distinct words, C over 5 % capitals, D a mark of ``#$%&*|``."""
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " ", -1), "")
    seen = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return F.transform(F.array(seen), lambda s: F.array_compact(F.array(
        F.when(s["n"] < 50, F.lit("A")), F.when(100 * s["d"] < 65 * s["n"], F.lit("B")),
        F.when(100 * capitals > 5 * F.length(text), F.lit("C")), F.when(text.rlike(r"[#$%&*|]"), F.lit("D")))))[0]


def failing_ids(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, fails): rows of each part, and one id table per filter, stored together and
    partitioned by the filter's letter: row, part, good, toxic. ``row`` numbers the rows of
    ``docs`` once, in a written copy, so repeated and null document ids stay rows of their own."""
    text = text_of()
    read = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("source", F.lit("")).alias("part"),
                       failures(text).alias("alone"), F.sha2(text, 256).alias("digest"))
    read = staged(read, "audited")
    totals = read.groupBy("part").agg(F.count("*").alias("total"))
    # E: only texts that stand in two rows or more; a text's rows meet as partial aggregates, not as a group
    first = read.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    repeats = read.select("digest", "doc_id", "part", "row").join(first, "digest").where(F.col("doc_id") > F.col("first"))
    alone = read.select("row", "doc_id", "part", F.explode("alone").alias("filter"))
    fails = alone.unionByName(repeats.select("row", "doc_id", "part", F.lit("E").alias("filter")))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    fails = fails.join(known, F.col("doc_id") == F.col("labelled"), "left").select(
        "row", "part", *[F.coalesce(c, F.lit(False)).alias(c) for c in FLAGS], "filter")
    return totals, staged(fails, "failing_ids", partition_by="filter")


def prefix_counts(fails: DataFrame) -> DataFrame:
    """part, filter, before, removed, redundant, good, toxic for every filter and every set
    of filters that may stand before it (``before``, a bit for each letter); sets without
    any failing row have no row.

    What a filter removes after a prefix is its id table left-anti the id tables of the
    prefix; what is redundant is its id table left-semi them. A prefix counts as a set, since
    its order does not matter for what follows: 80 pairs instead of 600 steps, all in one
    anti join and one semi join on the row id. A row has at most five failures of sixteen
    sets each, so no key is large, however many rows a part or a text has."""
    bit = F.element_at(F.create_map(*[x for c in FILTERS for x in (F.lit(c), F.lit(_bit(c)))]), F.col("filter"))
    sets = F.filter(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)), lambda s: s.bitwiseAND(bit) == 0)
    here = fails.select("row", "part", *FLAGS, "filter", F.explode(sets).alias("before")).alias("here")
    there = fails.select(F.col("row").alias("failed"), bit.alias("bit"))
    met = (F.col("row") == F.col("failed")) & (F.col("before").bitwiseAND(F.col("bit")) != 0)
    removed = here.join(there, met, "left_anti").groupBy("part", "filter", "before").agg(
        F.count("*").alias("removed"), *[F.count_if(F.col(c)).alias(c) for c in FLAGS])
    redundant = here.join(there, met, "left_semi").groupBy("part", "filter", "before").agg(F.count("*").alias("redundant"))
    return removed.join(redundant, ["part", "filter", "before"], "full").select(
        "part", "filter", "before", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("removed", "redundant", *FLAGS)])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (``source``; null counts as empty), order of the five filters and step:
    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.

    ``docs``: doc_id, text, source and any others; ``labels``: doc_id, quality, toxic. A null
    text is empty (it fails A), a null id can be no copy of an earlier one (E) and has no
    labels, rows that repeat an id and its text are no copies of each other; a label counts
    as set if any row of its id sets it. Texts are read whole. An empty table gives no row."""
    totals, fails = failing_ids(docs, labels)
    counts = staged(prefix_counts(fails), "prefix_counts")
    release(fails)
    n = len(FILTERS)
    everyone = (1 << n) - 1
    size = F.bit_count("before")
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), size.cast("int") + 1)
    others = F.col("before") + F.element_at(F.create_map(*[x for c in FILTERS for x in (F.lit(c), F.lit(_bit(c)))]), F.col("filter")) == everyone
    whole = counts.groupBy("part", "filter").agg(F.sum(F.when(others, F.col("removed")).otherwise(0)).alias("unique_fails"),
                                                 F.sum(F.col("removed") * weight).alias("shapley"))
    steps = [("".join(p), k + 1, p[k], sum(map(_bit, p[:k]))) for p in permutations(FILTERS) for k in range(n)]  # 600 fixed rows
    plan = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(f).alias("filter"), F.lit(b).alias("before")) for o, k, f, b in steps]))
    grid = totals.select("part", "total", plan.alias("s")).select("part", "total", "s.*")
    full = grid.join(counts, ["part", "filter", "before"], "left").join(whole, ["part", "filter"], "left")
    # survivors: the part's rows without what this and the earlier steps of the order removed
    row = F.struct("step", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("removed", "redundant", "unique_fails", *FLAGS, "shapley")])
    orders = full.groupBy("part", "filter_order", "total").agg(F.array_sort(F.collect_list(row)).alias("steps"))  # five rows
    gone = lambda s: F.aggregate(F.filter("steps", lambda x: x["step"] <= s["step"]), F.lit(0).cast("long"), lambda a, x: a + x["removed"])
    out = orders.select("part", "filter_order", F.explode(F.transform("steps", lambda s: F.struct(
        s["step"].alias("step"), (F.col("total") - gone(s)).alias("kept"), *[s[c].alias(c) for c in ("removed", "redundant", "unique_fails", *FLAGS, "shapley")]))).alias("s"))
    return out.select("part", "filter_order", F.col("s.step").alias("step"), *[F.col(f"s.{c}").cast("long").alias(a) for c, a in (
        ("kept", "kept"), ("removed", "removed"), ("redundant", "redundant"), ("unique_fails", "unique_fails"), ("good", "good_lost"), ("toxic", "toxic_lost"), ("shapley", "shapley"))])
