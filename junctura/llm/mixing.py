"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from junctura.llm.common import release, staged, text_of
from junctura.llm.quality import WORD

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_COPIES = 2
#: Digits of 12 bits by which the cut of a source is narrowed before it is exact.
DIGIT_BITS, DIGITS = 12, 2


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) for ``sizes`` (source, size). Sources in
    code-point order, null last, weigh ``weights`` in turn and share ``share_percent``
    of all words; a target stops at ``most`` times its source, and what is over is
    shared among the others by weight until none is above. Each pass is one aggregate
    over the table of sources; only sums come to the driver."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # numbering by a range of names, not in one task: a source's place is the count of names before it
    named = staged(by.select("source", "source_size", "n_docs"), "sources")
    order = named.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    order = staged(order.withColumn("id", F.monotonically_increasing_id()), "order")
    per = order.groupBy(F.shiftright("id", 33).alias("part")).count().withColumn(
        "before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    turn = F.pmod(F.col("id") - F.shiftleft(F.col("part"), 33) + F.col("before"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    s = staged(order.withColumn("part", F.shiftright("id", 33)).join(per.select("part", "before"), "part")
               .select("source", "source_size", "n_docs", weight.cast("long").alias("weight"), (most * F.col("source_size")).alias("cap")), "weights")
    total = share_percent * (s.agg(F.sum("source_size")).first()[0] or 0)  # in hundredths of a word
    full = F.lit(False)
    n_full = -1
    while True:
        r = s.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("c"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("w"), F.sum(full.cast("int")).alias("n")).first()
        left, w = total - 100 * (r["c"] or 0), r["w"] or 0
        if w == 0 or r["n"] == n_full:
            break
        n_full = r["n"]
        full = 100.0 * F.col("cap") * w < F.lit(float(left)) * F.col("weight")
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.lit(left / 100.0) * F.col("weight") / F.lit(float(w or 1)))
    out = staged(s.select("source", "source_size", "n_docs", target.alias("target")), "targets")
    release(named, order, s)
    return out


def _unit(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from the id alone, so that reruns agree."""
    n = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double")
    return (n + 0.5) / F.lit(float(1 << 48))


def mix(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (words, repeats counted) for
    each row of ``docs`` (doc_id, text, source).

    A source whose target is t times its words takes floor(t) whole copies of every
    document for certain. What is left, a share f of the source, is a Pareto sample
    (Rosén, 1997) of one more copy: document i has the inclusion probability
    l = 1 - (1 - f) ^ (size / mean size), as if each mean length of words were drawn
    with probability f, and documents go by q = (u / (1 - u)) / (l / (1 - l)), lowest
    first, until the words drawn come nearest to what is left. The cut is found by
    histograms of q, digit by digit, and then exactly within one small bin, so a source
    with a third of all rows never meets in one task. What the cut lacks is then given
    to the one later document whose size fits it best, if that brings the sum nearer.

    Empty texts have size 0 and are never drawn (taken 0). Rows that repeat an id are
    drawn together as far as the cut allows. Without words all targets are 0."""
    sized = staged(docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size")), "sizes")
    targets = source_targets(sized, weights, share_percent, most)
    t = targets.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    t = t.withColumn("whole", F.least(F.floor("ratio"), F.lit(most))).select(
        "source", "source_size", "target", "whole", (F.col("ratio") - F.col("whole")).alias("f"),
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"),
        F.when(F.col("n_docs") > 0, F.col("source_size") / F.col("n_docs")).alias("mean"))
    u = _unit(F.col("doc_id"), seed)
    keep = F.pow(1 - F.col("f"), F.col("size") / F.col("mean"))  # 1 - l
    q = (u / (1 - u)) * keep / F.greatest(1 - keep, F.lit(1e-300))
    joined = sized.join(t, sized["source"].eqNullSafe(t["source"])).drop(t["source"])
    drawn = joined.withColumn("q", F.when((F.col("size") > 0) & (F.col("f") > 0) & (F.col("whole") < most), q))
    bins = 1 << (DIGIT_BITS * DIGITS)
    drawn = staged(drawn.withColumn("bin", F.least(F.floor(F.col("q") / (1 + F.col("q")) * bins), F.lit(bins - 1))), "drawn")
    # narrow the cut: the bin where the running sum of words passes what is left
    cut = t.where("f > 0").select("source", F.col("left").alias("need"), F.lit(0).cast("long").alias("prefix"))
    for level in range(1, DIGITS + 1):
        shift = DIGIT_BITS * (DIGITS - level)
        digit = F.shiftright("bin", shift)
        up = F.shiftright("bin", shift + DIGIT_BITS)
        c = cut.select(F.col("source").alias("c_source"), "need", "prefix")
        inside = drawn.where("q is not null").join(c, F.col("source").eqNullSafe(F.col("c_source")) & (up == F.col("prefix")))
        hist = inside.groupBy("source", "need", digit.alias("digit")).agg(F.sum("size").alias("words"))
        w = Window.partitionBy("source").orderBy("digit")  # at most 4,096 rows for a source
        run = hist.withColumn("until", F.sum("words").over(w)).withColumn("last", F.lead("digit").over(w).isNull())
        at = run.where("until >= need or last").groupBy("source").agg(F.min(F.struct("digit", "words", "until", "need")).alias("m"))
        cut = staged(at.select("source", (F.col("m.need") - (F.col("m.until") - F.col("m.words"))).alias("need"), F.col("m.digit").alias("prefix")), "cut")
    c = cut.select(F.col("source").alias("c_source"), "need", "prefix")
    edge = drawn.where("q is not null").join(c, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bin") == F.col("prefix")))
    w = Window.partitionBy("source").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    run = edge.select("source", "q", "doc_id", "size", "need").withColumn("until", F.sum("size").over(w))
    # whole documents while they fit; the one that crosses only if that is nearer
    taken = F.when(F.col("until") - F.col("need") <= F.col("need") - (F.col("until") - F.col("size")), F.col("until"))
    close = staged(run.withColumn("in_sum", taken).groupBy("source", "need").agg(
        F.max(F.when(F.col("in_sum").isNotNull(), F.struct("q", F.col("doc_id").isNotNull().alias("has"), "doc_id"))).alias("edge"), F.coalesce(F.max("in_sum"), F.lit(0)).alias("sum")), "close")
    # (sources can be null, so the two tables of one row a source are matched null-safe)
    c = staged(cut.alias("x").join(close.alias("y"), F.col("x.source").eqNullSafe(F.col("y.source"))).select(
        F.col("x.source").alias("c_source"), F.col("x.prefix").alias("prefix"), F.col("y.edge").alias("edge"), (F.col("y.need") - F.col("y.sum")).alias("gap")), "cuts")
    mine = F.struct("q", F.col("doc_id").isNotNull().alias("has"), "doc_id")
    chosen = drawn.join(c, F.col("source").eqNullSafe(F.col("c_source")), "left").withColumn(
        "extra", F.col("q").isNotNull() & F.col("prefix").isNotNull() & ((F.col("bin") < F.col("prefix")) | ((F.col("bin") == F.col("prefix")) & F.coalesce(mine <= F.col("edge"), F.lit(False)))))
    chosen = staged(chosen.select("doc_id", "source", "size", "source_size", "target", "whole", "q", "extra", "gap"), "chosen")
    spare = chosen.where("q is not null and not extra and gap > 0 and abs(gap - size) < gap").groupBy("source").agg(
        F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "q", "doc_id")).alias("b")).select(
        F.col("source").alias("b_source"), F.col("b.q").alias("b_q"), F.col("b.doc_id").alias("b_id"))
    done = chosen.join(spare, F.col("source").eqNullSafe(F.col("b_source")), "left").withColumn(
        "last", ~F.col("extra") & F.coalesce((F.col("q") == F.col("b_q")) & F.col("doc_id").eqNullSafe(F.col("b_id")), F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("extra") | F.col("last"), 1).otherwise(0)).otherwise(0).cast("int")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: a document taken twice has two rows, one not taken
    none. Rows that repeat an id with as many words in the same source are taken alike,
    as often as the one of them that is taken most."""
    key = ["doc_id", "source", "size"]
    taken = mix(docs, **how).groupBy(*key).agg(F.max("copies").alias("copies")).where("copies > 0")
    taken = staged(taken.select(*[F.col(c).alias(f"__{c}") for c in (*key, "copies")]), "taken")
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source")) & (size == F.col("__size"))
    return docs.join(taken, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
