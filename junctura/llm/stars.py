"""Links within buckets by stars: every pair that is looked at has a centre."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from junctura.llm.common import release, staged, sweep
from junctura.llm.components import components

#: Centres of a bucket in the first round and in later ones.
CENTRES, MORE_CENTRES = 3, 3
#: Rounds of stars at most; they only make what is left for the exact finish small.
ROUNDS = 4
#: Members of an unfinished bucket up to which all its pairs are compared; larger ones go through rare tokens.
SMALL = 4
#: Words of 64 bits in the sketch of a set.
SKETCH_WORDS = 16
#: Tokens are counted in so many slots; the fullest of them, by steps of four, stand last in the order of rarity.
SLOTS, COMMON_SLOTS, COMMON_ROWS = 1 << 20, 20_000, 32
#: Bits of a token below its level, of which there are at most 32.
TOKEN_BITS = 58


def sketched(sets: DataFrame) -> DataFrame:
    """(id, n, w0, w1, ...) of ``sets`` (id, n, tokens): ``n``, at least the size of the set, and a bitmap with
    a bit for each of ``tokens``, those tokens of the set that have a property of their own. Tokens may repeat,
    and so may rows."""
    h = sets.select("id", "n", F.explode_outer("tokens").alias("t")).select("id", "n", F.xxhash64("t").alias("h"), F.col("t").isNotNull().alias("some"))
    bit = F.expr("CASE WHEN some THEN shiftleft(1L, cast(h & 63 AS int)) ELSE 0L END")
    word = F.shiftright("h", 6).bitwiseAND(F.lit(SKETCH_WORDS - 1))
    return h.select("id", "n", word.alias("word"), bit.alias("bit")).groupBy("id").agg(
        F.max("n").alias("n"), *[F.bit_or(F.when(F.col("word") == j, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{j}") for j in range(SKETCH_WORDS)])


def folded(sketches: DataFrame) -> DataFrame:
    """``sketches`` in half as many words."""
    half = SKETCH_WORDS // 2
    return sketches.select("id", "n", *[F.col(f"w{j}").bitwiseOR(F.col(f"w{j + half}")).alias(f"w{j}") for j in range(half)])


def sketches_fit(percent: int, words: int = SKETCH_WORDS) -> Column:
    """Whether the sketches of two sets (``n``, ``w0``, ... and ``cn``, ``cw0``, ...) leave room for a similarity
    of ``percent``. Bits that differ are never more than the tokens that only one set has, so no alike pair is lost."""
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"w{j}").bitwiseXOR(F.col(f"cw{j}"))) for j in range(words)])
    return (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("cn"))


def _rarity(sets: DataFrame) -> Callable[[Column], Column]:
    """Tokens as one number each, whose order puts rare ones first: a level above ``TOKEN_BITS`` bits of
    the token. Any order of the tokens finds the same pairs, so the slots that come to the driver, a
    bounded number, only save work; tokens that agree in these bits only add pairs to confirm."""
    slot = lambda t: F.pmod(t, F.lit(SLOTS))
    full = sets.select(F.explode("tokens").alias("t")).groupBy(slot(F.col("t")).alias("slot")).agg(F.count("*").alias("c")).where(F.col("c") > COMMON_ROWS)
    levels: dict[int, list[int]] = {}
    for r in full.orderBy(F.desc("c"), "slot").limit(COMMON_SLOTS).collect():
        levels.setdefault((r["c"].bit_length() + 1) // 2, []).append(r["slot"])

    def key(t: Column) -> Column:
        level = F.lit(0)
        for k, slots in sorted(levels.items()):
            level = F.when(slot(t).isin(slots), k).otherwise(level)
        return F.shiftleft(level.cast("bigint"), TOKEN_BITS).bitwiseOR(t.bitwiseAND(F.lit((1 << TOKEN_BITS) - 1)))
    return key


def _crossing(at: DataFrame, key: str, near: Column) -> DataFrame:
    """(center, member) of all pairs in different components that share ``key``. Of the
    largest component under a key no member is a centre, so a large group that is one
    component meets only what is outside it."""
    sizes = at.groupBy(key, "comp").agg(F.count("*").alias("c"))
    lead = sizes.groupBy(key).agg(F.max(F.struct("c", "comp"))["comp"].alias("lead"), F.count("*").alias("comps")).where("comps > 1").select(key, "lead")
    placed = staged(at.join(lead, key), "crossing")
    sweep(at.sparkSession)
    others = placed.where("comp != lead").select(key, *[F.col(c).alias(f"c{c}") for c in at.columns if c != key])
    once = (F.col("comp") == F.col("lead")) | (F.col("id") > F.col("cid"))
    return placed.join(others, key).where((F.col("comp") != F.col("ccomp")) & once & near).select(F.col("cid").alias("center"), F.col("id").alias("member")).distinct()


def _remaining(at: DataFrame, fits: Column, tokens: Callable[[DataFrame], DataFrame], percent: int,
               small: int, sketches: DataFrame | None, more: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Pairs (center, member) that can be alike among what shares an unfinished bucket of
    ``at`` (key, id, n, comp). Members of buckets over ``small`` meet by the rarest tokens of their
    sets: of n tokens n - ceil(n percent / 100) + 1, of which alike sets share one. What
    can still be common after the tokens' places must reach the similarity."""
    unfinished = at.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "c")
    rest = staged(at.join(unfinished, "key").select("key", "id", "n", "comp", (F.col("c") <= small).alias("small"), (F.col("c") <= SMALL).alias("least")), "rest")
    sweep(at.sparkSession)
    few = rest.where("small").drop("small", "least")
    if more is not None:
        wide = staged(rest.where("not least").groupBy("id").agg(F.first("n").alias("n"), F.first("comp").alias("comp")), "wide")
        few = few.union(more(wide.select("id")).join(wide, "id").select("key", "id", "n", "comp"))
    if sketches is None:
        pairs = _crossing(few, "key", fits)
    else:
        pairs = _crossing(few.drop("n").join(folded(sketches), "id"), "key", sketches_fit(percent, SKETCH_WORDS // 2))
    large = rest.where("not small").groupBy("id").agg(F.first("comp").alias("comp"))
    if large.isEmpty():
        return pairs
    sets = staged(tokens(large.select("id")).join(large, "id"), "token_sets")
    release(rest)
    n = F.size("tokens")
    count = n - F.ceil(n * percent / 100).cast("int") + 1
    key = _rarity(sets)
    rare = sets.where(n > 0).select("id", "comp", n.alias("n"), F.posexplode(F.slice(F.sort_array(F.transform("tokens", key)), F.lit(1), count)).alias("place", "token"))
    rare = staged(rare, "rare")
    release(sets)
    reach = (100 + percent) * F.least(F.col("n") - F.col("place"), F.col("cn") - F.col("cplace")) >= percent * (F.col("n") + F.col("cn"))
    pairs = pairs.union(_crossing(rare, "token", fits & reach)).distinct()
    release(rare)
    return pairs


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` after ``links`` between whole components: only their labels meet."""
    label = comp.select(F.col("node").alias("id"), "component")
    over = links.join(label.withColumnRenamed("id", "center").withColumnRenamed("component", "x"), "center", "left").join(
        label.withColumnRenamed("id", "member").withColumnRenamed("component", "y"), "member", "left").select(
        F.coalesce("x", "center").alias("a"), F.coalesce("y", "member").alias("b"))
    merged = staged(components(over, "a", "b"), "merged")
    moved = comp.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select(
        "node", F.coalesce("to", "component").alias("component"))
    fresh = merged.join(comp, "node", "left_anti").select("node", "component")
    out = staged(moved.union(fresh), "components")
    release(comp, merged)
    return out


def star_components(members: DataFrame, confirmed: Callable[[DataFrame], DataFrame], fits: Column, tokens: Callable[[DataFrame], DataFrame],
                    percent: int, centres: int = CENTRES, tolerance: float = 0.0, small: int = SMALL, sketches: DataFrame | None = None,
                    more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of the ids that links within the buckets ``members`` (key, id, n)
    join; ids without a link have no row. ``confirmed`` keeps the pairs (center, member)
    whose sets are alike to ``percent``; ``fits`` is a cheap test on the sizes ``n`` and
    ``cn``; ``tokens`` gives (id, tokens array<long>), the sets of a table of ids.

    Each round the members of a bucket with the lowest hashes of that round are its
    centres; each is paired with the members that are in other components: a few pairs
    for a member, however large the bucket. What is still apart gets new centres in the
    next round, until a round adds no link, or no more than the share ``tolerance`` of
    the links found before, or after ``ROUNDS`` rounds. Then every bucket that is not yet one component is finished
    exactly: all its pairs across components that can be alike are compared, in buckets of
    up to ``small`` members one by one. Where ``sketches`` (``sketched``) are given these decide in
    place of ``n``, which nothing reads then; ``more`` gives further buckets (key, id) to the ids of
    unfinished buckets of more than ``SMALL``."""
    near = fits if sketches is None else F.lit(True)
    tried = comp = None
    turn = found = 0
    last = False
    while True:
        if comp is None:
            at = members.withColumn("comp", F.col("id"))
        else:
            at = members.join(comp, members["id"] == comp["node"], "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp"))
            at = staged(at, "placed")
        if last:
            pairs = _remaining(at, fits, tokens, percent, small, sketches, more)
        else:
            hashes = range(centres) if turn == 0 else range(turn * MORE_CENTRES, (turn + 1) * MORE_CENTRES)
            lows = [F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), "id", "n", "comp")) for i in hashes]
            apart = at.groupBy("key").agg(F.array(*lows).alias("cs"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
            apart = staged(apart.select("key", F.explode(F.array_distinct(F.transform("cs", lambda c: F.struct(c["id"].alias("id"), c["n"].alias("n"), c["comp"].alias("comp"))))).alias("c"))
                           .select("key", F.col("c.id").alias("center"), F.col("c.n").alias("cn"), F.col("c.comp").alias("ccomp")), "centres")
            pairs = at.join(apart, "key").where((F.col("comp") != F.col("ccomp")) & near).select("center", F.col("id").alias("member")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["center", "member"], "left_anti")
        pairs = staged(pairs, "pairs")
        links = staged(confirmed(pairs).distinct(), "links")
        sweep(links.sparkSession)
        if comp is not None:
            release(at)
        if not last:
            release(apart)
        new = links.count()
        if new:
            comp = staged(components(links, "center", "member"), "components") if comp is None else _joined(comp, links)
        if last:
            return comp if comp is not None else components(links, "center", "member")
        back = pairs.union(pairs.select(F.col("member").alias("center"), F.col("center").alias("member")))
        tried = back if tried is None else tried.union(back)
        last = new == 0 or (turn > 0 and new <= tolerance * found) or turn + 1 == ROUNDS
        turn += 1
        found += new
