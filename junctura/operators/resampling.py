"""Bootstraps with reproducible, hash-derived draws.

A draw is a pure function of (replicate, row), so a lost executor recomputes the
same sample. Where only the positives matter, only the positives are replicated.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from junctura.operators.ranking import ranked
from junctura.session import attach, stage


def hash_int(*parts: Column) -> Column:
    """32 uniform bits from the md5 of the parts, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def _cumulative(bits: int) -> tuple[float, ...]:
    """Cumulative Poisson(1) probabilities as far as a draw of so many bits can tell."""
    out, total, k = [], 0.0, 0
    while 1.0 - total >= 2.0**-bits:
        total += math.exp(-1.0) / math.factorial(k)
        out.append(total)
        k += 1
    return tuple(out)


POISSON1 = _cumulative(32)


def replicates(df: DataFrame, b: int) -> DataFrame:
    """Each row once per replicate, in place (no join)."""
    return df.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))


def interval(per_replicate: DataFrame, metrics: list[str], keys: list[str] = ()) -> DataFrame:
    """(metric, mean, lo, hi) at 95 %. One value per replicate: the group is
    bounded by the number of replicates."""
    long = per_replicate.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("s"))
    return long.where(F.col("s.v").isNotNull()).groupBy(*keys, F.col("s.metric").alias("metric")).agg(
        F.avg("s.v").alias("mean"), F.percentile("s.v", 0.025).alias("lo"), F.percentile("s.v", 0.975).alias("hi"))


#: Distinct scores whose weights of all replicates are in memory at once.
_SCORES_AT_ONCE = 512
#: Rows whose scores make one range.
ROWS_PER_RANGE = 8_192
_CUTS = np.array([math.ceil(c * 2**32) for c in POISSON1], np.uint64)


def row_weights(ids: list[str], b: int) -> np.ndarray:
    """Multiplicity of each row in each replicate: four replicates share the md5 of
    ``bs|block|id``, 32 bits each."""
    blocks = -(-b // 4)
    heads, md5 = [f"bs|{k}|".encode() for k in range(blocks)], hashlib.md5
    raw = b"".join([md5(h + i).digest() for i in (x.encode() for x in ids) for h in heads])
    u = np.frombuffer(raw, ">u4").reshape(len(ids), blocks * 4)[:, :b]
    return np.searchsorted(_CUTS, u.astype(np.uint64), side="right").astype(np.uint32)


def _pooled(b: int):
    """(key, score, y, id) to (key, score, y, weights): rows of one score and label are added up on the way."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                keys, scores, ys, ids = (c.to_pylist() for c in batch.slice(at, 2048).columns)
                cells = sorted(set(zip(keys, scores, ys, strict=True)))
                number = {c: k for k, c in enumerate(cells)}
                where = np.array([number[c] for c in zip(keys, scores, ys, strict=True)])
                order = np.argsort(where, kind="stable")
                w = np.add.reduceat(row_weights(ids, b)[order], np.searchsorted(where[order], np.arange(len(cells))), axis=0)
                cols = list(zip(*cells, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()),
                                                  pa.array([x.astype("<u4").tobytes() for x in w], pa.binary())], ["key", "score", "y", "w"])
    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, score, y, weights) with neighbours of one key, score and label added up: a row each."""
    names = ["key", "score", "y", "w"]
    held = None  # the last cell, which the next rows may go on with

    def out(cells: list[tuple], w: np.ndarray) -> pa.RecordBatch:
        cols = list(zip(*cells, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()),
                                           pa.array([x.astype("<u4").tobytes() for x in w], pa.binary())], names)

    for batch in batches:
        for at in range(0, batch.num_rows, _SCORES_AT_ONCE):
            *ids, w = (c.to_pylist() for c in batch.slice(at, _SCORES_AT_ONCE).columns)
            cells, m = list(zip(*ids, strict=True)), np.frombuffer(b"".join(w), "<u4").reshape(len(w), -1)
            if held:
                cells, m = [held[0], *cells], np.vstack([held[1], m])
            first = [i for i, c in enumerate(cells) if not i or c != cells[i - 1]]
            m = np.add.reduceat(m, first, axis=0)
            cells = [cells[i] for i in first]
            if len(cells) > 1:
                yield out(cells[:-1], m[:-1])
            held = cells[-1], m[-1]
    if held:
        yield out([held[0]], held[1][None])


def _matrix(weights: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(weights), "<u4").reshape(len(weights), -1).astype(float)


def _range_totals(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, _SCORES_AT_ONCE):
                part, key, y, w = (c.to_pylist() for c in batch.slice(at, _SCORES_AT_ONCE).columns)
                m, cells = _matrix(w), list(zip(part, key, strict=True))  # a task may read several ranges
                number = {c: k for k, c in enumerate(dict.fromkeys(cells))}
                at_cell, hit = np.array([number[c] for c in cells]), np.array(y) >= threshold
                for c, k in number.items():
                    mine = at_cell == k
                    s = np.stack([m[mine].sum(0), m[mine & hit].sum(0)])
                    held[c] = held.get(c, 0) + s
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held])] + [
                pa.array([v[i].tolist() for v in held.values()], pa.list_(pa.float64())) for i in (0, 1)], ["part", "key", "n", "p"])
    return run


def _deviances(y: np.ndarray, pred: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray]:
    mu = np.maximum(pred, 1e-6)
    tweedie = 2 * (y ** (2 - power) / ((1 - power) * (2 - power)) - y * mu ** (1 - power) / (1 - power) + mu ** (2 - power) / (2 - power))
    return tweedie, 2 * (y * np.log(y / mu + 1e-10) - (y - mu))


def _range_parts(threshold: float, ks: tuple[int, ...], power: float):
    """One range of scores and what stands before it, to sums of each replicate (label
    null) and, for the rank correlation, of each label and replicate."""
    def run(rows: pa.Table, before: pa.Table) -> pa.Table:
        one = before.to_pylist()[0]
        cn, cp, nn, np_ = (np.array(one[c]) for c in ("bn", "bp", "nn", "np"))
        t = rows.sort_by([("score", "descending"), ("y", "ascending")])
        score, y = t.column("score").to_numpy(), t.column("y").to_numpy()
        total = np.zeros((5 + len(ks), len(nn)))
        labels: dict[float, np.ndarray] = {}
        first = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        size = np.diff(np.r_[first, len(score)])
        for at in range(0, len(first), _SCORES_AT_ONCE):
            lo, hi = first[at], first[min(at + _SCORES_AT_ONCE, len(first)) - 1] + size[min(at + _SCORES_AT_ONCE, len(first)) - 1]
            w = _matrix(t.column("w").slice(lo, hi - lo).to_pylist())
            starts = first[at:at + _SCORES_AT_ONCE] - lo
            hit = (y[lo:hi] >= threshold)[:, None]
            n, p = np.add.reduceat(w, starts, axis=0), np.add.reduceat(w * hit, starts, axis=0)
            tn, tp = np.cumsum(n, axis=0) + cn, np.cumsum(p, axis=0) + cp
            below = (nn - np_) - (tn - tp)
            total[0] += (p * tp / np.maximum(tn, 1)).sum(0)
            total[1] += (p * (below + (n - p) / 2)).sum(0)
            ra = (nn - tn) + (n + 1) / 2
            total[2] += (n * ra * ra).sum(0)
            for d, dev in enumerate(_deviances(y[lo:hi], score[lo:hi], power)):
                total[3 + d] += (w * dev[:, None]).sum(0)
            for j, k in enumerate(ks):  # a cut through one score takes its rows in equal shares
                total[5 + j] += (p * np.clip((k - (tn - n)) / np.maximum(n, 1), 0, 1)).sum(0)
            each = np.repeat(ra, size[at:at + _SCORES_AT_ONCE], axis=0)
            for v in np.unique(y[lo:hi]):
                mine = y[lo:hi] == v
                labels[float(v)] = labels.get(float(v), 0) + np.stack([w[mine].sum(0), (w * each)[mine].sum(0)])
            cn, cp = tn[-1], tp[-1]
        reps = np.arange(len(nn))
        out = [(None, total)] + sorted(labels.items())
        values = [x for _, m in out for x in m.T.tolist()]
        return pa.table({"key": pa.array([one["key"]] * len(values)), "b": pa.array(np.tile(reps, len(out)), pa.int32()),
                         "label": pa.array([v for v, _ in out for _ in reps], pa.float64()), "v": pa.array(values, pa.list_(pa.float64()))})
    return run


def bootstrap_metrics(df: DataFrame, score: str, y: str, sid: str, b: int, *, threshold: float = 1, ks: tuple[int, ...] = (),
                      power: float = 1.3, key: str | None = None) -> DataFrame:
    """Per replicate (``b``; ``key`` if given): auprc, auroc, recall_k and precision_k of
    ``y >= threshold``, spearman_rho and the Tweedie and Poisson deviances of ``score`` against ``y``.

    Weights are functions of the id, so all replicates share one order: rows of a score and
    label become one row with an array of weights, these are ranged by score once, totals
    of the ranges before give each range its start, and each range sums its replicates as
    columns of a matrix. Rows never multiply by ``b``, whatever share of them has one score.
    Binary metrics of replicates without both labels are null, as is a correlation
    without spread. Rows with a null score, label or id take no part."""
    k = F.lit("") if key is None else F.col(key).cast("string")
    rows = df.select(k.alias("key"), F.col(score).cast("double").alias("score"), F.col(y).cast("double").alias("y"), F.col(sid).cast("string").alias("id")).dropna()
    # a short row stands for b draws, so rows are dealt out by the work they make, not by their bytes
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = "key string, score double, y double, w binary"
    cells = rows.repartition(tasks, "id").mapInArrow(_pooled(b), made)
    # a range is read whole by one task: there are as many as keep it at a bounded number of rows
    parts = max(tasks, -(-rows.count() // ROWS_PER_RANGE))
    order = ["key", F.desc("score")]
    cells = cells.repartitionByRange(parts, *order).sortWithinPartitions(*order, "y").mapInArrow(_merged, made)
    ranged = stage(cells.withColumn("part", F.spark_partition_id()), "replicates")
    per = ranged.select("part", "key", "y", "w").mapInArrow(_range_totals(threshold), "part int, key string, n array<double>, p array<double>")
    # ranges are put in order replicate by replicate: as many rows in a window as there are ranges
    each = per.select("part", "key", F.posexplode(F.arrays_zip("n", "p")).alias("b", "t")).select("part", "key", "b", F.col("t.n").alias("n"), F.col("t.p").alias("p"))
    all_ = Window.partitionBy("key", "b")
    before = all_.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("part", "key", "b", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"b{c}") for c in ("n", "p")],
                       *[F.sum(c).over(all_).alias(c + c) for c in ("n", "p")])
    cols = {"bn": "bn", "bp": "bp", "nn": "nn", "pp": "np"}
    packed = each.groupBy("part", "key").agg(F.array_sort(F.collect_list(F.struct("b", *cols))).alias("r"))  # one entry a replicate
    start = stage(packed.select("part", "key", *[F.expr(f"transform(r, q -> q.{c})").alias(o) for c, o in cols.items()]), "starts")
    made = ranged.groupBy("part", "key").cogroup(start.groupBy("part", "key")).applyInArrow(_range_parts(threshold, ks, power), "key string, b int, label double, v array<double>")
    width = 5 + len(ks)
    summed = stage(made.groupBy("key", "b", "label").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(width)]), "replicate_sums")
    one = summed.where("label is null").drop("label")
    by_label = Window.partitionBy("key", "b").orderBy("label").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a replicate's distinct labels
    rb = F.sum("s0").over(by_label) - F.col("s0") + (F.col("s0") + 1) / 2
    cross = summed.where("label is not null").select("key", "b", "s0", "s1", rb.alias("rb")).groupBy("key", "b").agg(
        F.sum(F.col("rb") * F.col("s1")).alias("ab"), F.sum(F.col("s0") * F.col("rb") * F.col("rb")).alias("bb"), F.sum("s0").alias("_w"))
    sizes = start.select("key", "nn", "np").distinct().select("key", F.posexplode(F.arrays_zip("nn", "np")).alias("b", "t")).select("key", "b", F.col("t.nn").alias("nn"), F.col("t.np").alias("np"))
    x = one.join(cross, ["key", "b"]).join(sizes, ["key", "b"])
    both = (F.col("np") > 0) & (F.col("np") < F.col("nn"))
    mean2 = F.col("nn") * (F.col("nn") + 1) * (F.col("nn") + 1) / 4
    spread = F.sqrt(F.greatest(F.col("s2") - mean2, F.lit(0.0)) * F.greatest(F.col("bb") - mean2, F.lit(0.0)))
    out = [F.when(both, F.col("s0") / F.col("np")).alias("auprc"), F.when(both, F.col("s1") / (F.col("np") * (F.col("nn") - F.col("np")))).alias("auroc")]
    for j, top in enumerate(ks):
        out += [F.when(both, F.col(f"s{5 + j}") / F.col("np")).alias(f"recall_{top}"), F.when(both, F.col(f"s{5 + j}") / F.least(F.lit(float(top)), F.col("nn"))).alias(f"precision_{top}")]
    out += [((F.col("ab") - mean2) / F.nullif(spread, F.lit(0.0))).alias("spearman_rho"), (F.col("s3") / F.col("nn")).alias("tweedie_deviance"), (F.col("s4") / F.col("nn")).alias("poisson_deviance")]
    return x.where("nn > 0").select(*([F.col("key").alias(key)] if key else []), "b", *out)


def metric_names(ks: tuple[int, ...]) -> list[str]:
    return ["auprc", "auroc", *[f"{m}_{k}" for k in ks for m in ("recall", "precision")], "spearman_rho", "tweedie_deviance", "poisson_deviance"]


def draws_of_positives(df: DataFrame, sid: str, y: str, b: int, rank_cols: list[str]) -> DataFrame:
    """b resamples, with replacement, of the positives: (b, i, drawn id, ranks).
    Only positives are replicated, and the drawn index is looked up by an equality
    join, so the size is b x positives. The positives grow with the data, so the join
    is a shuffle: nothing passes through the driver."""
    pos = stage(ranked(df.where(F.col(y) >= 1).select(sid, *rank_cols), [(sid, False)], "_i"), "positives")
    n = pos.agg(F.count("*").alias("n_pos"))
    d = attach(replicates(pos.select(F.col("_i").alias("i")), b), n)
    d = d.withColumn("_i", hash_int(F.lit("pd"), F.col("b"), F.col("i")) % F.col("n_pos") + 1)
    return d.join(pos.hint("merge"), "_i").select("b", "i", sid, "n_pos", *rank_cols)


def recall_interval(draws: DataFrame, sid: str, rank: str, k: int, unique: bool = False) -> DataFrame:
    """95 % interval of recall@k. ``unique`` counts each drawn site once (the
    biased variant), kept as an option."""
    hit = F.col(rank) <= k
    num = F.count_distinct(F.when(hit, F.col(sid))) if unique else F.count_if(hit)
    per = draws.groupBy("b").agg((num / F.max("n_pos")).alias("recall"))
    return interval(per, ["recall"])


def paired_delta(draws: DataFrame, rank_a: str, rank_b: str, k: int) -> DataFrame:
    """Difference in recall@k of two rankings on the same draws."""
    per = draws.groupBy("b").agg(
        ((F.count_if(F.col(rank_a) <= k) - F.count_if(F.col(rank_b) <= k)) / F.max("n_pos")).alias("d"))
    return per.agg(F.avg("d").alias("delta"), F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"),
                   F.avg(F.when(F.col("d") > 0, 1.0).otherwise(0.0)).alias("p_better"))
