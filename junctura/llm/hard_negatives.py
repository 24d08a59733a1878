"""Hard negatives from Hilbert-ordered Parquet blocks whose zone maps say which of them can matter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from junctura.llm.common import release, staged

#: Rows of a candidate block, anchors of a chunk, zone maps of a page.
BLOCK, CHUNK, PAGE = 1024, 256, 64
#: The curve runs through the components that vary most, with so many bits of each.
CURVE_DIMS, CURVE_BITS = 9, 7
SCALE = 256
POSITIVES = NEGATIVES = 5
#: Per cent of the positive's score that a negative reaches at least.
LEAST_PERCENT = 80
ANCHORS_EVERY = 100
#: From this magnitude on doubles leave out integers; sums that can reach it are made of Python's.
_EXACT = 2.0 ** 53
_HIGH, _LOW = 2 ** 63 - 1, 1 - 2 ** 63
_NONE = -2 ** 63  # the score of a row that a search must not return

_ROWS = "block long, label_lo long, label_hi long, n int, dims int, lo array<double>, hi array<double>, ids array<long>, labels array<long>, rows binary"
_CHUNKS = "chunk", "chunk_ids", "chunk_labels", "chunk_dims", "chunk_rows"


@contextmanager
def _batches_of(spark: SparkSession, rows: int):
    """Arrow batches of few rows, for rows that each hold a block of vectors."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, label, q (components as whole numbers in doubles) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double") * SCALE)
    whole = F.transform(v, lambda x: F.when(F.abs(x) >= _EXACT, x).otherwise(F.floor(x).cast("double")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), whole.alias("q"))
    return rows.where(F.forall("q", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)))


# ---- the curve

def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sum and sum of squares of each component, one row for each and task."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        q = b.column(0)
        values, ends = np.asarray(q.flatten(), float), np.asarray(q.offsets) - q.offsets[0].as_py()
        place = np.arange(len(values)) - np.repeat(ends[:-1], np.diff(ends))
        d = int(place.max()) + 1 if len(place) else 0
        s = np.stack([np.bincount(place, w, d) for w in (None, values, values * values)]) if d else np.zeros((3, 0))
        for k in range(d):
            total[k] = total.get(k, 0) + s[:, k]
    keys = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32())] + [pa.array([float(total[k][i]) for k in keys], pa.float64()) for i in range(3)], ["place", "n", "s", "ss"])


def curve_axes(rows: DataFrame) -> list[tuple[int, float, float]]:
    """(place, lowest, width) of the components that vary most, over all rows; the
    driver gets ``CURVE_DIMS`` rows."""
    mean = F.sum("s") / F.sum("n")
    spread = F.sum("ss") / F.sum("n") - mean * mean
    got = rows.select("q").mapInArrow(_sums, "place int, n double, s double, ss double").groupBy("place").agg(mean.alias("mean"), spread.alias("spread"))
    top = got.orderBy(F.desc("spread"), "place").limit(CURVE_DIMS).collect()
    out = []
    for r in top:
        sd = math.sqrt(max(r["spread"], 0.0)) if math.isfinite(r["spread"]) else 0.0
        out.append((r["place"], r["mean"] - 3 * sd, 6 * sd or 1.0))
    return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (whole numbers of ``bits``
    bits), by Skilling's transform: undo the turns from the coarsest bit down, then
    Gray-decode."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    if not d:
        return np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(d):
            turned = (x[i] >> bit & 1).astype(bool)
            swap = (x[0] ^ x[i]) & low
            first = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(turned, x[i], x[i] ^ swap)
            x[0] = first
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[d - 1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= flip
    h = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            h = (h << 1) | (x[i] >> bit & 1)
    return h


def _matrix(q: list, dims: int | None = None) -> np.ndarray:
    """Rows padded with zeros to one length."""
    d = max(map(len, q), default=0) if dims is None else dims
    out = np.zeros((len(q), d))
    for i, r in enumerate(q):
        out[i, :len(r)] = r
    return out


def _place(axes: list[tuple[int, float, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(2).to_pylist())
            cells = np.zeros((b.num_rows, len(axes)))
            for k, (place, lowest, width) in enumerate(axes):
                if place < m.shape[1]:
                    cells[:, k] = (m[:, place] - lowest) / width
            cells = np.clip(np.floor(np.nan_to_num(cells) * (1 << CURVE_BITS)), 0, (1 << CURVE_BITS) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert(cells, CURVE_BITS))], ["vec_id", "label", "q", "h"])
    return run


# ---- blocks

def _packed(m: np.ndarray) -> bytes:
    top = np.abs(m).max(initial=0)
    return m.astype("<i2" if top < 2 ** 15 else "<i4" if top < 2 ** 31 else "<f8").tobytes()


def _unpacked(data: bytes, n: int, dims: int) -> np.ndarray:
    if not n * dims:
        return np.zeros((n, dims))
    return np.frombuffer(data, {2: "<i2", 4: "<i4", 8: "<f8"}[len(data) // (n * dims)]).reshape(n, dims).astype(float)


def _cut(size: int):
    """Sorted rows (vec_id, label, q, h) to blocks of ``size``: ids in order, a zone map of
    the labels and of each component, and the vectors. Rows equal in all of id, label and
    vector stand once."""
    def block(number: int, rows: list) -> list:
        rows.sort(key=lambda r: r[0])
        m, labels = _matrix([r[2] for r in rows]), [r[1] for r in rows]
        return [number, min(labels), max(labels), len(rows), m.shape[1], m.min(0).tolist(), m.max(0).tolist(), [r[0] for r in rows], labels, _packed(m)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        names = [c.split()[0] for c in _ROWS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        held, done, key, seen = [], 0, None, set()

        def flush() -> pa.RecordBatch:
            nonlocal held, done
            got = block(first + done, held)
            held, done = [], done + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(got, kinds, strict=True)], names)

        for b in batches:
            for i, label, q, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (label, h, i):
                    key, seen = (label, h, i), set()
                if (vector := tuple(q)) not in seen:
                    seen.add(vector)
                    held.append((i, label, q))
                    if len(held) == size:
                        yield flush()
        if held:
            yield flush()
    return run


def blocks_of(placed: DataFrame, size: int, name: str) -> DataFrame:
    """Staged blocks of rows that lie together: by label, then along the curve."""
    ordered = placed.repartitionByRange("label", "h", "vec_id").sortWithinPartitions("label", "h", "vec_id").select("vec_id", "label", "q", "h")
    return staged(ordered.mapInArrow(_cut(size), _ROWS), name)


# ---- interval bounds and scores

def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest inner product of each anchor with any vector between ``lo``
    and ``hi``, by interval arithmetic; widened where doubles round."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    least, most = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
    reach = np.abs(anchors) @ np.maximum(np.abs(lo), np.abs(hi)).T
    slack = np.where(reach < _EXACT, 0.0, reach * 2.0 ** -40)
    return np.clip(least - slack, _LOW, _HIGH), np.clip(most + slack, _LOW, _HIGH)  # as scores are


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products as longs; those beyond a long count as the nearest one."""
    d = min(anchors.shape[1], rows.shape[1])
    a, r = anchors[:, :d], rows[:, :d]
    if np.abs(a).max(initial=0) * np.abs(r).max(initial=0) * max(d, 1) < _EXACT:
        return (a @ r.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(r).T, _LOW, _HIGH).astype(np.int64)


def _windows(entries: list, m: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) score of each anchor's windows; an absent one is empty."""
    low, high = np.full((m, k), _HIGH), np.full((m, k), _LOW)
    for e in entries:
        low[e["i"], e["k"]], high[e["i"], e["k"]] = e["low"], e["high"]
    return low, high


class _Chunk:
    def __init__(self, r: dict, k: int):
        self.ids, self.labels = np.array(r["chunk_ids"], np.int64), np.array(r["chunk_labels"], np.int64)
        self.rows = _unpacked(r["chunk_rows"], len(self.ids), r["chunk_dims"])
        self.low, self.high = _windows(r["windows"], len(self.ids), k)
        self.live = np.flatnonzero((self.low <= self.high).any(1))


def _page(chunk: _Chunk, zones: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of a chunk's anchors over the blocks of a page, and whether all, or any, of a block's labels are the anchor's."""
    lo, hi = _matrix([z["lo"] for z in zones]), _matrix([z["hi"] for z in zones])
    d = min(lo.shape[1], chunk.rows.shape[1])  # components that one side lacks are zero
    least, most = bounds(chunk.rows[:, :d], lo[:, :d], hi[:, :d])
    from_, to = (np.array([z[c] for z in zones], np.int64) for c in ("label_lo", "label_hi"))
    mine = chunk.labels[:, None]
    return least, most, (from_ == to) & (from_ == mine), (from_ <= mine) & (mine <= to)


def _guarantee(same: bool, want: int, k: int):
    """(chunk, i, k, low): a score that at least ``want`` rows of a page reach within the
    window, from blocks that lie in it as a whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                c, n = _Chunk(r, k), np.array([z["n"] for z in r["zones"]])
                least, most, all_mine, any_mine = _page(c, r["zones"])
                fit = all_mine if same else ~any_mine
                order = np.argsort(-least, axis=1, kind="stable")
                for i in c.live:
                    o = order[i]
                    for w in np.flatnonzero(c.low[i] <= c.high[i]):
                        inside = fit[i, o] & (most[i, o] <= c.high[i, w]) & (least[i, o] >= c.low[i, w])
                        count = np.cumsum(np.where(inside, n[o], 0))
                        at = int(np.searchsorted(count, want + same))  # the anchor itself is one of its label's
                        if at < len(o):
                            out.append((r["chunk"], int(i), int(w), min(max(math.floor(least[i, o[at]]), _LOW), _HIGH)))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["chunk", "i", "k", "low"])
    return run


def _needed(same: bool, k: int):
    """(chunk, block, anchors): the anchors whose windows a block can reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                c = _Chunk(r, k)
                least, most, all_mine, any_mine = _page(c, r["zones"])
                reach = any_mine if same else ~all_mine
                meets = ((most[:, :, None] >= c.low[:, None, :]) & (least[:, :, None] <= c.high[:, None, :]) & (c.low <= c.high)[:, None, :]).any(2)
                for z in np.flatnonzero((reach & meets).any(0)):
                    out.append((r["chunk"], r["zones"][z]["block"], np.flatnonzero((reach & meets)[:, z]).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["chunk", "block", "anchors"])
    return run


def _score(same: bool, want: int, k: int):
    """(chunk, i, k, vec_id, score): the first ``want`` rows of a block in each window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            for r in b.to_pylist():
                c, ids, labels = _Chunk(r, k), np.array(r["ids"], np.int64), np.array(r["labels"], np.int64)
                mine, rows = np.array(r["anchors"]), _unpacked(r["rows"], r["n"], r["dims"])
                s = scores(c.rows[mine], rows)
                alike = c.labels[mine, None] == labels
                s[~alike if same else alike] = _NONE
                if same:
                    for i, j in zip(*np.nonzero(c.ids[mine, None] == ids), strict=True):  # the anchor's own row
                        d = min(rows.shape[1], c.rows.shape[1])
                        if (rows[j, :d] == c.rows[mine[i], :d]).all() and not rows[j, d:].any() and not c.rows[mine[i], d:].any():
                            s[i, j] = _NONE
                order = np.argsort(~s, axis=1, kind="stable")  # high scores first, then small ids
                ranked = np.take_along_axis(s, order, 1)
                for w in range(k):
                    low, high = c.low[mine, w], c.high[mine, w]
                    start = (ranked > high[:, None]).sum(1)
                    for step in range(want):
                        at = start + step
                        i = np.flatnonzero(at < len(ids))
                        i = i[(ranked[i, at[i]] >= low[i]) & (ranked[i, at[i]] > _NONE) & (low[i] <= high[i])]
                        for x, v in zip(out, (np.full(len(i), r["chunk"]), mine[i], np.full(len(i), w), ids[order[i, at[i]]], ranked[i, at[i]]), strict=True):
                            x.append(v)
            kinds = pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, kinds, strict=True)], ["chunk", "i", "k", "vec_id", "score"])
    return run


def search(chunks: DataFrame, windows: DataFrame, blocks: DataFrame, *, same: bool, want: int, k: int) -> DataFrame:
    """chunk, i, k, vec_id, score and rank: for each window (chunk, i, k, low, high) of
    the anchor at place ``i`` of ``chunk`` the first ``want`` rows of the same label
    (``same``; the anchor itself is left out) or of other labels, by score, then id.

    First, zone maps alone: blocks that lie in a window as a whole raise its lower end to
    what ``want`` rows surely reach. Then the blocks that can still reach a window are
    named, and only those are read and scored. Chunks meet pages of zone maps by a
    number that both carry, every chunk each page once."""
    spark = chunks.sparkSession
    zones = blocks.select("block", "label_lo", "label_hi", "n", "lo", "hi")
    pages = staged(zones.groupBy(F.shiftright("block", PAGE.bit_length() - 1).alias("page")).agg(F.collect_list(F.struct(*zones.columns)).alias("zones")), "zone_pages")
    parts = max(1, pages.count())
    pages = pages.select(F.pmod(F.xxhash64("page"), F.lit(parts)).alias("part"), "zones")

    def against_pages(w: DataFrame) -> tuple[DataFrame, DataFrame]:
        held = w.groupBy("chunk").agg(F.collect_list(F.struct("i", "k", "low", "high")).alias("windows"))  # a chunk's, at most CHUNK * k
        full = chunks.join(held, "chunk")
        each = full.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        return each.join(pages, "part").select(*_CHUNKS, "windows", "zones"), full

    with _batches_of(spark, 16):
        pairs, _ = against_pages(windows)
        raised = pairs.mapInArrow(_guarantee(same, want, k), "chunk long, i int, k int, low long").groupBy("chunk", "i", "k").agg(F.max("low").alias("sure"))
        raised = windows.join(raised, ["chunk", "i", "k"], "left").select("chunk", "i", "k", F.greatest("low", "sure").alias("low"), "high")
        raised = staged(raised, "windows")
        pairs, full = against_pages(raised)
        reads = staged(pairs.mapInArrow(_needed(same, k), "chunk long, block long, anchors array<int>"), "block_reads")
        held = blocks.select("block", "n", "dims", "ids", "labels", "rows")
        found = reads.join(full, "chunk").join(held, "block").select(*_CHUNKS, "windows", "anchors", "n", "dims", "ids", "labels", "rows")
        found = staged(found.mapInArrow(_score(same, want, k), "chunk long, i int, k int, vec_id long, score long"), "scored")
    best = Window.partitionBy("chunk", "i", "k").orderBy(F.desc("score"), "vec_id")
    out = staged(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= want), "nearest")
    release(raised, found)
    return out


def mine(vectors: DataFrame, *, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, embedding, label and any others. Rows with a null id, label or
    vector, or with a component that is null or not finite, take no part. Rows equal in id,
    label and vector count once; other rows that share an id stay rows of their own, and only
    the anchor's own row is no positive of it. Vectors of unequal length meet as if the
    shorter ended in zeros; an empty one scores 0. A label that is alone has no positives and
    no rows; positives with scores below 0 have empty windows. Scores beyond a long count
    as the nearest long. An empty table gives no row."""
    rows = staged(clean(vectors), "vectors")
    axes = curve_axes(rows)
    placed = staged(rows.mapInArrow(_place(axes), "vec_id long, label long, q array<double>, h long"), "placed")
    release(rows)
    candidates = blocks_of(placed, block, "blocks")
    a = blocks_of(placed.where(F.col("vec_id") % ANCHORS_EVERY == 0), chunk, "anchors")
    release(placed)
    chunks = a.select(F.col("block").alias("chunk"), F.col("ids").alias("chunk_ids"), F.col("labels").alias("chunk_labels"), F.col("dims").alias("chunk_dims"), F.col("rows").alias("chunk_rows"))
    every = a.select(F.col("block").alias("chunk"), F.posexplode("ids").alias("i", "anchor_id"))
    open_ = every.select("chunk", "i", F.lit(0).alias("k"), F.lit(_LOW).alias("low"), F.lit(_HIGH).alias("high"))
    positives = search(chunks, open_, candidates, same=True, want=POSITIVES, k=1).select(
        "chunk", "i", (F.col("rank") - 1).alias("k"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    p = F.col("positive_score")
    less = 100 - LEAST_PERCENT  # p minus so many per cent, rounded down, without overflow
    least = F.when(p < 0, _HIGH).otherwise(p - less * F.expr("positive_score div 100") - F.floor(less * (p % 100) / 100))
    windows = positives.select("chunk", "i", "k", least.cast("long").alias("low"), p.alias("high"))
    negatives = search(chunks, windows, candidates, same=False, want=NEGATIVES, k=POSITIVES)
    out = negatives.join(positives, ["chunk", "i", "k"]).join(every, ["chunk", "i"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
