"""Near-duplicate documents by one-permutation MinHash, banded buckets and star links."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from junctura.llm import bloom
from junctura.llm.common import staged, text_of
from junctura.llm.stars import star_components

SHINGLE = 5
BANDS, ROWS = 21, 6
THRESHOLD_PERCENT = 85
# Odd multipliers of the word and shingle hashes, and the seed of the bins' order.
STEP, MIX1, MIX2, SEED = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 20_17
_WORDS_KEPT = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, width: int = SHINGLE):
        import xxhash
        self.hash, self.width, self.words = xxhash.xxh3_64_intdigest, width, {}

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        known = self.words
        if len(known) > _WORDS_KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.width, len(h))
        if not k:
            return h
        acc = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            acc = acc * np.uint64(STEP) + h[i:len(h) - k + 1 + i]
        return np.unique(_mix(acc))


class Signer:
    """Band keys of a set of hashes. One permutation: the hash range is cut into bins and
    each keeps its lowest value. An empty bin borrows from the first full bin in a random
    order of its own (Shrivastava, 2017: optimal densification)."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(SEED)
        self.order = np.stack([rng.permutation(self.bins) for _ in range(self.bins)])
        self.salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(STEP)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        full, first = np.unique(at, return_index=True)  # sorted, so the first of a bin is its lowest
        low = np.zeros(self.bins, dtype=np.uint64)
        low[full] = hashes[first]
        if len(full) < self.bins:
            has = np.zeros(self.bins, dtype=bool)
            has[full] = True
            empty = np.flatnonzero(~has)
            order = self.order[empty]
            low[empty] = low[order[np.arange(len(empty)), has[order].argmax(axis=1)]]
        key = self.salt.copy()
        for r in range(self.rows):
            key = _mix(key + low[r::self.rows] * np.uint64(STEP))
        return key


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(width), Signer(bands, rows)
        for b in batches:
            sizes, names, keys = [], [], []
            for text in b.column(1).to_pylist():
                s = shingler.of(text)
                sizes.append(len(s))
                names.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(signer.of(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                                             ["doc_id", "n", "same", "keys"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingler.of(t).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["id", "shingles"])
    return run


def near_groups(docs: DataFrame, *, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text).

    Texts with equal shingle sets are one class with its lowest id. The classes' band
    keys make buckets. In each bucket a few members, the lowest by hashes of the round,
    are the centres of stars: each is compared with the members that are not yet in its
    component, on the full sets, so a bucket of n members costs a few n pairs a round and
    never their square. The next round takes new centres for what is still apart, until a round
    finds no link or a few rounds are over. Buckets that are then not one component are finished exactly, large ones
    by the rarest shingles of their members. Links and components live in tables; none come
    to the driver.

    A text without words has no shingles, links with nothing and stays. A null id links
    with nothing, stays and has no component. Rows that repeat an id are one node: a
    link of one is a link of all. With fewer than ``width`` words the whole text is one
    shingle."""
    texts = docs.select("doc_id", text_of().alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    signed = staged(texts.mapInArrow(_sign(width, bands, rows), f"doc_id {kind}, n long, same binary, keys array<long>"), "signed")
    classes = staged(signed.where("doc_id is not null and same is not null").groupBy("same").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    banded = classes.select("id", "n", F.explode("keys").alias("key"))
    shared = staged(banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "shared")
    members = staged(banded.join(shared, "key"), "members")
    comp = None
    if not members.isEmpty():
        ids = staged(members.select(F.col("id").alias("doc_id")).distinct(), "ids")
        sets = staged(bloom.with_ids(texts, ids, ids.count()).select("doc_id", "text").mapInArrow(_sets(width), f"id {kind}, shingles array<long>"), "sets")

        def confirmed(pairs: DataFrame) -> DataFrame:
            # only sets of this round's pairs are shuffled; centres first, so that their sets
            # travel to the members, which are many and even
            ids = pairs.select(F.xxhash64("center").alias("h")).union(pairs.select(F.xxhash64("member"))).distinct()
            near = sets.where(bloom.build(ids, "h", 2 * pairs.count()).holds(F.xxhash64("id")))
            a = pairs.join(near.select(F.col("id").alias("center"), F.col("shingles").alias("cs")), "center")
            b = a.join(near.select(F.col("id").alias("member"), F.col("shingles").alias("ms")), "member")
            both = F.array(F.size(F.array_intersect("cs", "ms")))  # bound once for both of its uses
            alike = F.exists(both, lambda n: 100 * n >= percent * (F.size("cs") + F.size("ms") - n))
            return b.where(alike).select("center", "member")

        fits = 100 * F.least("n", "cn") >= percent * F.greatest("n", "cn")
        comp = star_components(members, confirmed, fits, lambda ids: sets.join(ids, "id").select("id", F.col("shingles").alias("tokens")), percent)
    node = classes.select("same", "id")
    if comp is not None:
        node = node.join(comp, node["id"] == comp["node"], "left").select("same", F.coalesce("component", "id").alias("id"))
    node = staged(node, "nodes")
    known = F.col("doc_id").isNotNull() & F.col("same").isNotNull()
    out = signed.select("doc_id", "n", F.when(known, F.col("same")).alias("same")).join(node, "same", "left")
    component = F.coalesce("id", "doc_id")
    out = staged(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")), "grouped")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents whose component another one stands for."""
    gone = staged(near_groups(docs, **how).where("not kept").select("doc_id").distinct(), "gone")
    return bloom.without_ids(docs, gone, gone.count())
