"""Bloom filters of a bounded size over 64-bit hashes.

A filter has a power of two of bits, ``bits_per_key`` for each key but at most
``max_bytes`` in all, so what is merged, collected and broadcast has a fixed bound
whatever the size of the corpus. Tasks send the bits they set as sorted 16-bit places
within chunks of 65,536 bits; the chunks are merged on the executors."""


from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

CHUNK_BITS = 16
HASHES = 3
#: Odd multipliers, one for each of the places a key sets.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_FLUSH = 1 << 19


def log2_bits(keys: int, bits_per_key: int = 16, max_bytes: int = 64 << 20) -> int:
    """Bits as a power of two: enough for ``keys``, at most ``max_bytes``."""
    want = max(1 << CHUNK_BITS, keys * bits_per_key)
    return min((want - 1).bit_length(), (max_bytes * 8).bit_length() - 1)


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES places of each key, one row for each key."""
    return (h[:, None] * FACTORS[None, :]) >> np.uint64(64 - bits)


@dataclass
class Filter:
    words: Broadcast
    bits: int

    def holds(self, h: Column) -> Column:
        """True for every key in the filter, and for few others."""
        words, bits = self.words, self.bits

        @F.pandas_udf("boolean")
        def probe(s: pd.Series) -> pd.Series:
            v = s.fillna(0).to_numpy(dtype=np.int64).view(np.uint64)
            p = places(v, bits)
            got = (words.value[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
            return pd.Series(got.all(axis=1) & s.notna().to_numpy())

        return probe(h)


def _pieces(twice: bool, bits: int):
    """One row for each chunk that a run of rows touches: the places set once or more
    and, if asked, those set by two or more different rows."""
    def run(batches):
        held: list[np.ndarray] = []
        n = 0

        def flush():
            h = np.concatenate(held)
            p = places(h, bits)
            p.sort(axis=1)
            fresh = np.ones(p.shape, dtype=bool)  # a key that sets a place twice counts once
            fresh[:, 1:] = p[:, 1:] != p[:, :-1]
            at, times = np.unique(p[fresh], return_counts=True)
            chunk = (at >> np.uint64(CHUNK_BITS)).astype(np.int64)
            low = (at & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint16)
            cut = np.flatnonzero(np.diff(chunk)) + 1
            ids = chunk[np.concatenate([[0], cut])] if len(chunk) else chunk
            ones = [x.tobytes() for x in np.split(low, cut)] if len(chunk) else []
            twos = [x[t > 1].tobytes() if twice else b"" for x, t in zip(np.split(low, cut), np.split(times, cut))] if len(chunk) else []
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ones, pa.binary()), pa.array(twos, pa.binary())], ["chunk", "once", "twice"])

        for b in batches:
            held.append(b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += len(held[-1])
            if n >= _FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()
    return run


def _merged(twice: bool):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(1 << CHUNK_BITS, dtype=bool)
        again = np.zeros(1 << CHUNK_BITS, dtype=bool)
        for once, two in zip(frame["once"], frame["twice"]):
            at = np.frombuffer(once, dtype=np.uint16)
            again[at[seen[at]]] = True
            again[np.frombuffer(two, dtype=np.uint16)] = True
            seen[at] = True
        return pd.DataFrame({"chunk": [key[0]], "bits": [np.packbits(again if twice else seen, bitorder="little").tobytes()]})
    return run


def build(keys: DataFrame, col: str, n: int, *, twice: bool = False, bits_per_key: int = 16, max_bytes: int = 64 << 20) -> Filter:
    """Filter of the hashes in ``col`` (rows without one are left out); ``n`` is about
    their number. ``twice``: only bits that two or more rows set, so that it holds
    every hash that occurs twice or more and few that occur once."""
    bits = log2_bits(n, bits_per_key, max_bytes)
    parts = keys.select(col).mapInArrow(_pieces(twice, bits), "chunk long, once binary, twice binary")
    rows = parts.groupBy("chunk").applyInPandas(_merged(twice), "chunk long, bits binary").collect()  # at most max_bytes
    words = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in rows:
        words[r["chunk"] << (CHUNK_BITS - 3): (r["chunk"] + 1) << (CHUNK_BITS - 3)] = np.frombuffer(r["bits"], dtype=np.uint8)
    return Filter(keys.sparkSession.sparkContext.broadcast(words), bits)


def without_ids(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (unique, not null): rows that
    a filter of the ids rules out stay where they are, only the others are joined."""
    if n == 0:
        return docs
    key = "__without_id"
    f = build(ids.select(F.xxhash64("doc_id").alias(key)), key, n)
    flagged = docs.withColumn("__maybe", F.coalesce(f.holds(F.xxhash64("doc_id")), F.lit(False)) & F.col("doc_id").isNotNull())
    gone = flagged.where("__maybe").join(ids.select("doc_id"), "doc_id", "left_anti")
    return flagged.where("not __maybe").select(*docs.columns).unionByName(gone.select(*docs.columns))


def with_ids(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (unique doc_id and more columns),
    with those columns: only rows that a filter lets through are joined."""
    f = build(ids.select(F.xxhash64("doc_id").alias("__with_id")), "__with_id", n)
    return docs.where(f.holds(F.xxhash64("doc_id"))).join(ids, "doc_id")
