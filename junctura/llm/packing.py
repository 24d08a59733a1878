"""Best-fit packing of tokenised documents into sequences of a fixed length.

The plan depends only on how many pieces there are of each length, so it is made once
from a histogram with one entry for each length; the pieces themselves are tokenised,
numbered and placed on the executors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from junctura.llm.common import release, staged, text_of

CONTEXT = 1024
END_ID = 2
RANK_FILE = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}  # fixed value of the vocabulary
_CACHED_WORDS = 200_000


class Coder:
    """Text to little-endian 32-bit ids. A word keeps its ids between texts: in texts
    without two white-space characters in a row the merges never cross the space before
    a word, so the text is its words' ids in turn. Other texts are encoded whole."""

    def __init__(self, rank_file: str | None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(rank_file or public_tokenizers.path(RANK_FILE), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.two_spaces = re.compile(r"\s\s").search
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.enc.encode(text, allowed_special="all"), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|endoftext|>" in text or self.two_spaces(text):
            return self.whole(text)
        head, *rest = text.split(" ")
        words = self.words
        if len(words) > _CACHED_WORDS:
            words.clear()
        for w in set(rest).difference(words):
            words[w] = self.whole(" " + w)
        return b"".join([self.whole(head), *map(words.__getitem__, rest)])


def _cut(context: int, end_id: int, rank_file: str | None, with_ids: bool):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = Coder(rank_file), TaskContext.get().partitionId()
        used = [0] * (context + 1)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                s = b.slice(at, 1000)
                docs, rows, ids = [], [], []
                for d, text in zip(s.column(0), s.column(1).to_pylist()):
                    code = coder.encode(text) + end
                    n = len(code) // 4
                    cuts = [0, *range(n % context or context, n, context), n] if n > context else [0, n]
                    for k in range(len(cuts) - 1):
                        piece, length = code[4 * cuts[k]:4 * cuts[k + 1]], cuts[k + 1] - cuts[k]
                        docs.append(d)
                        rows.append((k, cuts[k], length, zlib.crc32(piece), part, used[length]))
                        used[length] += 1
                        if with_ids:
                            ids.append(np.frombuffer(piece, dtype="<u4"))
                cols = list(zip(*rows)) or [[]] * 6
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array([x.as_py() for x in docs], s.column(0).type), *(pa.array(c, t) for c, t in zip(cols, kinds))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
    return run


def _two_or_more(counts: Sequence[int], low: int, high: int) -> bool:
    """Whether two or more items can sum to more than ``low`` and at most ``high``."""
    mask = (1 << (high + 1)) - 1
    want = mask & ~((1 << (low + 1)) - 1)
    one = more = 0
    for length in range(1, high + 1):
        for _ in range(min(counts[length], high // length)):
            more |= ((one | more) << length) & mask
            one |= 1 << length
            if more & want:
                return True
    return False


def reduce_dominated(counts: list[int], context: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello and Toth's reduction: fix bins that some best solution has.

    For each length, longest first, let k be the longest item that fits beside it. The
    bin {length, k} dominates every other bin of that item if no two or more items have
    a sum over k that still fits; a k that fills the bin exactly always dominates. An
    item that nothing fits beside is a bin by itself. ``counts`` is reduced in place."""
    fixed = []
    for length in range(context, 0, -1):
        while counts[length] > 0:
            room = context - length
            counts[length] -= 1
            k = next((x for x in range(room, 0, -1) if counts[x] > 0), 0)
            dominates = k == 0 or k == room or not _two_or_more(counts, k, room)
            counts[length] += 1
            if not dominates:
                break
            times = counts[length] if k == 0 else counts[length] // 2 if k == length else min(counts[length], counts[k])
            counts[length] -= times
            if k:
                counts[k] -= times
            fixed.append(((length, k) if k else (length,), times))
    return fixed


def best_fit(counts: list[int], context: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first: an item goes to the fullest bin that has room. Equal
    bins are handled together, so the work follows the number of lengths."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {context: []}

    def put(items: tuple[int, ...], room: int, times: int) -> None:
        if times > 0:
            open_bins.setdefault(room, []).append((items, times))

    for length in range(context, 0, -1):
        n, counts[length] = counts[length], 0
        while n > 0:
            room = min((r for r, b in open_bins.items() if r >= length and b and r < context), default=context)
            items, times = open_bins[room].pop() if room < context else ((), n)
            each = room // length
            full = min(times, n // each)
            put(items + (length,) * each, room - each * length, full)
            n, times = n - full * each, times - full
            if times > 0 and n > 0:
                put(items + (length,) * n, room - n * length, 1)
                n, times = 0, times - 1
            if room < context:
                put(items, room, times)
    return [x for bins in open_bins.values() for x in bins]


def plan(histogram: dict[int, int], context: int = CONTEXT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for a histogram of lengths."""
    counts = [histogram.get(x, 0) for x in range(context + 1)]
    return reduce_dominated(counts, context) + best_fit(counts, context)


def slots(bins: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """(length, first, sequence, offset): the pieces of a length from number ``first``
    on go to the sequences from ``sequence`` on, one in each, at ``offset``."""
    rows, used, base = [], {}, 0
    for items, times in bins:
        offset = 0
        for length in items:
            rows.append((length, used.get(length, 0), base, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).astype("int64")


def pack(docs: DataFrame, *, context: int = CONTEXT, end_id: int = END_ID, rank_file: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) with their sequence and offset: doc_id,
    piece, start, length, ids_crc32, sequence_id, offset and, if asked, ids.

    A document is its ids and ``end_id``; one longer than ``context`` is cut into pieces
    of ``context`` ids, of which the first may be shorter. A null or empty text is one
    piece of one id. Rows that repeat are packed each for itself. ``rank_file`` is the
    vocabulary's rank file on the executors (default: the installed one)."""
    pieces = docs.select("doc_id", text_of().alias("text"))
    kind = dict(pieces.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, place long" + ", ids array<int>" * with_ids
    pieces = staged(pieces.mapInArrow(_cut(context, end_id, rank_file, with_ids), schema), "pieces")
    per = staged(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row a length
    table = slots(plan(histogram, context))
    by = {int(k): (g["first"].to_numpy(), g["sequence"].to_numpy(), g["offset"].to_numpy()) for k, g in table.groupby("length")}
    shared = docs.sparkSession.sparkContext.broadcast(by)

    @F.pandas_udf("sequence_id long, offset long")
    def seat(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), dtype=np.int64)
        values, which = np.unique(length.to_numpy(), return_inverse=True)
        for k, value in enumerate(values):
            at = np.flatnonzero(which == k)
            first, sequence, offset = shared.value[int(value)]
            x = number.to_numpy()[at]
            slot = np.searchsorted(first, x, side="right") - 1
            out[at, 0] = sequence[slot] + x - first[slot]
            out[at, 1] = offset[slot]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    before = staged(per.select("length", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")), "before")
    numbered = pieces.join(before, ["length", "part"]).withColumn("at", seat("length", F.col("place") + F.col("before")))
    release(per)
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("at.sequence_id").alias("sequence_id"),
                           F.col("at.offset").alias("offset"), *(["ids"] * with_ids))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, doc_ids, ids) of pieces packed with their ids."""
    g = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))  # at most one context
    return g.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.ids").alias("ids"))
