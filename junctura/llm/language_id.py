"""Language by prediction by partial matching: the language whose byte contexts code a text shortest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from junctura.llm.common import release, staged, text_of

#: Bytes of context at most.
ORDER = 4
#: Bounds of the fitted model. Rows that it is counted on, for each language: about so many,
#: picked by a hash of the id. Languages: those with most rows. Entries (context, next byte)
#: of all trees: contexts of two bytes and more are left out, rarest first, until they fit.
ROWS_PER_LANGUAGE, MAX_LANGUAGES, MAX_ENTRIES = 1_500, 64, 300_000
#: A context of two bytes and more is kept from so many occurrences on.
MIN_SEEN = 4
#: Bytes that are scored at once; longer texts go in pieces, each with the bytes before it as context.
PIECE = 1 << 18
UNKNOWN = "und"
_BATCH_ROWS = 256


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _bytes(text: str) -> np.ndarray:
    """UTF-8 with A-Z lower-cased."""
    return np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)


def _grams(flat: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For each length j = 1 .. ``longest`` the keys of the grams that end at each position
    from j - 1 on. A key is the bytes behind a leading one, so lengths do not mix."""
    b = flat.astype(np.int64)
    packed = b
    for j in range(1, longest + 1):
        if j > 1:
            packed = (packed[:-1] << 8) | b[j - 1:]
        yield packed | (1 << (8 * j))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), summed over about a piece; no gram spans two texts."""
    sums: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, keys in sums.items():
            gram, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])
        sums.clear()

    for batch in batches:
        for lang, text in zip(*batch.columns, strict=True):
            b = _bytes(text.as_py())
            for at in range(0, len(b), PIECE):
                back = min(at, ORDER)  # grams that begin in the piece before
                piece = b[at - back:at + PIECE]
                for j, keys in enumerate(_grams(piece, ORDER + 1), 1):
                    sums.setdefault(lang.as_py(), []).append(keys[max(0, back - j + 1):])
                size += len(piece)
                if size >= PIECE:
                    yield from flush()
                    size = 0
    yield from flush()


@dataclass(frozen=True)
class Trees:
    """Frozen statistics as code lengths in bits: a row for each gram that any language
    has, a column for each language, and what it costs to escape from a context."""

    languages: list[str]
    grams: np.ndarray  # sorted keys
    bits: np.ndarray  # by language, then gram
    contexts: np.ndarray  # sorted keys
    escapes: np.ndarray  # by language, then context

    @cached_property
    def reader(self) -> "Reader":
        return Reader(self)

    def __getstate__(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}


class Reader:
    """Looks up the trees; made once a worker."""

    def __init__(self, t: Trees):
        self.trees, self.grams, self.contexts = t, pd.Index(t.grams), pd.Index(t.contexts)
        self.root = t.escapes[:, self.contexts.get_indexer([1])[0]] + 8.0 if len(t.contexts) else np.zeros(0)

    def pieces(self, flat: np.ndarray, seen: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Bits of each of ``n`` texts by language. ``seen``: bytes of context that a
        position has (negative: it is context only); ``owner``: its text."""
        out = np.zeros((n, len(self.trees.languages)))

        def add(where: np.ndarray, by_language: np.ndarray, row: np.ndarray) -> None:
            for k, bits in enumerate(by_language):
                out[:, k] += np.bincount(owner[where], bits[row], n)

        keys = list(_grams(flat, ORDER + 1))
        open_at = np.flatnonzero(seen >= 0)
        for j in range(ORDER + 1, 0, -1):
            deep = seen[open_at] >= j - 1
            here, later = open_at[deep], open_at[~deep]
            row = self.grams.get_indexer(keys[j - 1][here - (j - 1)])
            hit = row >= 0
            add(here[hit], self.trees.bits, row[hit])
            missed = here[~hit]
            if j == 1:
                return out + np.bincount(owner[missed], minlength=n)[:, None] * self.root
            at = self.contexts.get_indexer(keys[j - 1][missed - (j - 1)] >> 8)  # the same key without its last byte
            known = at >= 0
            add(missed[known], self.trees.escapes, at[known])
            open_at = np.concatenate([missed, later])
        return out

    def bits(self, texts: list[str]) -> np.ndarray:
        """The code length of each text by language."""
        total, size = np.zeros((len(texts), len(self.trees.languages))), 0
        held: list[tuple[int, np.ndarray, int]] = []

        def flush() -> None:
            if held:
                flat = np.concatenate([b for _, b, _ in held])
                seen = np.concatenate([np.arange(len(b)) if not back else np.where(np.arange(len(b)) < back, -1, np.arange(len(b))) for _, b, back in held])
                owner = np.repeat([i for i, _, _ in held], [len(b) for _, b, _ in held])
                np.add(total, self.pieces(flat, seen, owner, len(texts)), out=total)
                held.clear()

        for i, text in enumerate(texts):
            b = _bytes(text)
            for at in range(0, len(b), PIECE):
                back = min(at, ORDER)
                held.append((i, b[at - back:at + PIECE], back))
                size += len(held[-1][1])
                if size >= PIECE:
                    flush()
                    size = 0
        flush()
        return total


def trees_of(counts: dict[str, dict[int, int]] | list[tuple[str, int, int]], languages: list[str]) -> Trees:
    """Code lengths from counted grams (lang, gram, n): of the n times that a language
    has seen a context with d different next bytes, a byte seen c times costs
    -log2(c / (n + d)) and the escape to the context one byte shorter -log2(d / (n + d));
    below the empty context all 256 bytes cost alike."""
    rows = counts if isinstance(counts, list) else [(l, g, n) for l, x in counts.items() for g, n in x.items()]
    number = {l: k for k, l in enumerate(languages)}
    lang = np.array([number[r[0]] for r in rows], np.int64)
    gram = np.array([r[1] for r in rows], np.int64)
    n = np.array([r[2] for r in rows], np.float64)
    grams, g = np.unique(gram, return_inverse=True)
    contexts, c = np.unique(gram >> 8, return_inverse=True)
    wide = len(languages)
    total, kinds = np.zeros((len(contexts), wide)), np.zeros((len(contexts), wide))
    np.add.at(total, (c, lang), n)
    np.add.at(kinds, (c, lang), 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        escapes = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
    bits = np.full((len(grams), wide), np.nan)
    bits[g, lang] = np.log2((total + kinds)[c, lang] / n)
    length = (np.floor(np.log2(np.maximum(grams, 1))).astype(np.int64)) // 8
    for j in range(1, ORDER + 2):  # what a language has not seen costs its escape and the shorter gram
        rows_j = np.flatnonzero(length == j)
        if not len(rows_j):
            continue
        e = escapes[np.searchsorted(contexts, grams[rows_j] >> 8)]
        if j == 1:
            rest = np.full_like(e, 8.0)
        else:
            low = 8 * (j - 1)
            rest = bits[np.searchsorted(grams, (grams[rows_j] & ((1 << low) - 1)) | (1 << low))]
        bits[rows_j] = np.where(np.isnan(bits[rows_j]), e + rest, bits[rows_j])
    return Trees(languages, grams, np.ascontiguousarray(bits.T), contexts, np.ascontiguousarray(escapes.T))


def gram_counts(docs: DataFrame, rows_per_language: int) -> tuple[DataFrame | None, list[str]]:
    """Counts (lang, gram, n) of the training rows, staged, and the languages by code point."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return None, []
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(int(1_000_000 * min(1.0, rows_per_language / r["n"]))))])
    picked = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0))
    sample = staged(known.where(picked).select("lang", "text"), "language_rows")
    counts = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = staged(counts, "gram_counts")
    release(sample)
    return counts, sorted(r["lang"] for r in counts.select("lang").distinct().collect())


def fit(docs: DataFrame, *, rows_per_language: int = ROWS_PER_LANGUAGE, max_entries: int = MAX_ENTRIES, min_seen: int = MIN_SEEN) -> Trees:
    """Count on the executors, then bring at most about ``max_entries`` counts (and those
    of contexts up to one byte, 65,792 a language at most) to the driver. Trees shrink by whole
    contexts, the rarest first, by powers of two of their occurrences."""
    counts, languages = gram_counts(docs, rows_per_language)
    if counts is None:
        return trees_of([], [])
    context = F.shiftright("gram", 8)
    sums = staged(counts.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("seen"), F.count("*").alias("kinds")), "contexts")
    deep = sums.where(f"context >= {1 << 16} and seen >= {min_seen}")
    level = F.floor(F.log2("seen")).cast("int")
    entries = {r["level"]: r["kinds"] for r in deep.groupBy(level.alias("level")).agg(F.sum("kinds").alias("kinds")).collect()}  # at most 64 rows
    least, kept = min_seen, sum(entries.values())
    for k in sorted(entries):
        if kept <= max_entries:
            break
        least, kept = 2 << k, kept - entries[k]
    stays = sums.where(f"context < {1 << 16} or seen >= {least}").select(F.col("lang").alias("l"), "context")
    got = counts.join(stays, (F.col("lang") == F.col("l")) & (context == F.col("context")), "left_semi").toArrow()
    release(counts, sums)
    return trees_of(list(zip(*[got.column(c).to_pylist() for c in ("lang", "gram", "n")], strict=True)), languages)


def _predict(shared, passing: int):
    """Batches of ``passing`` columns, has_letter and text: the text's columns become
    lang_pred and score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        read = trees.reader
        names = np.array([*trees.languages, UNKNOWN], object)
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH_ROWS):
                batch = whole.slice(at, _BATCH_ROWS)
                ok = np.array(batch.column(passing).to_pylist(), bool) & bool(trees.languages)
                texts = batch.column(passing + 1).to_pylist()
                best, score = np.full(len(texts), len(trees.languages)), np.zeros(len(texts))
                if ok.any():
                    bits = read.bits([texts[i] for i in np.flatnonzero(ok)])
                    pick = bits.argmin(1)
                    best[ok] = pick
                    score[ok] = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000.0)).sum(1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:passing], pa.array(names[best], pa.string()), pa.array(score)],
                                                 [*batch.schema.names[:passing], "lang_pred", "score"])
    return run


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of ``docs`` (doc_id, text). Only
    the text counts. The language is the one with the shortest code, the first by code
    point of those that tie; the score is its share when each language weighs
    2 ^ -bits. A text that is null or has no letter, and any text when no language was
    learned, is ``und`` with a score of 0. Rows that repeat get the same answer; a null id is
    not held out. Long texts are read whole, in pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by MAX_ENTRIES
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), letters.alias("has_letter"), text_of().alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_predict(shared, 2), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **bounds: int) -> DataFrame:
    """``predict`` with trees learned from ``docs`` (doc_id, text, lang): only from text and
    lang of rows whose lang is not null and that are not held out (null ids and texts
    teach nothing). Other columns are not looked at. An empty table gives no row."""
    return predict(docs, fit(docs, **bounds))
