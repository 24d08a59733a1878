"""Filter audit, hard negatives and language identification against brute force, and their edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.llm import filter_audit, hard_negatives as H, language_id as L
from test_operators import docs_of, edge_cases, prose

LABELS = "doc_id long, quality int, toxic int"


# ---- 11: filter audit

def plain_audit(rows, labels):
    """Every prefix of every order by itself, with Python sets."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = []
    for i, text, _ in rows:
        t = text or ""
        words = [w.decode() for w in t.encode().split()]
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
             "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        fails.append({c for c, bad in f.items() if bad})
    out = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        shapley = Counter()
        for p in permutations("ABCDE"):
            left = set(mine)
            for step, c in enumerate(p, 1):
                bad = {k for k in mine if c in fails[k]}
                gone = left & bad
                left -= gone
                shapley[c] += len(gone)
                out[part, "".join(p), step] = [len(left), len(gone), len(bad - gone), sum(fails[k] == {c} for k in mine),
                                               sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
        for (q, order, step), v in out.items():
            if q == part:
                v.append(shapley[order[step - 1]])
    return out


AUDITED = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(spark, docs, labels):
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))
    return {(r.part, r.filter_order, r.step): [r[c] for c in AUDITED] for r in got.collect()}


def test_audit_equals_every_order_by_itself(spark):
    texts = [prose(1), prose(2), "one two", "", None, prose(3) + " #", ("AB " * 60), " ".join(["same"] * 70), prose(4).upper(), prose(1), prose(1), "a|b\x0bc\x0cd e f"]
    rows = [(i, texts[i % len(texts)], ["s", None, "t"][i % 3]) for i in range(40)] + [(None, prose(1), "s"), (5, texts[5], "s"), (5, "other", "s")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 40, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1)]
    assert audited(spark, docs_of(spark, rows), labels) == plain_audit(rows, labels)


def test_audit_edge_cases(spark):
    df, n = edge_cases(spark)
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    assert audited(spark, df, []) == plain_audit(rows, [])
    assert filter_audit.audit(df.limit(0), spark.createDataFrame([], LABELS)).count() == 0
    clean = docs_of(spark, [(i, prose(i), "s") for i in range(1, 5)])
    got = audited(spark, clean, [(1, 1, 0)])
    assert len(got) == 600 and all(v == [4, 0, 0, 0, 0, 0, 0] for v in got.values())


def test_audit_of_a_hot_text(spark):
    """A third of all rows share one text; all but the first fail E."""
    rows = [(i, prose(9) if i % 3 == 0 else f"{prose(3)} w{i}", "s") for i in range(900)]
    got = audited(spark, docs_of(spark, rows), [])
    assert got["s", "EABCD", 1][:2] == [601, 299]


# ---- 12: hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, extra string"


def plain_mine(rows):
    v = {}
    for i, x, label, *_ in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x])
    out = set()
    for a, (la, xa) in v.items():
        if a % 100:
            continue
        s = {b: (lb, sum(p * q for p, q in zip(xa, xb))) for b, (lb, xb) in v.items()}
        for p in sorted((b for b in s if b != a and s[b][0] == la), key=lambda b: (-s[b][1], b))[:5]:
            near = [b for b in s if s[b][0] != la and 80 * s[p][1] <= 100 * s[b][1] <= 100 * s[p][1]]
            for k, b in enumerate(sorted(near, key=lambda b: (-s[b][1], b))[:5], 1):
                out.add((a, p, k, b, s[p][1], s[b][1]))
    return out


def mined(spark, rows, **how):
    got = H.mine(spark.createDataFrame(rows, VECTORS), **how).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got}


def clusters(n, d, seed):
    """A tight cluster that holds a third of all rows, spread rows, ties and copies under other ids."""
    r = np.random.default_rng(seed)
    base = r.normal(size=d)
    out = []
    for i in range(n):
        x = base + 0.02 * r.normal(size=d) if i % 3 == 0 else r.normal(size=d)
        if i % 10 == 4:
            x = np.round(base)  # many equal scores
        x = x / np.linalg.norm(x)
        out.append((i, [float(c) for c in x], int(r.integers(0, 4)) if i % 3 else 1, None))
    return out


@pytest.mark.parametrize("block,chunk", [(16, 4), (1024, 256)])
def test_mining_equals_brute_force(spark, block, chunk):
    rows = clusters(700, 6, 3)
    want = plain_mine(rows)
    assert want and mined(spark, rows, block=block, chunk=chunk) == want


def test_mining_edge_cases(spark):
    rows = clusters(300, 4, 5)
    rows += [(100, None, 1, "x"), (500, [1.0, None, 0.0, 0.0], 1, None), (501, [float("nan"), 0.0, 0.0, 0.0], 2, None), (502, [float("inf"), 0.0, 0.0, 0.0], 2, None),
             (None, [1.0, 0.0, 0.0, 0.0], 1, None), (503, [1.0, 0.0, 0.0, 0.0], None, None), (600, [0.5, 0.25], 1, None), (601, [], 1, None), (700, [1.0, 0.0, 0.0, 0.0], 77, None)]
    rows = [r for r in rows if r[0] != 100 or r[1] is None]
    want = plain_mine(rows)
    again = rows + rows[:50]  # equal rows count once
    assert mined(spark, again, block=8, chunk=2) == want
    assert H.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert H.mine(spark.createDataFrame([(0, [1.0], 1, None)], VECTORS)).count() == 0
    clash = spark.createDataFrame([(i, x, la) for i, x, la, _ in rows if i is not None], "vec_id long, embedding array<float>, label int")
    for c in ("q", "h", "chunk", "block", "rank", "score", "i", "k"):
        clash = clash.withColumn(c, F.lit("other"))
    assert {tuple(r) for r in H.mine(clash).collect()} == want
    huge = [(i, [1e30 * (i % 5 + 1), -1e30], i % 2, None) for i in range(0, 1000, 25)]
    assert H.mine(spark.createDataFrame(huge, VECTORS)).count() > 0  # scores beyond a long


def test_zone_maps_spare_blocks_and_bounds_hold():
    r = np.random.default_rng(1)
    rows, anchors = np.floor(256 * r.normal(size=(400, 5))), np.floor(256 * r.normal(size=(20, 5)))
    lo, hi = rows.reshape(10, 40, 5).min(1), rows.reshape(10, 40, 5).max(1)
    least, most = H.bounds(anchors, lo, hi)
    s = H.scores(anchors, rows).reshape(20, 10, 40)
    assert (least <= s.min(2)).all() and (most >= s.max(2)).all()
    assert (H.scores(anchors * 2.0**60, rows) == np.clip([[sum(int(a) * int(b) for a, b in zip(x, y)) for y in rows] for x in anchors * 2.0**60], H._LOW, H._HIGH)).all()


def test_only_blocks_that_can_matter_are_read(spark):
    """Two far clusters of two labels each: an anchor's windows never reach the other cluster."""
    r = np.random.default_rng(2)
    rows = [(i, [float(c) for c in (np.array([1, 0, 0, 0]) if i % 2 else np.array([0, 1, 0, 0])) + 0.01 * r.normal(size=4)], i % 4, None) for i in range(2000)]
    v = H.clean(spark.createDataFrame(rows, VECTORS))
    placed = v.mapInArrow(H._place(H.curve_axes(v)), "vec_id long, label long, q array<double>, h long")
    blocks = H.blocks_of(placed, 32, "blocks")
    zones = blocks.select("lo", "hi").toArrow()
    lo, hi = (np.array(zones.column(c).to_pylist()) for c in ("lo", "hi"))
    a = np.array([[0.0, 256.0, 0.0, 0.0]])
    _, most = H.bounds(a, lo, hi)
    assert 0.3 < (most[0] < 0.8 * 256 * 240).mean() < 0.7
    assert mined(spark, rows, block=32) == plain_mine(rows)


@pytest.mark.parametrize("d,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_every_cell_by_steps_of_one(d, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
    h = H.hilbert(cells, bits)
    assert sorted(h) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(h)], axis=0)).sum(1) == 1).all()


# ---- 13: languages

WORDS = {"aa": "the old mill by river was sold in spring to family from north".split(), "bb": "der alte Mühle am Fluss wurde im Frühling an eine Familie verkauft".split(),
         "cc": "старая мельница у реки была продана весной семье с севера".split()}


def sentences(lang, seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def plain_counts(rows):
    """(lang, context, byte) counts of all orders, text by text."""
    seen = defaultdict(Counter)
    for lang, text in rows:
        b = text.encode("utf-8", "surrogatepass").lower()
        for i in range(len(b)):
            for k in range(min(i, L.ORDER) + 1):
                seen[lang, b[i - k:i]][b[i]] += 1
    return seen


def plain_bits(seen, lang, text, least):
    b = text.encode("utf-8", "surrogatepass").lower()
    total = 0.0
    for i in range(len(b)):
        for k in range(min(i, L.ORDER), -1, -1):
            c = seen.get((lang, b[i - k:i]))
            if c is None or (k >= 2 and sum(c.values()) < least):
                continue
            n, d = sum(c.values()), len(c)
            if b[i] in c:
                total += math.log2((n + d) / c[b[i]])
                break
            total += math.log2((n + d) / d)
        else:
            total += 8.0
    return total


def corpus(spark, n=240):
    rows = [(i, sentences(l, i, 30 + i % 40), l) for i, l in ((i, sorted(WORDS)[i % 3]) for i in range(n))]
    return rows, spark.createDataFrame([(i, t, l, "s", len(t)) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_code_lengths_equal_plain_counting(spark):
    rows, df = corpus(spark)
    trees = L.fit(df)
    assert trees.languages == sorted(WORDS)
    seen = plain_counts([(l, t) for i, t, l in rows if zlib.crc32(str(i).encode()) % 5])
    texts = [rows[0][1], rows[4][1][:50], rows[5][1], "Zzz 123 # new words", "x", "日本語", sentences("bb", 999, 200)]
    got = trees.reader.bits(texts)
    for t, row in zip(texts, got):
        assert row == pytest.approx([plain_bits(seen, l, t, L.MIN_SEEN) for l in trees.languages], rel=1e-9)


def test_long_texts_go_in_pieces(spark, monkeypatch):
    _, df = corpus(spark)
    trees = L.fit(df)
    text = sentences("cc", 5, 900)
    whole = L.Reader(trees).bits([text, "the mill"])
    monkeypatch.setattr(L, "PIECE", 37)
    assert np.allclose(L.Reader(trees).bits([text, "the mill"]), whole)


def test_trees_shrink_to_their_bound(spark):
    _, df = corpus(spark)
    small, large = L.fit(df, max_entries=300), L.fit(df)
    assert len(small.grams) < len(large.grams)
    kept = (small.grams >= 1 << 24).sum()
    assert 0 < kept <= 300 * 3
    got = {r.doc_id: (r.lang, r.lang_pred) for r in L.predict(df, small).join(df.select("doc_id", "lang"), "doc_id").collect()}
    assert sum(a == b for a, b in got.values()) >= 0.99 * len(got)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"), "score")
    n, right, score = got.agg(F.count("*"), F.sum("ok"), F.avg("score")).first()
    assert n > 150 and right >= 0.99 * n and score > 0.99
    one = L.identify(docs.withColumn("text", F.left("text", F.lit(40)))).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert one.where("lang = lang_pred").count() >= 0.9 * one.count()  # one short line


def test_language_edge_cases(spark):
    df, n = edge_cases(spark)
    rows, train = corpus(spark, 60)
    got = L.predict(df, L.fit(train)).collect()
    assert len(got) == n and all(0 <= r.score <= 1 for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.lang_pred, r.score))
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert by[1] == by[2] == by[3] == {("und", 0.0)} and len(by[5]) == 1 and {x for x, _ in by[4] | by[7]} <= set(WORDS)
    marks = docs_of(spark, [(1, "12 34 ½ – !", "s"), (2, "Ω", "s")])
    assert [r.lang_pred == "und" for r in L.predict(marks, L.fit(train)).orderBy("doc_id").collect()] == [True, False]
    assert L.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}  # nothing to learn from
    # a language that only held-out rows have is never predicted
    other = train.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "zz").otherwise(F.col("lang")))
    assert "zz" not in L.fit(other).languages
