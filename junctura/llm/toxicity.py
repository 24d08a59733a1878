"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon turns words and signs into symbols: insult, threat, target, negation, reported
speech, contrast and the signs that end or open something. Three machines read the
symbols, each a table of arcs: one keeps the reach of a negation, one reported speech
across colon and quotation marks, one whether someone is addressed. They are composed
once into one table. A matcher sums, over every way to pick an insult, or a threat and
the next target of its clause, what the picked word weighs times the weight of the arc
that the composed machine takes there. Insult and threat stems, their weights and the step from a score to
a probability are learned from labelled rows; the other classes are word lists."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from junctura.llm import bloom
from junctura.llm.common import staged, text_of

# Closed word classes in English, German, French and Spanish.
#: Threat verbs: stems, and the endings they take.
THREATS = (
    ("kill hurt beat destroy shoot stab stabb burn hang", " s ed ing en"),
    ("töt schlag schläg umbring umzubring", "e en t et te ete st"),
    ("tuer tueron frapp détrui", "a ai as ont ez er e é és re s t sent z"),
    ("mat golpe destru", "ar aré ará arán ando ado aron amos ó iré irá ido yó"),
)
TARGET = frozenset("you your yours yourself he she they him her them these those people du dich dir ihr euch sie tu te toi vous ils elles tú usted ustedes ellos ellas".split())
NEGATION = frozenset("not no never nobody nothing without hardly don't doesn't didn't isn't aren't wasn't won't can't nicht kein keine keinen nie niemals ne pas jamais aucun sans nunca jamás ningún sin".split())
REPORTED = frozenset("said says say told wrote writes quoted called claims claimed reported according allegedly sagte sagt schrieb angeblich laut dit disait écrit selon dijo dice escribió según".split())
CONTRAST = frozenset("but yet aber sondern doch mais pero sino".split())
SIGNS = {",": "comma", ":": "colon", "\n": "line", **dict.fromkeys(".!?;", "end"), **dict.fromkeys('"\u201c\u201d\u201e\u00ab\u00bb', "quote")}
#: Words after a negation that it still covers.
NEGATION_REACH = 5
# The grammar: what a negated, a reported and an aimed insult weigh against a plain one.
NEGATED, QUOTED, AIMED, THREAT_WEIGHT = 0.2, 0.5, 1.5, 1.0
THRESHOLD = 0.7
MAX_TRAINING_ROWS = 40_000
STEM_LENGTHS = range(4, 9)
MIN_SUPPORT = 4
MIN_GAIN = 9.5
MIN_PURITY = 0.97
MAX_STEMS = 2_000
HELD_OUT = 1

WORD_SYMBOLS = ("other", "insult", "threat", "target", "negation", "reported", "contrast")
SYMBOLS = (*WORD_SYMBOLS, "comma", "colon", "quote", "end", "line")
SCORED = ("insult", "threat")
#: Words that a lexicon remembers before it starts afresh.
MEMO = 200_000

_WORD = r"[^\W\d_]+(?:'t(?![^\W\d_]))?"
_READ = re.compile(_WORD + "|[" + re.escape("".join(SIGNS)) + "]")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == HELD_OUT, F.lit(False))


@dataclass(frozen=True)
class Machine:
    """Arcs from (state, symbol) to (next state, weight). A symbol without an arc leaves
    the state as it is, at weight 1."""

    start: object
    arcs: dict[tuple[object, str], tuple[object, float]]

    def step(self, state: object, symbol: str) -> tuple[object, float]:
        return self.arcs.get((state, symbol), (state, 1.0))


def compose(*machines: Machine) -> Machine:
    """One machine that takes the arcs of all at once: its states are their states side
    by side, as far as they can be reached, and its weights the products of theirs."""
    start = tuple(m.start for m in machines)
    arcs, ahead, seen = {}, [start], {start}
    while ahead:
        state = ahead.pop()
        for symbol in SYMBOLS:
            steps = [m.step(s, symbol) for m, s in zip(machines, state)]
            to = tuple(t for t, _ in steps)
            arcs[state, symbol] = to, math.prod(w for _, w in steps)
            if to not in seen:
                seen.add(to)
                ahead.append(to)
    return Machine(start, arcs)


def negation_machine(reach: int = NEGATION_REACH) -> Machine:
    """States: words that the last negation still covers. A contrast, a comma, a colon
    and the end of a clause end the reach; quotation marks do not."""
    arcs: dict = {}
    for k in range(reach + 1):
        arcs |= {(k, s): (max(0, k - 1), NEGATED if k and s in SCORED else 1.0) for s in WORD_SYMBOLS}
        arcs |= {(k, s): (0, 1.0) for s in ("contrast", "comma", "colon", "end", "line")}
        arcs[k, "negation"] = reach, 1.0
    return Machine(0, arcs)


def reported_machine() -> Machine:
    """States: plain, verb (a reporting word in this clause), speech (behind its colon),
    quoted (within its marks), marks (within marks that no reporting word announced).
    Marks stay open over clause ends, nothing over a line end."""
    arcs: dict = {("plain", "reported"): ("verb", 1.0), ("plain", "quote"): ("marks", 1.0), ("marks", "quote"): ("plain", 1.0), ("marks", "line"): ("plain", 1.0),
                  ("verb", "colon"): ("speech", 1.0), ("quoted", "quote"): ("plain", 1.0), ("quoted", "line"): ("plain", 1.0)}
    for state in ("verb", "speech"):
        arcs |= {(state, "quote"): ("quoted", 1.0), (state, "end"): ("plain", 1.0), (state, "line"): ("plain", 1.0)}
    arcs |= {(state, s): (state, QUOTED) for state in ("verb", "speech", "quoted") for s in SCORED}
    return Machine("plain", arcs)


def target_machine() -> Machine:
    """States: whether someone was addressed in this clause."""
    return Machine("open", {("open", "target"): ("aimed", 1.0), ("aimed", "insult"): ("aimed", AIMED), ("aimed", "end"): ("open", 1.0), ("aimed", "line"): ("open", 1.0)})


#: The matcher's arcs: symbol to (from, to, whether the picked word's weight counts there).
#: Every state also stays as it is but for those in ``MATCHER_LEAVES``.
IDLE, PENDING, DONE = range(3)
MATCHER = {"insult": (IDLE, DONE, True), "threat": (IDLE, PENDING, True), "target": (PENDING, DONE, False)}
MATCHER_LEAVES = {"target": PENDING, "end": PENDING, "line": PENDING}


@dataclass(frozen=True)
class Model:
    stems: dict[str, float]
    slope: float
    offset: float
    threats: dict[str, float] = field(default_factory=dict)


class Grammar:
    """Lexicon of insult stems and learned threat stems, and the composed machines as a
    table over numbered states and symbols."""

    def __init__(self, stems: dict[str, float], threats: dict[str, float] | None = None):
        self.stems, self.threats = stems, threats or {}
        self.lengths = sorted({len(s) for s in (*self.stems, *self.threats)})
        forms = {v + e for verbs, ends in THREATS for v in verbs.split() for e in ends.split(" ")}
        words = (("target", TARGET), ("negation", NEGATION), ("reported", REPORTED), ("contrast", CONTRAST))
        self.closed = {f: ("threat", THREAT_WEIGHT) for f in forms} | {w: (name, 1.0) for name, ws in words for w in ws}
        self.closed |= {sign: (name, 1.0) for sign, name in SIGNS.items()}
        scored = (*self.stems, *self.threats, *forms)
        self.head = min(map(len, scored))
        self.heads = frozenset(w[:self.head] for w in scored)
        machine = compose(negation_machine(), reported_machine(), target_machine())
        number = {state: i for i, state in enumerate(dict.fromkeys(s for s, _ in machine.arcs))}
        self.start = number[machine.start]
        self.table = [{name: (number[machine.arcs[s, name][0]], machine.arcs[s, name][1]) for name in SYMBOLS} for s in number]
        self.memo: dict[str, tuple[str, float]] = {}

    def look_up(self, token: str) -> tuple[str, float]:
        """Symbol and weight of a word or sign; a learned stem comes before the word lists."""
        got = self.memo.get(token)
        if got is None:
            got = self.closed.get(token, ("other", 0.0))
            for n in self.lengths:
                stem = token[:n]
                if stem in self.stems:
                    got = "insult", self.stems[stem]
                    break
                if stem in self.threats:
                    got = "threat", self.threats[stem]
                    break
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[token] = got
        return got

    def read(self, symbols: Iterable[tuple[str, float]]) -> float:
        """Sum over all the matcher's paths through (symbol, weight of the word)."""
        state, at = self.start, [1.0, 0.0, 0.0]
        for name, weight in symbols:
            state, arc = self.table[state][name]
            move = MATCHER.get(name)
            if move:
                a, b, picked = move
                at[b] += at[a] * (weight * arc if picked else 1.0)
            if name in MATCHER_LEAVES:
                at[MATCHER_LEAVES[name]] = 0.0
        return at[DONE]

    def text(self, text: str) -> float:
        """Score of a whole text."""
        tokens = tokens_of(text)
        if self.heads.isdisjoint([t[:self.head] for t in tokens]):
            return 0.0
        return self.read(map(self.look_up, tokens))


def tokens_of(text: str) -> list[str]:
    """Words in lower case and signs, in order; both apostrophes are one."""
    return _READ.findall(text.lower().replace("\u2019", "'"))


def _stems_of(words: Iterable[str]) -> set[str]:
    return {w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n}


def _prefixes(text: str) -> set[str]:
    """Stems of all words."""
    return _stems_of(set(tokens_of(text)))


def _aimed_prefixes(text: str) -> set[str]:
    """Stems of words that a target follows in their clause."""
    aimed, words = set(), []
    for t in tokens_of(text):
        if SIGNS.get(t) in ("end", "line"):
            words = []
        elif t in TARGET:
            aimed.update(words)
            words = []
        else:
            words.append(t)
    return _stems_of(aimed)


def _count_stems(only: frozenset[str] | None, aimed: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        stems = _aimed_prefixes if aimed else _prefixes
        for b in batches:
            for text in b.column(0).to_pylist():
                p = stems(text)
                n.update(p if only is None else only.intersection(p))
        yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64())], ["stem", "docs"])
    return run


def _gain(p: int, n: int, toxic: int, clean: int) -> float:
    """Log-likelihood ratio of a stem's split against the overall rate."""
    rate, t = toxic / (toxic + clean), p + n
    return sum(k * math.log(k / (t * r)) for k, r in ((p, rate), (n, 1 - rate)) if k)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out third, at most about
    ``max_rows``, picked by a hash of the id."""
    l = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    l = staged(l.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic")), "labels")
    n = l.count()
    if n > max_rows:
        l = l.where(F.pmod(F.xxhash64("doc_id", F.lit("training")), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    picked = bloom.with_ids(docs.select("doc_id", text_of().alias("text")), l, min(n, max_rows))
    return staged(picked.select("text", F.col("__toxic").alias("toxic")), "training")


def learn_stems(rows: DataFrame, *, aimed: bool = False, known: Iterable[str] = ()) -> dict[str, float]:
    """Stems that go with label 1, with their log odds; ``aimed`` counts only words that a
    target follows in their clause, and stems that begin like a ``known`` one are left
    out. Counts are made on the executors: of all stems in toxic rows, then of those that
    are frequent enough in clean rows."""
    known = tuple(known)
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return {}

    def counted(label: int, only: frozenset[str] | None) -> DataFrame:
        parts = rows.where(F.col("toxic") == label).select("text").mapInArrow(_count_stems(only, aimed), "stem string, docs long")
        return parts.groupBy("stem").agg(F.sum("docs").alias("n"))

    p = {r["stem"]: r["n"] for r in counted(1, None).where(F.col("n") >= MIN_SUPPORT).collect()}  # bounded by the sample
    n = {r["stem"]: r["n"] for r in counted(0, frozenset(p)).collect()}
    ranked = sorted(((_gain(k, n.get(s, 0), toxic, clean), s) for s, k in p.items()
                     if k / toxic / (k / toxic + n.get(s, 0) / clean) >= MIN_PURITY), key=lambda x: (-x[0], len(x[1]), x[1]))
    chosen: dict[str, float] = {}
    for gain, s in ranked:
        if gain < MIN_GAIN or len(chosen) >= MAX_STEMS:
            break
        if not any(s.startswith(c) or c.startswith(s) for c in (*chosen, *known)):
            chosen[s] = math.log((p[s] + 0.5) / toxic) - math.log((n.get(s, 0) + 0.5) / clean)
    return chosen


def _weigh(stems: dict[str, float], threats: dict[str, float]):
    @F.pandas_udf("double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        g = Grammar(stems, threats)
        for texts in batches:
            yield pd.Series([g.text(t) if t else 0.0 for t in texts], dtype="float64")
    return weigh


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset by Newton's method; the ridge keeps separable rows finite."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2), a.T @ (y - p) - ridge * beta)
        beta = beta + np.clip(step, -2, 2)
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic). Without rows of
    both labels the model has no stems and scores everything near 0."""
    rows = training_rows(docs, labels, max_rows)
    stems = learn_stems(rows)
    threats = learn_stems(rows, aimed=True, known=stems)
    if not stems and not threats:
        return Model({}, 1.0, -6.0)
    got = rows.select("toxic", F.log1p(_weigh(stems, threats)("text")).alias("x")).toPandas()  # two numbers a row of the bounded sample
    return Model(stems, *_logistic(got["x"].to_numpy(float), got["toxic"].to_numpy(float)), threats)


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` (text and any other columns) with the probability that label 1 holds.
    Only the text counts; a null or empty text scores as one without any match, a text of
    any length is read whole in one pass, an empty table gives no row, and a column of
    that name is replaced."""
    x = F.log1p(_weigh(model.stems, model.threats)(text_of()))
    return docs.withColumn(column, 1 / (1 + F.exp(-(F.lit(model.slope) * x + F.lit(model.offset)))))


def judge(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``; rows that repeat
    score alike, a null id is not held out. Texts are read whole whatever their length; an
    empty table gives no row, and without labelled rows every score is near 0."""
    model = fit(docs, labels, max_rows=max_rows)
    s = scored(docs.select("doc_id", "text"), model)
    return s.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
