"""Personal data by weak supervision (column expressions, joins and windows only).

Candidate spans come from strict and from loose patterns. Labelers vote on each:
the pattern's own check, a gazetteer, the words before it, and its edges.
Expectation-maximisation weighs the labelers without labelled data, and its posteriors
train a span classifier that decides on the loose candidates. What the strict rules find
always stays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from junctura.llm.common import staged, text_of

# Kinds in the order of the output.
KINDS = ("email", "ip", "card", "phone")
#: Kinds that no strict rule finds: keys and tokens, bank accounts, identity numbers.
ADDED_KINDS = ("secret", "account", "identity")
ALL_KINDS = KINDS + ADDED_KINDS
# The strict rules' patterns. Each starts where a run starts (or where the last match
# ended), so that a run without a match is read once; nothing else differs from the plain
# form. The card pattern takes only whole chains of 16 to 19 digits.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[a-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[a-z0-9-]{1,63}|\.[a-z0-9-]{1,63}){1,4}",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])",
    "phone": r"(?<![0-9+)(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "card": r"(?<![0-9.-])[0-9]{4}(?:[\x20./_-]{1,2}[0-9]{4}){3}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_/+.-])(?=[A-Za-z_-]{0,127}[0-9])[A-Za-z0-9_-]{20,128}+(?![A-Za-z0-9_/+-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# Gazetteers and context words.
ENDINGS = "com org net edu gov info io de fr es uk eu ch at it nl".split()
DIAL_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91".split()
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|35|6011|62|65)"
CUES = {
    "email": r"(?i)(e-?mail|contact|write|reach|correo|courriel)[^a-z]*\S*\s*$",
    "ip": r"(?i)\b(ip|host|server|address|login from)\b[^a-z]*\s*$",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|karte|tarjeta|carte)\b[^a-z]*\s*$",
    "phone": r"(?i)\b(tel|phone|call|fax|mobile|cell|telefon|teléfono)\b[^a-z]*\s*$",
    "secret": r"(?i)(key|token|secret|password|passwd|pwd|bearer|credentials?)[^a-z0-9]*$",
    "account": r"(?i)\b(iban|account|konto|compte|cuenta)\b[^a-z0-9]*$",
    "identity": r"(?i)\b(ssn|social security|identity|passport|tax id)\b[^0-9]*$",
}
KEY_FORMS = r"^(AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|pk_live_|xox[abp]-|eyJ)"
IBAN_COUNTRIES = "AT BE CH CZ DE DK EE ES FI FR GB GR HU IE IT LT LU LV NL NO PL PT RO SE SI SK".split()
COUNTER_CUES = r"(?i)(version|\bv|\bisbn|\border|invoice|\bno\.?|#|section|§|[$€£])\s*$"
CONTEXT_CHARS = 40
#: Labelers with the accuracy that estimation starts from: checksums and ranges seldom
#: err, gazetteers and edges are hints.
LABELERS = {"check": 0.95, "gazetteer": 0.7, "context": 0.9, "edges": 0.6}
#: Votes that the starting accuracy counts for.
STRENGTH = 5.0
_SPAN = "array<struct<kind: int, loose: boolean, text: string, gap: int, before: string, after: string>>"


def _found(kind: str, pattern: str, loose: bool, cheap: Column) -> Column:
    """Matches of a pattern in ``text`` with what lies between them. Matches and the
    pieces that they split the text into follow each other, which gives their places."""
    pieces, hits = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    zipped = F.zip_with(hits, F.slice(pieces, 1, F.size(hits)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    both = F.zip_with(zipped, F.slice(pieces, 2, F.size(hits)), lambda z, nxt: F.struct(
        F.lit(ALL_KINDS.index(kind)).alias("kind"), F.lit(loose).alias("loose"), z["m"].alias("text"), F.length(z["g"]).alias("gap"),
        F.right(z["g"], F.lit(CONTEXT_CHARS)).alias("before"), F.substring(nxt, 1, 1).alias("after")))
    return F.when(cheap, both).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def _luhn(digits: Column) -> Column:
    n = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: (
        F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0))))
    return F.aggregate(n, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(account: Column) -> Column:
    """Check of account numbers: the first four signs go last, letters count from 10."""
    t = F.upper(F.regexp_replace(account, r"\x20", ""))
    signs = F.filter(F.split(F.concat(F.substring(t, 5, 40), F.left(t, F.lit(4))), ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(signs, F.lit(0), lambda a, c: F.pmod(F.when(c.rlike("[0-9]"), a * 10 + value(c)).otherwise(a * 100 + value(c)), F.lit(97))) == 1


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): every row of ``docs`` with a number, and its candidate spans with
    place, votes (1, 0 or -1) and whether the strict rules hold."""
    digit = F.col("text").rlike("[0-9]")
    marks = F.col("text")
    cheap = {("email", False): marks.contains("@"), ("ip", False): digit, ("card", False): digit, ("phone", False): marks.contains("+"),
             ("email", True): marks.contains("[at]") | marks.contains("(at)") | marks.contains("[AT]") | marks.contains("(AT)"),
             ("ip", True): marks.contains(":") & marks.rlike("[0-9a-fA-F]:[0-9a-fA-F]{1,4}:"), ("phone", True): digit,
             ("card", True): digit, ("secret", True): digit & marks.rlike("[A-Za-z0-9_-]{20}"),
             ("account", True): digit & marks.rlike("[A-Z]{2}[0-9]{2}"), ("identity", True): marks.rlike("-[0-9]{2}-")}
    lists = [_found(k, p, False, cheap[k, False]).alias(f"s_{k}") for k, p in STRICT.items()] + [
        _found(k, p, True, cheap[k, True]).alias(f"l_{k}") for k, p in LOOSE.items()]
    names = [f"s_{k}" for k in STRICT] + [f"l_{k}" for k in LOOSE]
    rows = docs.select("doc_id", text_of().alias("text")).select("doc_id", *lists).withColumn("row", F.monotonically_increasing_id())
    rows = staged(rows, "matches")
    each = [rows.where(F.size(n) > 0).select("row", F.posexplode(n).alias("i", "s")) for n in names]
    hits = each[0]
    for more in each[1:]:
        hits = hits.union(more)
    w = Window.partitionBy("row", "s.kind", "s.loose").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # the matches of one text
    end = F.sum(F.col("s.gap") + F.length("s.text")).over(w)
    t = F.col("text")
    spans = hits.select("row", "s.*", end.alias("end")).withColumn("start", F.col("end") - F.length("text")).withColumn("digits", F.regexp_replace("text", "[^0-9]", ""))
    kind, n = F.col("kind"), F.length("digits")
    ok_ip = t.rlike(r"^(0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.|$)){4}$")
    check = F.when(kind == 0, True).when(kind == 1, ok_ip).when(kind == 2, _luhn(F.col("digits"))).when(kind == 3, n.between(8, 15))
    mixed = t.rlike("[a-z]") & t.rlike("[A-Z]")
    loose_check = (F.when(kind == 2, F.when(check, 1).otherwise(-1))
                   .when(kind == 4, F.when(mixed, 1).when(t.rlike("^[0-9a-fA-F]+$"), 0).otherwise(-1))
                   .when(kind == 5, F.when(_mod97(t), 1).otherwise(-1))
                   .when(kind == 6, F.when(t.rlike("^(000|666|9)|-00-|-0000$"), -1).otherwise(1)).otherwise(0))
    ending = F.lower(F.regexp_extract("text", r"([A-Za-z0-9-]+)$", 1))
    gazetteer = (F.when(kind == 0, F.when(ending.isin(ENDINGS), 1).otherwise(-1))
                 .when(kind == 1, F.when(t.rlike(r"^(0|10|127|169\.254|192\.168)\."), -1).when(F.col("loose"), 0).otherwise(1))
                 .when(kind == 2, F.when(F.col("digits").rlike(ISSUERS), 1).otherwise(-1))
                 .when(kind == 4, F.when(t.rlike(KEY_FORMS), 1).otherwise(0))
                 .when(kind == 5, F.when(F.left(t, F.lit(2)).isin(IBAN_COUNTRIES), 1).otherwise(-1))
                 .when(kind == 6, 0)
                 .otherwise(F.when(F.col("loose"), 0).when(F.substring("digits", 1, 1).isin(DIAL_CODES) | F.substring("digits", 1, 2).isin(DIAL_CODES), 1).otherwise(-1)))
    before = F.col("before")
    cue = F.lit(False)
    for i, k in enumerate(ALL_KINDS):
        cue = F.when(kind == i, before.rlike(CUES[k])).otherwise(cue)
    # a key or token is known by what names it: without a cue the labeler votes against it
    context = F.when(cue, 1).when(before.rlike(COUNTER_CUES) | (kind == ALL_KINDS.index("secret")), -1).otherwise(0)
    # loose patterns ask for clean edges themselves
    edges = F.when(F.col("loose"), 0).when(before.rlike(r"[\p{L}\p{N}_]$") | F.col("after").rlike(r"[\p{L}\p{N}_]"), -1).otherwise(1)
    signs = F.regexp_replace("text", r"[\p{L}\p{N}]", "")
    spans = spans.select("row", "kind", "loose", "start", "end", (~F.col("loose") & check).alias("base"),
                         F.when(F.col("loose"), loose_check).otherwise(F.when(check, 1).otherwise(-1)).alias("v_check"), gazetteer.alias("v_gazetteer"),
                         context.alias("v_context"), edges.alias("v_edges"), F.least(F.floor(F.length("text") / 8), F.lit(3)).cast("int").alias("size"),
                         F.least(F.floor(4 * n / F.length("text")), F.lit(3)).cast("int").alias("digit_share"),
                         F.least(F.length(signs), F.lit(2)).cast("int").alias("signs"))
    return rows.select("doc_id", "row"), staged(spans, "spans")


def _votes() -> list[str]:
    return [f"v_{x}" for x in LABELERS]


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> tuple[list[float], list[float]]:
    """Share of true spans of each kind and accuracy of each labeler, by
    expectation-maximisation over (kind, votes, count); a 0 abstains. Labelers are taken
    to be better than chance and independent given the truth."""
    share, accuracy = [0.5] * len(ALL_KINDS), list(LABELERS.values())
    for _ in range(rounds):
        true, all_, right, cast = [1.0] * len(ALL_KINDS), [2.0] * len(ALL_KINDS), [STRENGTH * a for a in LABELERS.values()], [STRENGTH] * len(LABELERS)
        for kind, votes, n in patterns:
            p = posterior(share[kind], accuracy, votes)
            true[kind] += n * p
            all_[kind] += n
            for j, v in enumerate(votes):
                if v:
                    cast[j] += n
                    right[j] += n * (p if v > 0 else 1 - p)
        share = [t / a for t, a in zip(true, all_)]
        accuracy = [min(0.99, max(0.55, r / c)) for r, c in zip(right, cast)]
    return share, accuracy


def posterior(share: float, accuracy: list[float], votes: tuple[int, ...]) -> float:
    logit = math.log(share / (1 - share)) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, accuracy))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


#: What the classifier sees of a span's content: length, share of digits, signs between
#: letters and digits, each in so many classes.
CONTENT = {"size": 4, "digit_share": 4, "signs": 3}


def _features(kind: int, votes: tuple[int, ...], content: tuple[int, ...]) -> list[int]:
    """Places of the ones in the classifier's input: content, votes, and content by kind."""
    ones, at = [0, 1 + kind], 1 + len(ALL_KINDS)
    for c, n in zip(content, CONTENT.values()):
        ones += [at + c, at + n + kind * n + c]
        at += n * (1 + len(ALL_KINDS))
    return ones + [at + 2 * j + (v > 0) for j, v in enumerate(votes) if v]


WIDTH = 1 + len(ALL_KINDS) + sum(CONTENT.values()) * (1 + len(ALL_KINDS)) + 2 * len(LABELERS)


def train(patterns: list[tuple[int, tuple[int, ...], tuple[int, ...], int]], rounds: int = 300) -> dict[tuple[int, tuple[int, ...], tuple[int, ...]], float]:
    """Probability of each (kind, votes, content): a logistic span classifier fitted to the
    labelers' posteriors. ``patterns`` are distinct inputs with their counts."""
    total: dict[tuple[int, tuple[int, ...]], int] = {}
    for kind, votes, _, n in patterns:
        total[kind, votes] = total.get((kind, votes), 0) + n
    share, accuracy = reliabilities([(k, v, n) for (k, v), n in sorted(total.items())])
    of_kind: dict[int, int] = {}
    for kind, _, _, n in patterns:
        of_kind[kind] = of_kind.get(kind, 0) + n
    # each kind weighs as much as any other, however rare it is
    rows = [(_features(k, v, c), posterior(share[k], accuracy, v), n / of_kind[k] / len(of_kind)) for k, v, c, n in patterns]
    weight = [0.0] * WIDTH
    for _ in range(rounds):
        slope = [1e-3 * w for w in weight]
        for f, p, n in rows:
            miss = (1 / (1 + math.exp(-sum(weight[i] for i in f))) - p) * n
            for i in f:
                slope[i] += miss
        weight = [w - 0.8 * g for w, g in zip(weight, slope)]
    return {(k, v, c): 1 / (1 + math.exp(-sum(weight[i] for i in _features(k, v, c)))) for k, v, c, _ in patterns}


def find(docs: DataFrame, *, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): spans (row, kind, start, end, base, probability) in code points, end
    exclusive, for the numbered rows of ``docs`` (doc_id, text).

    Strict spans always stay; of the loose candidates those stay that the classifier
    gives at least ``threshold`` and that touch no strict span. A null text is empty;
    rows that repeat are searched each for itself; without candidates there is nothing
    to train and no span."""
    rows, spans = candidates(docs)
    keys = ["kind", *_votes(), *CONTENT]
    counts = spans.groupBy(*keys).agg(F.count("*").alias("n")).collect()  # at most 7 kinds x 81 votes x 48 contents
    patterns = sorted((r["kind"], tuple(r[v] for v in _votes()), tuple(r[c] for c in CONTENT), r["n"]) for r in counts)
    scores = train(patterns)
    table = docs.sparkSession.createDataFrame([(k, *v, *c, p) for (k, v, c), p in scores.items()],
                                              ", ".join(f"{x} int" for x in keys) + ", probability double")
    scored = spans.join(F.broadcast(table), keys)  # as many rows as there are patterns
    w = Window.partitionBy("row").orderBy("start", "end")  # the spans of one text
    left = F.max(F.when(F.col("base"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(F.when(F.col("base"), F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(left, F.lit(-1)) <= F.col("start")) & (F.coalesce(right, F.col("end")) >= F.col("end"))
    scored = scored.withColumn("free", free)
    stay = F.col("base") | (F.col("loose") & F.col("free") & (F.col("probability") >= threshold))
    return rows, scored.where(stay).select("row", "kind", "start", "end", "base", "probability")


def digest(docs: DataFrame, **how) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (strict
    spans), base_sha256 and spans (kind:start:end by kind and start, comma-joined)."""
    rows, spans = find(docs, **how)
    name = F.element_at(F.array(*[F.lit(k) for k in ALL_KINDS]), F.col("kind") + 1)
    said = F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string"))
    one = F.struct("kind", "start", "end", said.alias("said"))
    per = spans.groupBy("row").agg(
        *[F.sum((F.col("base") & (F.col("kind") == i)).cast("long")).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.array_sort(F.collect_list(F.when(F.col("base"), one))).alias("base"), F.array_sort(F.collect_list(one)).alias("all"))  # the spans of one text
    out = rows.join(per, "row", "left")
    joined = lambda c: F.coalesce(F.array_join(F.col(f"{c}.said"), ","), F.lit(""))
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"))
