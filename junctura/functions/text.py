"""Street-name keys, tag parsing, search scoring: column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Suffix spellings and directionals.
SUFFIXES = {
    "boulevard": "boulevard", "blvd": "boulevard", "bl": "boulevard", "blv": "boulevard",
    "avenue": "avenue", "ave": "avenue", "av": "avenue",
    "street": "street", "st": "street",
    "drive": "drive", "dr": "drive",
    "road": "road", "rd": "road",
    "way": "way", "wy": "way",
    "lane": "lane", "ln": "lane",
    "court": "court", "ct": "court",
    "place": "place", "pl": "place",
    "parkway": "parkway", "pkwy": "parkway", "pky": "parkway", "pw": "parkway",
    "highway": "highway", "hwy": "highway", "hy": "highway",
    "terrace": "terrace", "ter": "terrace", "terr": "terrace",
    "circle": "circle", "cir": "circle",
    "trail": "trail", "trl": "trail", "tl": "trail",
    "freeway": "freeway", "fwy": "freeway",
    "expressway": "expressway", "expy": "expressway",
    "mount": "mount", "mt": "mount",
}
DIRECTIONALS = ("north", "south", "east", "west", "n", "s", "e", "w", "ne", "nw", "se", "sw")

# Separators between cross streets, and location wordings.
LIMITS_SPLIT = r"(?i)\s+-\s+|\s+to\s+|\s*/\s*|\s*&\s*|\s+and\s+|\s*_\s*"
BETWEEN = r"(?i)^(.*?)\s+(?:btwn|between|bet\.?|b/w)\s+(.*)$"
AT = r"(?i)^(.*?)\s+(?:at|@)\s+(.*)$"

# Spellings compared when two maps name one road.
VARIANT_SUFFIXES = (
    ("boulevard", "blvd"), ("avenue", "ave"), ("street", "st"), ("drive", "dr"), ("road", "rd"), ("lane", "ln"),
    ("court", "ct"), ("place", "pl"), ("parkway", "pkwy"), ("highway", "hwy"), ("terrace", "ter"), ("circle", "cir"),
)

# Search separators and abbreviations.
SEARCH_SPLIT = r"(?i)\s*(?:&|/|@|,|\+|\band\b|\bx\b|\bat\b|\bwith\b)\s*|\s+"
SEARCH_ABBREVIATIONS = {
    "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bl": "boulevard", "rd": "road",
    "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "pkwy": "parkway", "hwy": "highway",
    "ter": "terrace", "cir": "circle", "trl": "trail", "wy": "way",
}
PLACE_SPLIT = r"(?i)\s*(?:&|/|@|,|\+|\band\b|\bat\b|\bon\b)\s*|\s+"
PLACE_ABBREVIATIONS = {
    "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "rd": "road", "dr": "drive",
    "ln": "lane", "ct": "court", "pl": "place", "pkwy": "parkway", "hwy": "highway", "ter": "terrace", "cir": "circle",
}

# Words for unnamed roads.
ROAD_WORDS = {
    "service": "service road", "residential": "unnamed street", "living_street": "unnamed street",
    "unclassified": "unnamed road", "tertiary": "unnamed road", "secondary": "unnamed road",
    "primary": "unnamed road", "tertiary_link": "connector road", "secondary_link": "connector road",
    "primary_link": "connector road", "trunk_link": "ramp", "motorway_link": "ramp", "track": "track",
    "path": "path", "footway": "footpath", "cycleway": "bike path", "pedestrian": "pedestrian way",
}
SERVICE_WORDS = {
    "alley": "alley", "driveway": "driveway", "parking_aisle": "parking aisle",
    "drive-through": "drive-through", "emergency_access": "emergency access road",
}
# Road class order, most major first.
ROAD_CLASS = {
    "motorway": 1, "motorway_link": 1, "trunk": 2, "trunk_link": 2, "primary": 3, "primary_link": 3,
    "secondary": 4, "secondary_link": 4, "tertiary": 5, "tertiary_link": 5, "residential": 6,
    "living_street": 7, "unclassified": 6,
}
FREEWAY_TYPES = ("motorway", "motorway_link")
TRUNK_TYPES = ("trunk", "trunk_link")
MPH_KPH = 1.60934


def lookup(table: dict, key: Column) -> Column:
    """Value for the key from a small fixed table, null when absent."""
    m = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.try_element_at(m, key)


def road_key(name: Column) -> Column:
    """Lower case, directionals dropped, suffixes spelled out, punctuation gone."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(tokens, lambda t: ~t.isin(*DIRECTIONALS))
    return F.array_join(F.transform(kept, lambda t: F.coalesce(lookup(SUFFIXES, t), t)), " ")


def limits_keys(limits: Column) -> Column:
    parts = F.split(F.coalesce(limits, F.lit("")), LIMITS_SPLIT)
    return F.transform(F.filter(parts, lambda p: F.trim(p) != ""), road_key)


def parse_location(text: Column) -> tuple[Column, Column]:
    """(street, limits) from "A btwn B _ C" or "A at B"; nulls when neither fits."""
    t = F.trim(F.coalesce(text, F.lit("")))
    m1, m2 = t.rlike(BETWEEN), t.rlike(AT)
    street = F.when(m1, F.trim(F.regexp_extract(t, BETWEEN, 1))).when(m2, F.trim(F.regexp_extract(t, AT, 1)))
    limits = F.when(m1, F.trim(F.regexp_replace(F.regexp_extract(t, BETWEEN, 2), r"\s*_\s*", " & "))).when(
        m2, F.trim(F.regexp_extract(t, AT, 2)))
    return street, limits


def year_of(text: Column) -> Column:
    y = F.regexp_extract(F.coalesce(text, F.lit("")), r"(19|20)\d{2}", 0)
    return F.try_to_number(y, F.lit("9999")).cast("int")


def split_label(name: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), " & "), lambda s: F.trim(s)), lambda s: s != "")


def pair_key(a: Column, b: Column) -> Column:
    """Unordered pair of road keys as one string; null unless two different roads."""
    k = F.array_join(F.array_sort(F.array(a, b)), " | ")
    return F.when((a != "") & (b != "") & (a != b), k)


def label_pair_key(name: Column) -> Column:
    parts = split_label(name)
    return F.when(F.size(parts) == 2, pair_key(road_key(parts[0]), road_key(parts[1])))


def lanes_number(tag: Column) -> Column:
    """"3" or "2|1" (mean of the parts that are numbers) to a double."""
    s = F.trim(tag)
    sep = F.when(s.contains("|"), r"\|").when(s.contains(";"), ";").when(s.contains(","), ",")
    parts = F.split(s, F.coalesce(sep, F.lit("\u0000")))
    vals = F.filter(F.transform(parts, lambda p: F.trim(p).try_cast("double")), lambda v: v.isNotNull())
    total = F.aggregate(vals, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(vals) > 0, total / F.size(vals))


def speed_kph(tag: Column, default: float | None = None) -> Column:
    s = F.trim(F.lower(tag))
    d = F.lit(default).cast("double")
    mph = F.trim(F.replace(s, F.lit("mph"), F.lit(""))).try_cast("double") * MPH_KPH
    kmh = F.trim(F.regexp_replace(s, "km/h|kph", "")).try_cast("double")
    val = F.when(s.contains("mph"), mph).when(s.rlike("km/h|kph"), kmh).otherwise(s.try_cast("double"))
    return F.when(tag.isNull() | s.isin("none", "signals", "variable", ""), d).otherwise(F.coalesce(val, d))


def tag_list(raw: Column) -> Column:
    """A scalar tag or a stringified list ("['a', 'b']") as an array."""
    inner = F.regexp_extract_all(raw, F.lit(r"'([^']*)'"), F.lit(1))
    return F.when(raw.isNull() | (raw == ""), F.array().cast("array<string>")).when(
        raw.startswith("["), inner).otherwise(F.array(raw))


def canonical_name(names: Column) -> Column:
    """The longest spelling (ties: the greatest), null when there is none."""
    clean = F.filter(F.transform(names, lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != ""))
    best = F.array_max(F.transform(clean, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))
    return best["s"]


def unnamed_road(service: Column, highway: Column) -> Column:
    """Noun phrase for an unnamed road from its first service or highway tag."""
    h = F.get(highway, 0)
    return F.coalesce(lookup(SERVICE_WORDS, F.get(service, 0)),
                      F.when(h.isNotNull(), F.coalesce(lookup(ROAD_WORDS, h), F.lit("unnamed road"))))


def variant_key(name: Column) -> Column:
    """Key under which spelling variants of one road agree."""
    s = F.regexp_replace(F.lower(name), r"\b(north|south|east|west|n|s|e|w|ne|nw|se|sw)\b", " ")
    for long, short in VARIANT_SUFFIXES:
        s = F.regexp_replace(s, rf"\b{long}\b", short)
    return F.regexp_replace(s, "[^a-z0-9]", "")


def same_road(a: Column, b: Column) -> Column:
    ka, kb = variant_key(a), variant_key(b)
    return (ka != "") & (kb != "") & (ka.contains(kb) | kb.contains(ka))


def search_tokens(query: str, places: bool = False) -> list[str]:
    """The query's words, abbreviations spelled out (the query is one string)."""
    import re
    table = PLACE_ABBREVIATIONS if places else SEARCH_ABBREVIATIONS
    parts = re.split(PLACE_SPLIT if places else SEARCH_SPLIT, (query or "").lower())
    words = [re.sub(r"\.$", "", p.strip()) for p in parts if p]
    return [table.get(w, w) for w in words if w]


def match_score(text: Column, tokens: list[str], boundary: str = r"[ &]") -> Column:
    """Sum over the words of their position (+500 off a word start), null when a
    word is missing. Lower is better."""
    score = F.lit(0)
    for t in tokens:
        at = F.instr(text, t)
        start = (at == 1) | F.substring(text, at - 1, F.lit(1)).rlike(boundary)
        score = score + F.when(at > 0, F.when(start, 0).otherwise(500) + at - 1)
    return score


def expand_address(text: Column) -> Column:
    s = F.lower(text)
    for short, long in PLACE_ABBREVIATIONS.items():
        s = F.regexp_replace(s, rf"\b{short}\b\.?", long)
    return s
