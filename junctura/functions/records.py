"""Severity, codebook flags, grades, tiers, rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from junctura.config import INJURY, KSI, SEVERITY_MAX, SEVERITY_MIN

# Codebook of the state extract.
NIGHT_CODES = ("B", "C", "D", "E")
BROADSIDE_CODES = ("D",)
LEFT_TURN_CODES = ("E",)
PED_ROW_CATEGORY = "09"
# Wording and envelope of the national fatal census.
JUNCTION_WORDS = ("Intersection", "Intersection-Related")
FREEWAY_WORDS = "(?i)interstate|freeway|expressway"
BROADSIDE_WORDS = "(?i)angle"
NIGHT_WORDS = "(?i)dark|dusk|dawn"
ENVELOPE_LAT, ENVELOPE_LON = (17.0, 72.0), (-180.0, -64.0)

# Inspection themes and facility types.
THEMES = {
    "temperature": "Food temperatures", "handwashing": "Hand washing", "vermin": "Pests",
    "sanitizing": "Cleaning and sanitizing", "storage": "Food storage", "hygiene": "Employee hygiene",
    "equipment": "Equipment", "plumbing": "Plumbing and water", "labeling": "Labels and records", "other": "Other",
}
FACILITY_TYPES = {
    "restaurant": "Restaurant", "market": "Market", "mobile": "Food truck or cart", "bar": "Bar",
    "school": "School kitchen", "bakery": "Bakery", "caterer": "Caterer", "other": "Food facility",
}


def is_ksi(sev: Column) -> Column:
    return sev.isin(*KSI)


def valid_severity(sev: Column) -> Column:
    return sev.between(SEVERITY_MIN, SEVERITY_MAX)


def valid_point(lat: Column, lon: Column) -> Column:
    """False, never null, for a missing coordinate."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def severity_group(raw: Column) -> Column:
    """ksi / injury / pdo; anything unreadable is pdo."""
    s = raw.cast("string").try_cast("int")
    return F.when(s.isin(*KSI), "ksi").when(s.isin(*INJURY), "injury").otherwise("pdo")


def keeps_unknown(col: Column, excluded: str) -> Column:
    """``col`` differs from ``excluded``; an unknown value is kept."""
    return ~col.eqNullSafe(F.lit(excluded))


def grade_for(score: Column) -> Column:
    return F.when(score.isNull(), None).when(score >= 90, "A").when(score >= 80, "B").otherwise("C")


def tier_for(rank: Column) -> Column:
    return (F.when(rank <= 50, "Highest risk").when(rank <= 100, "High risk").when(rank <= 200, "Elevated risk")
            .otherwise("Moderate risk"))


def two_figures(n: Column) -> Column:
    """Two significant figures, half up; 0 for nothing."""
    d = n.cast("double")
    unit = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(F.nullif(d, F.lit(0.0)))) - 1, F.lit(0)))
    return F.coalesce((F.floor(d / unit + 0.5) * unit).cast("bigint"), F.lit(0).cast("bigint"))


def safe_date(y: Column, m: Column, d: Column) -> Column:
    """Date from parts, null for an impossible one."""
    text = F.format_string("%04d-%02d-%02d", y.try_cast("int"), m.try_cast("int"), d.try_cast("int"))
    ok = y.isNotNull() & m.isNotNull() & d.isNotNull()
    return F.when(ok, F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def parsed_date(raw: Column) -> Column:
    """Leading ISO day of a text, null when it is not a date."""
    return F.try_to_timestamp(F.substring(raw, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
