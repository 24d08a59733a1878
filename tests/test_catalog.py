"""Queries against their SQL in DuckDB at the smallest scale. JUNCTURA_FULL=1 runs
every query; the default takes a spread of the cheap ones."""

import math
import os

import pytest

from junctura import catalog

duckdb = pytest.importorskip("duckdb")
catalog.load_all()
DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FULL = os.environ.get("JUNCTURA_FULL") == "1"
SAME_SIZE_ONLY = {"q2_dictionary_gate", "q6_expected_counts"}
NAMES = sorted(catalog.SQL) if FULL else sorted(n for n in catalog.SQL if not n.startswith("m"))[::9]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="bundled tables absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 5) + 0.0
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    cur = con.execute(catalog.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr([plain(r[cols.index(c)]) for c in sorted(cols)]) for r in cur.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(cols)]) for r in df.collect())
    assert got == want


def test_every_query_is_registered_once():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 150
