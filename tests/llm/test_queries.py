"""The registered queries against their SQL in DuckDB at the smallest scale."""

import math
import os

import pytest

from junctura.llm.queries import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="bundled tables absent")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v if isinstance(v, bool) else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"create view {t} as from '{DIR}/{t}.parquet'")
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, DIR)
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect()) == want


def test_every_operator_has_one_query():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES if n.startswith("op")) == list(range(1, 14)) and "pipeline" in QUERIES
