"""Every query with SQL gives DuckDB's rows on the small tables."""

import os

import duckdb
import pytest

from barloom.plans import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


#: The smallest table is too short for a fold of these.
FOLDED = {"e08_seed_audit", "m05_regimes_by_fold", "m12_walk_forward_scores"}


def shown(rows):
    return sorted(tuple("" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    cur = db.execute(SQL[name])
    have = [c[0] for c in cur.description]
    assert sorted(have) == names
    want = [tuple(r[have.index(c)] for c in names) for r in cur.fetchall()]
    assert shown(got) == shown(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    """Whole results; what they must be is in test_scale, test_models and test_operators."""
    df = QUERIES[name](spark, SF if name not in FOLDED else SF.replace("sf0.001", "sf0.01"))
    rows = df.collect()
    assert rows and len(set(rows)) > len(rows) / 2
