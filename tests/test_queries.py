"""Every catalogue query against its SQL on the smallest tables."""

import os
import re
from difflib import SequenceMatcher

import duckdb
import pytest

import __spark_entry__ as entry
from tessella.plans import flows, more, queries  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(format(r[i], ".9g") if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    want = db.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(map(tuple, df.collect()), df.columns) == plain(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fuzzy_resolution_looks_at_every_spelling(spark):
    key = lambda s: " ".join(re.sub("[^a-z0-9 ]", " ", s.lower()).split())
    raws = [r.raw for r in queries._raw(spark, SF).collect()]
    master = queries.standin.master(queries.standin.part(spark, SF)).orderBy("ordinal").collect()
    want = {}
    for raw in raws:
        score, _, name = min((-SequenceMatcher(None, key(raw), key(m.name)).ratio(), m.ordinal, m.name) for m in master)
        if -score >= 0.70:
            want[raw] = (name, round(-score, 4))
    got = {r.raw: (r.name, r.confidence) for r in queries.resolve_fuzzy(spark, SF).collect()}
    assert got == want and 0 < len(got) < len(raws)
