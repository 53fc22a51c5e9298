"""Every registered query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from neuroloom.operators import motifs, nullmodels
from neuroloom.plans import registry
from neuroloom.sources.tables import load

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def key(row):
    return tuple((x is None, "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)) for x in row)


def compare(con, name, df):
    rel = con.execute(registry.oracle_sql()[name])
    names = sorted(d[0] for d in rel.description)
    order = [d[0] for d in rel.description]
    want = sorted((tuple(r[order.index(n)] for n in names) for r in rel.fetchall()), key=key)
    assert sorted(df.columns) == names
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, (int, float)) and y is not None and math.isclose(float(x), float(y), abs_tol=2e-6), (a, b)


DEALT = {name.replace("null_", "dealt_"): name for name in motifs.NULL_Z}


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - set(DEALT)))
def test_against_duckdb(spark, con, name):
    compare(con, name, registry.queries()[name](spark, SF))


def test_null_z_against_duckdb(spark, con):
    """All eight on one census of the replicas, which each query would make anew."""
    tables = {k: load(spark, SF, k) for k in ("edges", "nodes", "scorr")}
    replicas = motifs.replica_census(nullmodels.dealt(edges=tables["edges"])).cache()
    census = motifs.motif_census(edges=tables["edges"]).cache()
    for name, op in DEALT.items():
        z = motifs.NULL_Z[op]
        compare(con, name, z(**{k: {"census": census, "replicas": replicas, **tables}[k] for k in z.inputs}))
