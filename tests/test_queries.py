"""Each query against its SQL on the smallest tables, and what plans must not hold."""

import glob
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plain():
    from lodestrata.plans import analyses, queries  # noqa: F401  analyses registers its queries

    return queries.ORACLE


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        out.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return out


@pytest.mark.parametrize("name", sorted(plain()))
def test_same_as_sql(spark, con, name):
    from lodestrata.plans import queries

    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(show(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == sorted(tuple(show(r[columns.index(c)]) for c in sorted(columns)) for r in want.fetchall())
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cap_is_applied_before_the_shuffle(spark):
    from lodestrata.plans import queries

    assert "WindowGroupLimit" in queries.QUERIES["w01_cap_per_group"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_layering_of_a_long_chain(spark):
    """Named against its direction, and deeper than a recursion goes."""
    from lodestrata.operators.graph import layered

    names = [f"n{9999 - i}" for i in range(3000)]
    edges = spark.createDataFrame([("r", a, b) for a, b in zip(names, names[1:])] + [("r", names[-1], names[0])], "repo_id string, src string, dst string")
    nodes = spark.createDataFrame([("r", n) for n in names], "repo_id string, node string")
    got = {r.node: (r.layer, r.cut) for r in layered(edges, nodes).collect()}
    assert max(layer for layer, _ in got.values()) == 2999 and sum(len(cut) for _, cut in got.values()) == 1
