"""Every registered query against its SQL twin, and the shape of its plan."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from strandline.plans.oracle import oracle_sql
from strandline.plans.queries import queries
from strandline.session import tune

QUERIES = queries()
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.fixture(scope="module")
def gate_dir():
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("test tables not present")
    return str(folder)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


def test_entry_returns_ranked_terms(spark, sf_dir):
    rows = contract.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, sf_dir, duck, name):
    tune(spark)
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cursor = duck.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert normal(got, df.columns) == normal(want, columns)

    plan = df._jdf.queryExecution().executedPlan().toString()
    for slow in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert slow not in plan


FILTERS = sorted(
    name
    for name in QUERIES
    if name.startswith(("f_", "path_", "proj_")) or name in ("search_all", "set_intersect", "set_minus")
)


@pytest.mark.parametrize("name", FILTERS)
def test_filter_arguments_select_a_proper_subset(spark, gate_dir, name):
    """At the scale of the correctness gate no filter may be trivial."""
    everything = QUERIES["pivots_load"](spark, gate_dir).count()
    assert 0 < QUERIES[name](spark, gate_dir).count() < everything


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("g_sel_")))
def test_selected_graphs_are_fewer_than_all(spark, gate_dir, name):
    everything = QUERIES[{"g_sel_edges": "g_single_edges", "g_sel_shape": "g_graph_shape"}.get(name, name.replace("_sel", ""))]
    assert 0 < QUERIES[name](spark, gate_dir).count() < everything(spark, gate_dir).count()


def test_shapes_are_counted_for_the_roots_only(spark, sf_dir):
    plan = QUERIES["g_sel_shape"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Aggregate") :]


def test_an_export_is_written_once(spark, sf_dir):
    first = QUERIES["src_json"](spark, sf_dir)
    rows = QUERIES["src_json"](spark, sf_dir).count()
    assert first.count() == rows > 0
