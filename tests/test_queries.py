"""Every registered query against its SQL twin."""

import os

import duckdb
import numpy as np
import pytest

from graphloom.plans import catalog


def _cell(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 5) + 0.0
    return str(v)


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(str, (_cell(v) for v in row))) for row in frame.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(name, spark, sf_dir, duck):
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_orphan_tiers_has_orphans_of_all_types(spark, sf_dir):
    from graphloom.operators import graph as G
    from graphloom.plans.code_view import code_edges, code_nodes

    sparse = code_edges(spark, sf_dir).where("rel_type = 'creates' AND edge_class = 'lexical'")
    lost = {r.node_id: r.symbol_type for r in G.orphans(code_nodes(spark, sf_dir), sparse).collect()}
    got = {r.orphan: r.widest for r in catalog.QUERIES["orphan_tiers"](spark, sf_dir).collect()}
    assert set(got) == set(lost) and {"function", "method", "macro", "markdown_document"} <= set(lost.values())
    assert all(w <= {"method": 2, "function": 3}.get(lost[n], 4) for n, w in got.items()) and {got[n] for n, t in lost.items() if t == "method"} == {2}
