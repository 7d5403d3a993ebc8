"""Every registered query runs and, where it has a SQL twin, gives the same rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def normal(table):
    names = sorted(table.schema.names)
    rows = []
    for row in zip(*[table.column(n).to_pylist() for n in names]):
        rows.append(tuple(_cell(v) for v in row))
    return names, sorted(rows, key=str)


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return v + 0.0
    return v


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5)
    return a == b


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got_names, got = normal(QUERIES[name](spark, DATA).toArrow())
    if name not in ORACLES:
        assert got_names
        return
    want_names, want = normal(duck.execute(ORACLES[name]).to_arrow_table())
    assert got_names == want_names
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if not all(same(a, b) for a, b in zip(g, w))]
    assert not bad, bad[:3]


CUT = (
    "a05_first_crossing", "a06_sustained_exceedance", "a12_regression_metrics", "a19_bundle_by_unit", "e08_running_min",
    "e09_isotonic_nonincreasing", "e10_downsample_even", "e11_downsample_until_failure", "j03_asof_prediction",
    "m08_member_interval", "m10_predict_batch", "p17_health_index", "v06_index_axis", "v13_monotone",
)


@pytest.mark.parametrize("name", CUT)
def test_query_with_cut_units(spark, duck, name, monkeypatch):
    """The same rows when every unit counts as large and is cut into many segments."""
    from lifespan.operators import isotonic
    from lifespan.operators.segments import Axis
    from lifespan.plans import score_queries
    from lifespan.sources import tables as tb

    def narrow(session, base):
        keyed = tb.event_rows(session, base).select("unit_id", "t")
        axis = Axis.fit(keyed, ("unit_id",), ("t", "row_number"), rows=3)
        assert not axis.whole_units
        return axis

    whole = isotonic.project_columns
    monkeypatch.setattr(tb, "event_axis", narrow)
    monkeypatch.setattr(isotonic, "project_columns", lambda df, axis, columns, slice_rows=4: whole(df, axis, columns, 4))
    monkeypatch.setattr(score_queries.isotonic, "isotonic_nonincreasing", lambda df, axis, v, n: whole(df, axis, {v: n}, 4))
    got_names, got = normal(QUERIES[name](spark, DATA).toArrow())
    want_names, want = normal(duck.execute(ORACLES[name]).to_arrow_table())
    assert got_names == want_names and len(got) == len(want)
    assert not [1 for g, w in zip(got, want) if not all(same(a, b) for a, b in zip(g, w))]
