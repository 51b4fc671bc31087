"""Every query with SQL against DuckDB, and the contract's three functions."""

import duckdb
import pytest

import __spark_entry__
from orogen import catalog

SF = "/root/testdata/sf0.01"
TABLES = ("lineitem", "customer", "part")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = df.select(cols).toPandas()
    want = db.execute(f"select {', '.join(cols)} from ({catalog.ORACLES[name]})").fetchdf()
    assert plain(got.itertuples(index=False)) == plain(want.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_trace_starts_with_the_best_split_and_accepts_five(spark):
    trace = catalog.QUERIES["divisive_trace"](spark, SF).orderBy("step").collect()
    best = catalog.QUERIES["best_split"](spark, SF).first()
    assert (trace[0]["dim"], trace[0]["pos"], trace[0]["n1"], trace[0]["reason"]) == (best["dim"], best["pos"], best["n1"], "valley")
    assert sum(t["accepted"] for t in trace) == 5 and all(t["accepted"] == (t["reason"] != "none") for t in trace)


def test_a_broken_subpackage_leaves_the_other_queries(spark, monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # importing it raises ImportError
    assert set(__spark_entry__.queries()) == set(catalog.QUERIES) and set(__spark_entry__.oracle_sql()) == set(catalog.ORACLES)


def test_six_planted_groups(spark):
    model = catalog.model_of(spark, SF)
    assert len(model.leaves) == model.number_of_clusters == 6
    first = model.trace[0]
    assert (first["dim"], first["pos"], first["n1"]) == (0, 349, 39954)


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
