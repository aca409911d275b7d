"""Registered corpus queries against their SQL on the smallest tables, and that all are registered."""

import duckdb
import pytest

import __spark_entry__ as entry
from palisade.llm.oracles import ORACLES
from palisade.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = REGISTRY[name](spark, SF).toPandas()
    expected = duck.sql(ORACLES[name]).df()[list(got.columns)]
    key = list(got.columns[:2])
    got, expected = (x.sort_values(key).reset_index(drop=True).astype(str) for x in (got, expected))
    assert len(got) and got.equals(expected)


def test_all_are_registered():
    names = set(entry.queries())
    assert set(REGISTRY) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in REGISTRY} == {f"op{i}" for i in range(1, 14)}
