from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

import __spark_entry__
from netloom.operators import paths
from netloom.plans import catalog, graph
from tests.compare import FOLDER, check


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark: SparkSession, name: str) -> None:
    check(catalog.QUERIES[name](spark, FOLDER), catalog.ORACLE[name])


def test_components_equal_plain_ones(spark: SparkSession) -> None:
    """Over the order lines, and over pairs that form chains, rings and single links."""
    pairs = graph.topology(spark, FOLDER).collect()
    chains = [(f"n{k:03}", f"n{k + 1:03}") for k in range(200) if k % 17] + [("z", "z"), ("n005", "n001")]
    for edges in ([tuple(r) for r in pairs], chains):
        part: dict[str, str] = {}
        for a, b in edges:
            low, high = sorted((part.setdefault(a, a), part.setdefault(b, b)))
            if low != high:
                part = {k: low if v == high else v for k, v in part.items()}
        got = paths.components(spark.createDataFrame(edges, "src string, dst string")).collect()
        assert {r["node"]: r["component"] for r in got} == part and len(got) == len(part)
    assert catalog.QUERIES["link_components"](spark, FOLDER).count() == len({x for r in pairs for x in r})


def test_every_query_has_sql_or_a_test() -> None:
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"link_components"}


def test_entry_gives_rows(spark: SparkSession) -> None:
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries() -> None:
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
