import random

import pytest

from skirmish.llm import graph
from tests.llm import brute


def test_components_raise_where_rounds_run_out(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES", 10)
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        graph.components(chain, most_rounds=1)


def test_components_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES", 40)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 500, 1) if i % 97] + [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(250)] + [(1000, x) for x in range(1001, 1200)] * 2 + [(3, 3)]
    got = {r["id"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(16)).collect()}
    want = brute.components({x for e in edges for x in e}, edges)
    alone = set(want) - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k not in alone}


def test_components_of_one_partition_need_no_round(spark):
    assert {tuple(r) for r in graph.components(spark.createDataFrame([(3, 2), (2, 9), (7, 8)], "a long, b long"), most_rounds=1).collect()} == {(2, 2), (3, 2), (9, 2), (7, 7), (8, 7)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), most_rounds=1).count() == 0
