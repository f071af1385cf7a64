import random

import pytest
from pyspark.sql import functions as F
from test_simhash import classes

from tessera.llm import components
from tessera.llm.components import connected_components


@pytest.mark.parametrize("parts,most", [(1, 10**6), (7, 10**6), (7, 100), (3, 40)])
def test_against_union_find(spark, monkeypatch, parts, most):
    monkeypatch.setattr(components, "EDGES", most)
    rng = random.Random(parts)
    edges = [(rng.randrange(300) - 150, rng.randrange(300) - 150) for _ in range(220)]
    edges += [(k, k + 1) for k in range(1000, 1400)] + [(5000, k) for k in range(5001, 5300)] + [(7, 7)]
    nodes = sorted({n for e in edges for n in e})
    own = classes(len(nodes), [(nodes.index(a), nodes.index(b)) for a, b in edges])
    want = {n: nodes[own[k]] for k, n in enumerate(nodes)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(parts, F.rand(3))
    got = {r.node: r.component for r in connected_components(df).collect()}
    alone = {n for n in nodes if list(want.values()).count(want[n]) == 1}
    assert got == {n: c for n, c in want.items() if n not in alone}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
