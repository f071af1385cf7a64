"""Steps that must not be made again in each round, nor hold more in a task of a larger table."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.operators import graph as G
from tessera.operators import joins as J
from tessera.operators import retrieval as R
from tessera.plans import bindings, registry


def counted(spark, df):
    """``df``, and a count of its rows each time they are made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), made


def test_trace_makes_its_edges_once(spark):
    pairs = [(i, i + 1) for i in range(8)] + [(0, 3), (3, 3)]
    edges, made = counted(spark, spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string"))
    got = G.trace(spark.createDataFrame([(1, "0"), (2, "6")], "task_id long, node string"), edges).collect()
    assert sorted(tuple(r) for r in got) == [(1, "0", 0), (1, "1", 1), (1, "2", 2), (1, "3", 1), (1, "4", 2), (1, "5", 3), (2, "6", 0), (2, "7", 1), (2, "8", 2)]
    assert made.value == len(pairs)


def test_rename_impact_makes_its_bindings_once(spark):
    rows = [(f"f{2 * i + k}", f"f{i}", "n", True) for i in range(1, 16) for k in (0, 1)]
    bound, made = counted(spark, spark.createDataFrame(rows, "file string, module string, symbol string, reexports boolean"))
    declared = spark.createDataFrame([("f1", "n")], "file string, symbol string")
    got = {r.file: r.depth for r in G.rename_impact(bound, declared, declared.select("symbol")).collect()}
    assert got == {f"f{i}": i.bit_length() - 1 for i in range(1, 32)}
    assert made.value == len(rows)


def test_known_ranking_of_nulls_and_repeats(spark):
    ranking = spark.createDataFrame([(1, 5, 7), (1, 3, 7), (1, 9, 8), (None, 1, 7), (2, 4, None)], "task_id int, pos int, id int")
    known = spark.createDataFrame([(1, 7), (1, 7), (3, 9), (None, 7), (2, None)], "task_id int, id int")
    good, bad = J.validate_ranking(ranking, known)
    assert [tuple(r) for r in good.collect()] == [(1, 7, 3)]
    assert sorted((tuple(r) for r in bad.collect()), key=str) == sorted([(1, 8, 9), (None, 7, 1), (2, None, 4)], key=str)
    rows = ranking.select("task_id", "id", "pos", F.lit(1).alias("ranked"), (F.col("pos") == 3).cast("int").alias("known"))
    assert {tuple(r) for r in J.known_ranking(rows, 5).collect()} == {(1, 7, 3, True), (1, 8, 9, False), (None, 7, 1, False), (2, None, 4, False)}


@pytest.mark.parametrize("name", ["jon_owner_consumer", "jon_validate_ranking", "jon_default_by_key"])
def test_more_rows_are_dealt_over_more_tasks(spark, name, monkeypatch):
    monkeypatch.setattr(bindings, "TASK_ROWS", 100)
    tables = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{tables}/lineitem.parquet").count()
    assert registry.queries()[name](spark, tables).rdd.getNumPartitions() >= rows / 100


def test_defaults_are_looked_up_once_for_each_tool_and_type(spark):
    templates = spark.createDataFrame([(4, "a", "x"), (3, "a", "general"), (2, "generic", "x"), (9, "generic", "general")], "template_id int, tool string, type string")
    asked, expected = [(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, None, None), (5, "b", "z"), (5, "a", "x"), (None, "a", "x")], []
    for k in (1, 2, 3, 4, 5, 5):
        expected.append({1: (1, 4, 0), 2: (2, 3, 1), 3: (3, 2, 2), 4: (4, 9, 3), 5: (5, 4, 0)}[k])
    many = asked + [(i, "a", "x") for i in range(10, 500)]
    out = C.default_by_key(spark.createDataFrame(many, "request_id int, tool string, type string"), templates)
    got = [tuple(r) for r in out.collect()]
    assert sorted(g for g in got if g[0] is not None and g[0] < 10) == expected and (None, None, None) in got and len(got) == len(many)


def test_scored_candidates_shuffle_few_rows_and_add_up_repeats(spark):
    """Every document shares words with every query; rows of one id count together."""
    docs = [(i, f"{'alpha' if i % 3 == 0 else 'other'} head\nalpha beta gamma {'delta' if i % 5 == 0 else 'eps'}") for i in range(40)] + [(7, "beta alpha"), (None, "gamma"), (41, None)]
    asked = [(1, "alpha beta delta"), (2, "gamma"), (2, "gamma eps"), (3, "zzz"), (None, "delta")]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    q = spark.createDataFrame(asked, "item_id int, text string")
    tally = {}
    for qi, qt in asked:
        for di, dt in docs:
            tokens, head = set((dt or "").split()), set((dt or "").split("\n")[0].split())
            for w in set(qt.split()) & tokens:
                n, h = tally.get((qi, di), (0, 0))
                tally[qi, di] = (n + 1, h + (w in head))
    want = set()
    for qi in {k[0] for k in tally}:
        own = sorted(((-(18 * n + 18 * h + 34 * (h > 0)), di is not None, di or 0, di, n, h) for (q_, di), (n, h) in tally.items() if q_ == qi))
        want |= {(qi, x[3], x[4], x[5], -x[0], r + 1) for r, x in enumerate(own[:18]) if -x[0] >= max(32, 0.62 * -own[0][0])}
    out = R.scored_candidates(q, d)
    assert {(r.item_id, r.doc_id, r.overlap, r.head_hits, r.score, r["rank"]) for r in out.collect()} == want
