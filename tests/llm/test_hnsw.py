import numpy as np

from tessera.llm import hnsw
from tessera.llm.queries import op3

IS_QUERY = "vec_id % 20 = 0"


def brute(rows, k=20):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for i, q in rows:
        if i % 20 == 0:
            score = sorted(((-float((q * v).sum()), j) for j, v in rows if j != i))
            out[i] = [j for _, j in score[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r)
    for rows in out.values():
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
        assert all(a.score > b.score or (a.score == b.score and a.vec_id < b.vec_id) for a, b in zip(rows, rows[1:]))
    return out


def recall(got, want):
    hit = sum(len({r.vec_id for r in got.get(q, [])} & set(ids)) for q, ids in want.items())
    return hit / sum(map(len, want.values()))


def test_recall_of_the_registered_query(spark):
    path = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got = found(op3(spark, path))
    assert recall(got, brute(rows)) >= 0.95
    original = {i: np.array(v, float) for i, v in rows}
    for q, rs in got.items():
        assert len(rs) == 20 and all(abs(r.score - float((original[q] * original[r.vec_id]).sum())) < 1e-12 for r in rs)


def test_many_shards_and_any_norms(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 300)
    monkeypatch.setattr(hnsw, "QUERIES", 30)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=24) * rng.uniform(0.1, 5)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(found(hnsw.nearest(df, IS_QUERY)), brute(rows)) >= 0.95


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 2.0], "c") for k in range(0, 90)]  # one vector, many rows
    rows += [(100, [2.0, 1.0], "c"), (101, None, "c"), (102, [0.0, -0.0], "c"), (103, [1.0, None], "c"), (104, [nan, 1.0], "c"), (105, [inf, 1.0], "c"), (None, [1.0, 1.0], "c")]
    rows += [(120, [1.0, 2.0, 3.0], "c"), (140, [3.0], "c"), (141, [2.0], "c"), (100, [2.0, 1.0], "c"), (160, [], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").selectExpr("*", "1 AS rank", "2 AS dim", "3 AS v")
    got = found(hnsw.nearest(df, IS_QUERY))
    same = [k for k in range(90)]
    for q in (0, 20, 40, 60, 80):
        assert [r.vec_id for r in got[q]] == [k for k in same if k != q][:20]
    assert [r.vec_id for r in got[100]] == same[:20]
    assert [r.vec_id for r in got[140]] == [141] and 120 not in got and 160 not in got
    assert hnsw.nearest(df.filter("false"), IS_QUERY).collect() == []
