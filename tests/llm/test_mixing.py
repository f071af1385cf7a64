import duckdb
import pytest

from tessera.llm import mixing, queries


def rows_of(df):
    return sorted((r.doc_id, r.lang, r.source, r.mix_epoch, r.mix_tokens) for r in df.collect())


@pytest.fixture()
def docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")

    return make


def allot(budget, kids):
    """Plain water filling of (weight, cap) children."""
    own, left, rest = [0] * len(kids), set(range(len(kids))), budget
    while True:
        w = sum(kids[k][0] for k in left)
        full = {k for k in left if kids[k][1] * w <= rest * kids[k][0]}
        if not full:
            break
        for k in full:
            own[k] = kids[k][1]
            rest -= kids[k][1]
        left -= full
    w = sum(kids[k][0] for k in left)
    for k in left:
        own[k] = rest * kids[k][0] // w if w else 0
    return own


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "fr", "c", 1000), ("d1", "en", "d", 1000)], "domain string, lang string, source string, supply long"
    )
    got = {r.source: r.own for r in mixing.allocate(leaves, mixing.Mix(domains={}, languages={}, budget_percent=30, max_epochs=1)).collect()}
    # 903 tokens: 451 for each domain; 225 and 226 for d0's languages; a gives its 10, its sibling b the rest.
    assert got == {"a": 10, "b": 215, "c": 225, "d": 451}


@pytest.mark.parametrize("percent,epochs", [(100, 1), (60, 2), (250, 3), (500, 2)])
def test_fill_equals_plain_water_filling(spark, percent, epochs):
    kids = [("a", 3, 50), ("b", 1, 500), ("c", 2, 120), ("d", 5, 0), ("e", 1, 77)]
    budget = sum(c for _, _, c in kids) * percent // 500
    df = spark.createDataFrame([("r", n, w, c, budget) for n, w, c in kids], "root string, name string, w int, cap long, budget long")
    got = {r.name: r.own for r in mixing.fill(df, ["root"], "name").collect()}
    assert got == dict(zip([k[0] for k in kids], allot(budget, [(w, c) for _, w, c in kids])))


def test_prefixes_of_seeded_epochs(docs):
    rows = [(k, "w " * (k % 7 + 1), "en", "big" if k % 3 else "small") for k in range(300)]
    mix = mixing.Mix(domains={}, languages={}, budget_percent=80, max_epochs=4)
    out = mixing.mix_sources(docs(rows), mix).collect()
    supply = {s: sum(k % 7 + 1 for k in range(300) if (s == "big") == bool(k % 3)) for s in ("big", "small")}
    taken = {s: sum(r.mix_tokens for r in out if r.source == s) for s in supply}
    times = {}
    for r in out:
        times.setdefault(r.doc_id, []).append(r.mix_epoch)
    for s in supply:
        counts = [len(times.get(k, [])) for k in range(300) if (s == "big") == bool(k % 3)]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(e) == list(range(len(e))) for e in times.values())
    assert abs(sum(taken.values()) - sum(supply.values()) * 80 // 100) <= 2 * 7
    assert mixing.mix_sources(docs(rows).repartition(7), mix).collect().__len__() == len(out)


def test_edge_cases(docs):
    rows = [(1, None, None, None), (None, "a b c", "en", None), (2, "", "fr", "s"), (3, "x y", None, "s"), (3, "x y", None, "s"), (4, "long " * 50_000, "de", "t")]
    out = mixing.mix_sources(docs(rows).selectExpr("*", "1 AS mix_epoch", "2 AS whole", "3 AS last", "4 AS before"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "whole", "last", "before", "mix_domain", "mix_epoch", "mix_tokens"]
    assert all(r.mix_tokens > 0 for r in out.collect())
    assert mixing.mix_sources(docs([])).collect() == []


def test_registered_query_against_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{small}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op2_mix_sources"])
    cols = want.columns
    got = queries.op2(spark, small)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want.fetchall())
