import hashlib

import corpus_pipeline as C
import public_tokenizers as P
from test_simhash import brute

from tessera.llm import bpe, mixing, quality_qda
from tessera.llm.queries import queries


def test_stages_and_run(spark, small):
    assert [n for n, _ in C.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources", "byte-level BPE"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kinds = dict(docs.dtypes)
    steps = [docs]
    for name, stage in C.STAGES:
        out = stage(spark, steps[-1], small).cache()
        if name != "byte-level BPE":
            assert dict(out.dtypes) == kinds
        steps.append(out)
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[1] < ids[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    good = {i for i in ids[0] if labels.get(i) == 1}
    assert len(good & ids[1]) >= 0.95 * len(good)
    scores = quality_qda.apply(quality_qda.features(docs), quality_qda.train(docs, spark.read.parquet(f"{small}/labels.parquet")))
    assert {r.doc_id for r in scores.filter("predicted = 1").collect()} == ids[1]
    after_lines = [(r.doc_id, r.text) for r in steps[2].collect()]
    assert {i for i, _, c in brute(after_lines) if i == c} == ids[3]
    mixed = sorted((r.doc_id, r.text) for r in steps[4].collect())
    assert mixed == sorted((r.doc_id, r.text) for r in mixing.mix_sources(steps[3]).collect())
    codec = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = sorted((i, *codec.digest(t or "")) for i, t in mixed)
    got = sorted(tuple(r) for r in steps[5].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == want and all(r[3] == hashlib.sha256((t or "").encode()).hexdigest() for r, (_, t) in zip(got, mixed))
    assert sorted(tuple(r) for r in C.run(spark, small).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_registered():
    names = list(queries())
    assert len([n for n in names if n.startswith("op")]) == 10 and "pipeline" in names and C.ORACLE_SQL is None


def test_stages_on_odd_rows(spark, small):
    """Nulls, repeats, empty texts and columns of the operators' own names pass every stage; empty tables give empty ones."""
    good = "The quick brown fox jumps over the lazy dog, and then it rests by the river. " * 8
    rows = [(1, good + "\nshared line of many documents"), (1, good + "\nshared line of many documents"), (None, "no id: a text of its own"), (2, None), (3, ""), (4, "shared line of many documents"), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, mix_tokens string, fp string, component string, th string"
    docs = spark.createDataFrame([(i, t, None if i == 1 else "en", None if i == 3 else "s0", len(t or ""), 7, "own", "f", "c", "t") for i, t in rows], schema)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.dtypes == docs.dtypes, name
        got = out.collect()
        assert all((r.n_lines, r.mix_tokens, r.fp, r.component, r.th) == (7, "own", "f", "c", "t") for r in got), name
        assert {r.doc_id for r in got} <= {1, 2, 3, 4, None}, name
        assert stage(spark, docs.limit(0), small).collect() == [], name
    left = sorted(((r.doc_id, r.text) for r in C.lines(spark, docs, small).collect()), key=str)
    assert left == sorted([r for r in rows if r[0] != 4], key=str)  # the last word of 4 went
    one = sorted(((r.doc_id, r.text) for r in C.near_duplicates(spark, docs, small).collect()), key=str)
    assert one == sorted([rows[0], rows[2], (2, None), rows[5]], key=str)
    coded = C.encode(spark, docs, small).collect()
    assert len(coded) == len(rows) and C.encode(spark, docs.limit(0), small).collect() == []
