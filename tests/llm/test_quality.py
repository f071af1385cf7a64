import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_qda, quality_rules, queries, toxicity

PATH = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    good = np.array(y) == 1
    return (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


@pytest.mark.parametrize("query,label,parts,rest,least", [(queries.op8, "quality", 4, 2, 0.97), (queries.op7, "toxic", 3, 1, 0.9)])
def test_held_out_accuracy(spark, query, label, parts, rest, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{PATH}/labels.parquet").collect()}
    rows = query(spark, PATH).collect()
    assert len(rows) == spark.read.parquet(f"{PATH}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and labels.get(r.doc_id) in (0, 1)]
    assert auc([r.score for r in held], [labels[r.doc_id] for r in held]) >= least
    clean = [r.predicted for r in held if labels[r.doc_id] == 0]
    assert np.mean(clean) <= 0.03


def test_classifier_edge_cases(spark, docs_of):
    rows = [(k, "The words of a text. They stand, one by one. " * (k % 9 + 1)) for k in range(40)] + [(100 + k, "buy### now### $$$ " * (k % 9 + 1)) for k in range(40)]
    rows += [(900, None), (901, ""), (None, "words"), (1, "repeated row"), (902, "x " * 50_000)]
    df = docs_of(rows)
    labels = spark.createDataFrame(
        [(k, 1, 0) for k in range(40)] + [(100 + k, 0, 1) for k in range(40)] + [(3, 0, 1), (5, None, None), (None, 1, 1), (6, 7, 7)], "doc_id long, quality int, toxic int"
    )
    good = quality_qda.score(df, labels).collect()
    assert len(good) == len(rows) and all(0 <= r.score <= 1 for r in good)
    by = {r.doc_id: r.score for r in good}
    assert by[10] > 0.9 and by[110] < 0.1
    kept = quality_qda.keep_good(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {10, 11, 12} and 110 not in {r.doc_id for r in kept.collect()}
    model = toxicity.train(df, labels, toxicity.Params(l1=1.0))
    bad = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert bad[110] > bad[10] and len(bad) == len({i for i, _ in rows})
    for none in (labels.filter("false"), labels.filter("quality = 1")):
        assert len(quality_qda.score(df, none).collect()) == len(rows)
        assert len(toxicity.score(df, toxicity.train(df, none)).collect()) == len(rows)
    assert quality_qda.score(docs_of([]), labels).collect() == [] == toxicity.score(docs_of([]), model).collect()


def test_log_density_difference():
    rng = np.random.default_rng(0)
    d = len(quality_qda.NAMES)
    x = rng.normal(size=(50, d))
    factor = [np.linalg.cholesky(np.cov(rng.normal(size=(d, 99)))) for _ in (0, 1)]
    mean = rng.normal(size=(2, d))
    model = quality_qda.Model(mean, np.array([np.linalg.inv(f) for f in factor]), np.array([-np.log(np.diag(f)).sum() for f in factor]))
    log = [-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(f @ f.T), x - m) - 0.5 * np.linalg.slogdet(f @ f.T)[1] for m, f in zip(mean, factor)]
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-(log[1] - log[0]).clip(-35, 35))))


def plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = list(zip(words, words[1:], words[2:]))
    spots = {p + k for p, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(spots)


def test_rules_against_plain_python(docs_of):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c a b c a"), (5, "x x x x x"), (6, "a b c\na b c\n\n \na b c"), (7, "é漢 😀 #*$%&|<> \x0b\x0c y"), (8, "one"), (9, "two words"), (8, "one"), (None, "a b c d a b c d e f g a b"), (10, "w " * 3000 + "end")]
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.assess(docs_of(rows)).collect()), key=str)
    assert got == sorted(((i, *(plain_rules(t) if i != 10 else (3001, 3003, 0, 0, 3000))) for i, t in rows), key=str)
    assert quality_rules.assess(docs_of([])).collect() == []


def test_rules_keep_clean_documents_and_drop_junk(docs_of):
    # Repeated sentences would fail by the base's own rule on repeated windows, so each one has words of its own.
    clean = "\n".join(" ".join(f"word{k}x{n}" for n in range(14)) + f", and it ends. Another{k} one{k} follows{k}." for k in range(6))
    menu = "\n".join("Home | Shop | About | Contact | Help | Login" for _ in range(12))
    shout = " ".join(f"BUY{k}!! NOW{k}!!" for k in range(60))
    kept = {r.doc_id: r.kept for r in quality_rules.assess(docs_of([(1, clean), (2, menu), (3, shout), (4, clean + "\nAll rights reserved")])).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: True}


def test_rules_query_against_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{small}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op6_quality_rules"])
    got = queries.op6(spark, small).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_ftrl_equals_a_plain_loop():
    """The updates of every coordinate, one by one, in the same order of rows."""
    import math

    p = toxicity.Params(alpha=0.5, beta=1.0, l1=0.3, l2=0.1, epochs=3, seed=5)
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, 40, 6)), int(rng.random() < 0.4)) for _ in range(60)]
    z, n, bias = {}, {}, "bias"

    def weight(k):
        l1 = 0.0 if k == bias else p.l1
        zk, nk = z.get(k, 0.0), n.get(k, 0.0)
        if abs(zk) <= l1:
            return 0.0
        return -(zk - math.copysign(l1, zk)) / ((p.beta + math.sqrt(nk)) / p.alpha + p.l2)

    order = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for at in order.permutation(len(rows)).tolist():
            x, y = rows[at]
            keys = [*x.tolist(), bias]
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for k in keys:
                nk = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(nk + g * g) - math.sqrt(nk)) / p.alpha * w[k]
                n[k] = nk + g * g
    model = toxicity.fit(rows, p)
    want = {k: weight(k) for k in z if k != bias and weight(k)}
    assert dict(zip(model.index.tolist(), model.weight)) == pytest.approx(want) and model.bias == pytest.approx(weight(bias)) and 0 < len(want) < 40


def test_fit_equals_plain_moments(spark):
    """Means, shrunk covariances, Cholesky factors and offsets from plain numpy over all rows."""
    rng = np.random.default_rng(2)
    d = len(quality_qda.NAMES)
    x = [rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + y for y, n in ((0, 70), (1, 110))]
    rows = [(v.tolist(), y) for y in (0, 1) for v in x[y]]
    model = quality_qda.fit(spark.createDataFrame(rows, "x array<double>, y int").repartition(3), shrink=0.2, ridge=0.01)
    cov = [np.cov(v, rowvar=False, bias=True) for v in x]
    pooled = (70 * cov[0] + 110 * cov[1]) / 180
    for y, n in ((0, 70), (1, 110)):
        w = 0.2 + 0.8 * d / (d + n)
        shrunk = (1 - w) * cov[y] + w * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled))) + 0.01 * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        assert np.allclose(model.mean[y], x[y].mean(axis=0)) and np.allclose(model.inverse[y], np.linalg.inv(factor))
        assert np.isclose(model.offset[y], np.log(n / 180) - np.log(np.diag(factor)).sum())
    assert quality_qda.fit(spark.createDataFrame(rows[:70], "x array<double>, y int")) is None


def test_failed_lines_are_removed(spark):
    """What is left of a text: its lines without the failing and the blank ones."""
    text = "A good line here.\n\nHome | Shop | Cart | Help\nAll rights reserved\nAnother good line, short"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(quality_rules.clean_text(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == ["A good line here.\nAnother good line, short", "", None]


def test_documents_are_judged_in_one_python_step(spark, small):
    """A task of the pipeline's stage has one Python worker, which reads and judges whole rows."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality_qda.keep_good(docs, labels)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    scores = quality_qda.apply(quality_qda.features(docs), quality_qda.train(docs, labels)).filter("predicted = 1")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in scores.collect()) and kept.schema == docs.schema
