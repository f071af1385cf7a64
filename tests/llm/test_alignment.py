import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tessera.llm import alignment, queries
from tessera.llm.common import table
from tokenizers import Tokenizer

PATHS = [*(public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model")), public_tokenizers.PATTERN]


def byte_of():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(rows):
    """By every pair of tokens of every text and their byte ranges."""
    a_of, b_of = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_of.encode_special_tokens = True
    table = byte_of()

    def spans(ids, text_of):
        out, at = [], 0
        for i in ids:
            t = text_of(i)
            out.append((i, at, at + len(t), t))
            at += len(t)
        return out

    piece = lambda i: bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode()
    texts, count = [], Counter()
    for doc_id, text in rows:
        a = spans(a_of.encode(" " + (text or ""), add_special_tokens=False).ids, lambda i: bytes(table[c] for c in a_of.id_to_token(i)))
        b = spans(b_of.encode(text or ""), piece)
        raw = (" " + (text or "")).encode()
        if not text or any(b"".join(x[3] for x in s) != raw for s in (a, b)):
            texts.append((doc_id, [], [], [], []))
            continue
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        count.update(set(links))
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        texts.append((doc_id, a, b, links, cuts))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, a, b, links, cuts in texts:
        groups = []
        for low, high in zip([0, *cuts], cuts):
            inside = lambda side, low=low, high=high: ",".join(str(x[0]) for x in side if low < x[2] <= high)
            groups.append(f"{inside(a)}|{inside(b)}")
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha))
    return out, count


ODD = [
    None, "", " ", "  two  spaces ", "the the the cat", "<|endoftext|> <s> </s> <unk>", "a▁b", "naïve Übung 中文字 😀😀", "\n\n\ttab\r\n", "\x00\x01", "ﬁ ligature ½", "é combining",
    "aaaaaaaaaaaaaaaaaaaaaaa", "!!!???...", "same text here", "same text here", "don't won't I'll", "1234567890" * 30, "　wide", "x" * 3000 + " end",
]


def key(r):
    return str(tuple(r))


def test_odd_texts_against_all_pairs(spark, docs_of):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(ODD)] + [(3, "the cat sat. the cat sat.")] * 3
    want, count = brute(rows)
    for size in (alignment.SLICE, 1):
        for parts in (1, 5):
            whole, pairs, partners = alignment.align(docs_of(rows).repartition(parts), *PATHS, slice_chars=size)
            assert whole.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            assert sorted(map(key, whole.collect())) == sorted(map(key, want))
    found = {(r.a, r.b): r.n for r in pairs.unionByName(partners).collect()}
    assert found == dict(count)
    assert any(r[1] for r in want) and any(r[7] == "" for r in want)


def test_several_tasks_for_a_bucket(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(ODD)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 3 * alignment.BUCKETS)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", 8)
        got = alignment.align(docs_of(rows), *PATHS)[0].collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    assert sorted(map(key, got)) == sorted(map(key, brute(rows)[0]))


def test_an_empty_table(docs_of):
    assert [df.collect() for df in alignment.align(docs_of([]), *PATHS)] == [[], [], []]


def test_registered_query(spark, small):
    docs = table(spark, small, "documents").filter(F.length("text") < 3000)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(key, alignment.align(docs, *PATHS)[0].collect())) == sorted(map(key, brute(rows)[0]))
    got = queries.op12(spark, small)
    assert got.count() == table(spark, small, "documents").count()
