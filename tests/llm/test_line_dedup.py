import hashlib
import os
import random
import re

import numpy as np
from test_simhash import classes

from tessera.llm import line_dedup as L
from tessera.llm.queries import op1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_lines(text):
    """(position, normalised line) of the lines with a word, by plain Python."""
    for p, line in enumerate((text or "").split("\n")):
        line = re.sub(r"[\x00-\x09\x0b-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", line.lower()).strip(" ")
        if line:
            yield p, line


def bigrams(line):
    a = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.bincount((a[:-1] * 31 + a[1:]) % 512, minlength=512)


def similar_pairs(norms):
    """All pairs of lines with an edit similarity of 0.8 or more: lengths and bigram counts only rule out what cannot be."""
    norms = sorted(norms, key=len)
    size = np.array([len(n) for n in norms])
    bags = np.array([bigrams(n) for n in norms])
    for i, a in enumerate(norms):
        if len(a.encode()) < 9:
            continue
        end = int(np.searchsorted(size, len(a) / 0.8 + 1e-9, "right"))
        allowed = (size[i + 1 : end] * 0.2 + 1e-9).astype(int)
        for j in (np.flatnonzero(np.abs(bags[i + 1 : end] - bags[i]).sum(axis=1) <= 4 * allowed) + i + 1).tolist():
            if L.edit_distance(a, norms[j]) <= len(norms[j]) * 0.2 + 1e-9:
                yield a, norms[j]


def brute(rows):
    """The lines of each row and the group of each, from edit similarity of all pairs alone."""
    spots = [(i, t, p, line) for i, t in rows for p, line in plain_lines(t)]
    norms = sorted({s[3] for s in spots})
    at = {n: k for k, n in enumerate(norms)}
    return spots, dict(zip(norms, classes(len(norms), [(at[a], at[b]) for a, b in similar_pairs(norms)])))


def kept_by_class(rows, out):
    """Each class must keep exactly one line, in the document that orders first."""
    spots, own = brute(rows)
    first = {}
    for i, _, _, n in spots:
        c = own[n]
        first[c] = min(first.get(c, (1, 0)), (0 if i is None else 1, i or 0)) if c in first else (0 if i is None else 1, i or 0)
    left = {}
    for r in {(r.doc_id, r.text) for r in out}:
        for line in (r[1] or "").split("\n"):
            for _, norm in plain_lines(line):
                left.setdefault(own[norm], []).append((0 if r[0] is None else 1, r[0] or 0))
    assert set(left) == set(first)
    for c, docs in left.items():
        assert docs == [first[c]], (c, docs, first[c])


WORDS = [f"{a}{b}" for a in ("al", "be", "cor", "dun", "eft") for b in ("ion", "er", "ly", "ed", "ous", "ing")]


def sample(seed, n):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(12, 90))) for _ in range(30)]
    rows = []
    for k in range(n):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(base).split(" ")
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(WORDS)
            lines.append(rng.choice(["{}.", "{}", "  {}!"]).format(" ".join(line).capitalize()))
        lines.insert(rng.randrange(len(lines) + 1), rng.choice(["Of.", "", "And so on"]))
        rows.append((k, "\n".join(lines)))
    return rows


def test_against_all_pairs(docs_of):
    rows = sample(1, 80)
    out = L.dedup_lines(docs_of(rows)).collect()
    kept_by_class(rows, out)
    before = dict(rows)
    for r in out:
        lines = before[r.doc_id].split("\n")
        assert r.n_lines == len(lines) and len((r.text or "").split("\n")) in (r.n_lines - r.n_removed, 1)
        rest = [x for x in lines if not list(plain_lines(x))]
        assert [x for x in r.text.split("\n") if not list(plain_lines(x)) and (x or rest)] == rest or r.n_removed == r.n_lines


def test_edit_distance():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé😀 ") for _ in range(rng.randrange(0, 40))) for _ in "12")
        assert L.edit_distance(a, b) == distance(a, b)
    assert L.similar_pairs(["x" * 100_000, "ab" * 30_000], ["x" * 100_000 + "y", "cd" * 30_000]) == [True, False]


def test_refused_candidates_do_not_cut_groups(docs_of):
    """The same words in another order share n-grams but are no near copies."""
    one = "alpha beta gamma delta epsilon zeta eta theta iota"
    two = " ".join(reversed(one.split(" ")))
    rows = [(1, one), (2, two), (3, one + "s"), (4, two.replace("iota", "iotas")), (5, one), (6, two)]
    out = {r.doc_id: r.text for r in L.dedup_lines(docs_of(rows)).collect()}
    kept_by_class(rows, L.dedup_lines(docs_of(rows)).collect())
    assert out[1] == one and out[2] == two and out[5] == "" and out[6] == ""


def test_edge_cases(docs_of):
    line = "this line stands in many documents of all"
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(2, line + "\nOf."), (1, line), (1, line), (None, None), (3, ""), (4, f"{line}\n{line}"), (5, long), (6, long + " tail"), (7, "\n\n")]
    df = docs_of(rows)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in L.dedup_lines(df).collect()), key=str)
    want = [(2, "Of.", 2, 1), (1, line, 1, 0), (1, line, 1, 0), (None, None, 0, 0), (3, "", 1, 0), (4, "", 2, 2), (5, long, 1, 0), (7, "\n\n", 3, 0)]
    assert [g for g in got if g[0] != 6] == sorted(want, key=str)
    assert L.dedup_lines(df).columns == [*df.columns, "n_lines", "n_removed"]
    assert L.dedup_lines(docs_of([])).collect() == []


def test_registered_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    out = L.dedup_lines(spark.read.parquet(f"{small}/documents.parquet")).collect()
    text = {r.doc_id: r.text for r in out}
    for r in op1(spark, small).collect():
        assert hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest() == r.text_sha256
    exact = {}
    for i, t in sorted(rows):
        for line in t.split("\n"):
            for _, norm in plain_lines(line):
                exact.setdefault(norm, i)
    for i, t in text.items():
        for line in t.split("\n"):
            assert all(exact[norm] == i for _, norm in plain_lines(line))


def near_copies(seed, share, unit):
    """Lines of all lengths and a copy of each with ``share`` of its words or characters replaced."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("etaoinsrhldcu") for _ in range(rng.randrange(2, 10))) for _ in range(2000)]
    out = []
    while len(out) < 300:
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 70))]
        parts, stock = (list(words), vocab) if unit == "words" else (list(" ".join(words)), "etaoinsrh")
        for p in rng.sample(range(len(parts)), max(1, int(len(parts) * share))):
            parts[p] = rng.choice(stock)
        one, two = " ".join(words), (" " if unit == "words" else "").join(parts)
        if one != two and L.edit_distance(one, two) <= max(len(one), len(two)) * 0.2:
            out.append((one, two))
    return out


def test_recall_of_edit_similarity(docs_of):
    """Of pairs that edit similarity alone accepts nearly all are found, however many words differ."""
    cases = [(0, "words", 0.98), (0.1, "words", 0.95), (0.2, "words", 0.65), (0.05, "chars", 0.85)]
    pairs = [(k, p) for k, (share, unit, _) in enumerate(cases) for p in near_copies(k, share, unit)]
    rows = [(2 * i + j, line) for i, (_, pair) in enumerate(pairs) for j, line in enumerate(pair)]
    gone = {r.doc_id for r in L.dedup_lines(docs_of(rows)).filter("n_removed > 0").collect()}
    assert gone <= {2 * i + 1 for i in range(len(pairs))}
    found = [[2 * i + 1 in gone for i, (c, _) in enumerate(pairs) if c == k] for k in range(len(cases))]
    recall = [sum(f) / len(f) for f in found]
    assert all(r >= least for r, (_, _, least) in zip(recall, cases)), recall
    print(recall)


def test_short_lines_and_lines_without_spaces(docs_of):
    """Equal lines of any length go, and long ones without spaces also as near copies; blank lines stay."""
    han = "春眠不觉晓处处闻啼鸟夜来风雨声花落知多少床前明月光疑是地上霜"
    rows = [(1, f"Read more\n{han}\n\nOk"), (2, f"read more!\n{han}"), (3, f"{han[:-1]}雪\n---\n\nread less\nOK."), (4, "---\n\nok then")]
    out = {r.doc_id: (r.text, r.n_removed) for r in L.dedup_lines(docs_of(rows)).collect()}
    assert out == {1: (rows[0][1], 0), 2: ("", 2), 3: ("---\n\nread less", 2), 4: (rows[3][1], 0)}


def test_bounds_agree_with_the_distance():
    """Pairs that a bound decides are decided as the distance does."""
    rng = random.Random(5)
    a, b = [], []
    for _ in range(600):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(1, 40))]
        other = list(words)
        for _ in range(rng.randrange(0, 8)):
            p = rng.randrange(len(other))
            other[p : p + rng.randrange(0, 3)] = [rng.choice([*WORDS, "é漢😀"]) for _ in range(rng.randrange(0, 3))] or ["x"]
        a.append(" ".join(words)), b.append(" ".join(other))
    want = [distance(x, y) <= int(max(len(x), len(y)) * 0.2 + 1e-9) for x, y in zip(a, b)]
    assert L.similar_pairs(a, b) == want and 100 < sum(want) < 500


def test_recall_against_all_pairs_of_a_table(spark, docs_of):
    """Whole tables, edit similarity alone, by length in words; TESSERA_SLOW takes sf0.01, some twelve minutes."""
    folder = "/root/testdata/sf0.01" if os.environ.get("TESSERA_SLOW") else "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    norms = sorted({n for t in texts for _, n in plain_lines(t)})
    pairs = list(similar_pairs(norms))
    lines = L.lines_of(docs_of(list(enumerate(norms))))
    hashes = {r.line: r.nh for r in lines.collect()}
    own = {r.nh: r["class"] for r in L.line_classes(lines).collect()}
    by = {}
    for a, b in pairs:
        words = max(a.count(" "), b.count(" ")) + 1
        by.setdefault(next(x for x in (10, 20, 50, 100, 10**9) if words < x), []).append(own.get(hashes[a], 0) == own.get(hashes[b], 1))
    print({k: (sum(v), len(v)) for k, v in sorted(by.items())})
    assert sum(map(sum, by.values())) >= 0.9 * len(pairs)
    assert all(sum(v) >= 0.85 * len(v) for v in by.values())


def test_every_similar_pair_of_a_key_is_linked(spark, monkeypatch):
    """All lines under one key: classes are those of all pairs, whichever line is the smallest."""
    rng = random.Random(4)
    bases = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(90)) for _ in range(8)) for _ in range(12)]
    norms = sorted({b[:k] + "x" * n + b[k:] for b in bases for k, n in ((0, 0), (5, 4), (20, 9), (30, 14))})
    rows = [(i, x) for i, x in enumerate(norms)]
    lines = spark.createDataFrame(rows, "nh long, line string")
    monkeypatch.setattr(L, "bands_of", lambda df: df.selectExpr("7L AS key", "nh").union(df.selectExpr("nh % 3", "nh")))
    got = {r.nh: r["class"] for r in L.line_classes(lines).collect()}
    root = list(range(len(norms)))
    for j in range(len(norms)):
        for i in range(j):
            if root[i] != root[j] and L.similar_pairs([norms[i]], [norms[j]])[0]:
                root = [root[i] if r == root[j] else r for r in root]
    want = {}
    for i, r in enumerate(root):
        want.setdefault(r, []).append(i)
    assert {i: c for i, c in got.items()} == {i: min(w) for w in want.values() if len(w) > 1 for i in w}


def test_distances_side_by_side_agree_with_the_distance():
    """Pairs of all lengths, signs and distances, many at once."""
    rng = random.Random(11)
    a, b = [], []
    for k in range(700):
        one = "".join(rng.choice("abcdé漢😀 ") for _ in range(rng.choice([9, 63, 64, 65, 128, 130, 200])))
        two = list(one)
        for _ in range(rng.randrange(0, max(2, len(one) // 3))):
            p = rng.randrange(len(two))
            two[p : p + rng.randrange(0, 2)] = [rng.choice("abcdé漢x")] * rng.randrange(0, 2) or ["y"]
        a.append(one), b.append("".join(two) if k % 9 else one[40:] + "".join(two)[:40] + "z")
    want = [distance(x, y) for x, y in zip(a, b)]
    for share in (0.1, 0.2, 0.4):
        allowed = np.array([int(max(len(x), len(y)) * share) for x, y in zip(a, b)])
        long, short = [max(x, y, key=len) for x, y in zip(a, b)], [min(y, x, key=len) for x, y in zip(a, b)]
        assert L.within(long, short, allowed).tolist() == [d <= k for d, k in zip(want, allowed.tolist())]
    assert L.similar_pairs(a, b) == [d <= int(max(len(x), len(y)) * 0.2 + 1e-9) for d, x, y in zip(want, a, b)]


def test_only_similar_lines_of_a_key_leave_its_task(spark, monkeypatch):
    """Lines that share a passage, and with it a key, are compared in place, also where a key is dealt over tasks."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    passage = " ".join(word() for _ in range(8))
    norms = [" ".join([*(word() for _ in range(9)), passage]) for _ in range(60)]
    norms += [norms[7] + " x", norms[31] + " yy"]
    want = [(7, 60), (31, 61)]
    monkeypatch.setattr(L, "PAIRS", 50)
    for blocks, pivot in ((1, 0), (3, 0), (3, 50)):
        rows = [(k, 10 if i < 20 and i != 7 else i, i, n, [9, 7], 10, pivot, blocks) for i, n in enumerate(norms) for k in (7, 9)]
        members = spark.createDataFrame(rows, "key long, class long, nh long, line string, keys array<long>, main long, pivot long, blocks long")
        assert sorted(tuple(r) for r in L.crossing(members).collect()) == want


def test_keys_without_lines_to_compare_are_left_out(spark):
    """Lines that only the smallest line of their key could meet have met it; lines of two other classes meet."""
    keys = {1: "AB", 2: "AA", 3: "ABB", 4: "AAB", 5: "ABC", 6: "ABBCC"}
    classes = spark.createDataFrame([(k, 100 * k + i, ord(c)) for k, own in keys.items() for i, c in enumerate(own)], "key long, nh long, class long")
    got = {(r.key, r.main, r.pivot, r.blocks) for r in L.mixed_keys(classes).collect()}
    assert got == {(4, ord("A"), 400, 1), (5, ord("C"), 500, 1), (6, ord("C"), 600, 1)}
    assert L.mixed_keys(classes).count() == 11 and L.mixed_keys(classes.limit(0)).count() == 0


def test_pairs_of_many_keys_meet_once(monkeypatch):
    """Of all keys at once: each pair of different classes once, without the smallest line, within the lengths, and under
    its smallest key only."""
    rng = random.Random(3)
    size = {i: rng.randrange(20, 60) for i in range(40)}
    kind = {i: rng.choice([90, 91, i]) for i in range(40)}
    held = {k: sorted(rng.sample(range(40), rng.randrange(2, 14))) for k in range(12)}
    main = {k: max({kind[i] for i in own}, key=lambda c, own=own: (sum(kind[i] == c for i in own), c)) for k, own in held.items()}
    pivot = {k: own[0] for k, own in held.items()}
    rows = [(k, 0, kind[i], i, 0, main[k], pivot[k], [x for x in held if i in held[x]]) for k, own in held.items() for i in own]
    table = L.pa.table(dict(zip(("key", "part", "class", "nh", "block", "main", "pivot", "keys"), map(list, zip(*rows)))))
    want = []
    for k, own in held.items():
        for i in own[1:]:
            for j in own[1:]:
                first = min(x for x in held if i in held[x] and j in held[x])
                if i < j and kind[i] != kind[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) and first == k:
                    want.append((i, j))
    for n in (1 << 15, 7):
        monkeypatch.setattr(L, "PAIRS", n)
        met = [(a, b) for x in L._meetings(table, np.array([size[r[3]] for r in rows])) for a, b in zip(*x)]
        got = sorted(tuple(sorted((rows[a][3], rows[b][3]))) for a, b in met)
        assert got == sorted(want) and len(want) > 20


def test_a_distance_beyond_the_bound_ends_early():
    rng = random.Random(21)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(0, 40))) for _ in "12")
        for most in (0, 3, 9, 20):
            got, want = L.edit_distance(a, b, most), distance(a, b)
            assert got == want if want <= most else most < got <= want


def test_keys_are_dealt_out_in_few_rows_and_found_as_before(spark):
    """A task gives a row for each part, not one for each key of each line; what lines share is the same."""
    rng = random.Random(31)
    bases = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20)) for _ in range(40)]
    lines = spark.createDataFrame([(i, bases[i % 40][: 60 + i // 4]) for i in range(160)], "nh long, line string").coalesce(1)
    dealt = L.bands_of(lines)
    assert dealt.count() <= L.PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")) < 16 * 160
    plain = []
    for r in dealt.collect():
        key, nh = np.frombuffer(r.bands, np.int64).reshape(2, -1).tolist()
        plain += zip(key, nh)
    held = {}
    for key, nh in set(plain):
        held.setdefault(key, set()).add(nh)
    want = sorted((key, nh, min(own)) for key, own in held.items() if len(own) > 1 for nh in own)
    rows = spark.createDataFrame(plain, "key long, nh long")
    assert len(want) > 160 and sorted(map(tuple, L.shared_keys(dealt).collect())) == want == sorted(map(tuple, L.shared_keys(rows).collect()))


def test_pairs_of_one_line_share_its_table(monkeypatch):
    """Two thousand pairs of one line are compared at once, and no word is worked on that no way of so few edits touches."""
    rng = random.Random(32)
    one = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1000))
    other = [one[:p] + "".join(rng.choice("abcdef") for _ in range(n)) + one[p + n :] for p, n in ((rng.randrange(500), rng.randrange(80, 400)) for _ in range(2000))]
    calls, within = [], L.within
    monkeypatch.setattr(L, "within", lambda a, b, allowed: calls.append(len(a)) or within(a, b, allowed))
    got = L.similar_pairs([one] * 2000, other)
    assert calls == [2000] and got[:20] == [distance(one, x) <= 200 for x in other[:20]] and len(set(got)) == 2


def test_likely_pairs_are_decided_as_others():
    rng = random.Random(33)
    words = [["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(5, 150))] for _ in range(200)]
    other = [[w if rng.random() > k % 9 * 0.06 else "xyz" for w in x] for k, x in enumerate(words)]
    a, b = [" ".join(x) for x in words], [" ".join(x) for x in other]
    assert L.similar_pairs(a, b, likely=True) == L.similar_pairs(a, b) and L.similar_pairs([], [], likely=True) == []


def test_steps_that_nothing_reads_any_more_are_deleted(spark, docs_of):
    """Keys, candidate texts and pairs go when the classes are known."""
    made, kept = [], L.materialize
    lines = L.lines_of(docs_of([(i, f"one line that all share {i}\nand another one {'x' * i}") for i in range(9)]))
    try:
        L.materialize = lambda df, tag: made.append((tag, kept(df, tag))) or made[-1][1]
        classes = L.line_classes(lines).count()
    finally:
        L.materialize = kept
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    left = {x.split("-")[1] for x in os.listdir(folder) if x.rsplit("-", 1)[0] in {t for t, _ in made} and any(x in df.inputFiles()[0] for t, df in made)}
    assert classes > 9 and left == {"first"} and {t for t, _ in made} == {"lines-keys", "lines-text", "lines-pairs", "lines-first"}
