import hashlib
import random
import re
import zlib
from itertools import groupby

from pyspark.sql import functions as F
from tessera.llm import conversation, queries
from tessera.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"


def content(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def fault_of(rows):
    out, seen = [], set()
    for role, text in rows:
        trimmed = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not trimmed else "duplicate" if (role, text) in seen else None if trimmed[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """The least (cost, audit) by a table over (row, initials so far), forward, with whole texts: no costs of a rest."""
    states = {"": 0}  # initials are told apart by pattern state only
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def put_in(best):
        for _ in range(4):
            for s, (cost, audit, made) in list(best.items()):
                for i, n in names.items():
                    if i in follow[s]:
                        new = (cost + 3, audit + "I", [*made, (n, "")])
                        t = follow[s][i]
                        if t not in best or new[:2] < best[t][:2]:
                            best[t] = new
        return best

    best = put_in({s: (c, "", []) for s, c in states.items()})
    for (role, text), fault in zip(rows, faults):
        then = {}

        def offer(s, new, then=then):
            if s not in then or new[:2] < then[s][:2]:
                then[s] = new

        for s, (cost, audit, made) in best.items():
            offer(s, (cost + 4, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if role[:1] in follow[s]:
                offer(follow[s][role[:1]], (cost + more, audit + "K", [*made, (role, text)]))
            for i, n in names.items():
                if i in follow[s]:
                    offer(follow[s][i], (cost + 3 + more, audit + "R", [*made, (n, text)]))
        best = put_in(then)
    cost, audit, made = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in made))
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()


def brute(rows, ids):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, content(r[2], r[3]))
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in ids}
    for conv, own in groupby(sorted(rows, key=order), key=lambda r: r[0]):
        own = list(own)
        turns = [t for _, t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        texts = [(r, x) for _, _, r, x in own]
        faults = fault_of(texts)
        bad = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(texts, texts[1:]))
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), bad, *cheapest(texts, faults))
    return out


def as_dict(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def odd_rows():
    pick = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "User", "", None, "ua"]
    texts = ["Yes.", "No!", "So?", "and then", "", " \n", None, "Ünd. ", "ok.\t", "x\ny", ".", "what? no", "Yes."]
    rows = []
    for conv in [*range(120), None]:
        for t in range(pick.choice([0, 1, 2, 3, 5, 8, 13])):
            rows.append((conv, pick.choice([t, t, t + 1, None, 2 * t]), pick.choice(roles[: pick.choice([3, 8])]), pick.choice(texts) if pick.random() < 0.7 else f"text {pick.random()}{pick.choice(['.', ''])}"))
            if pick.random() < 0.1:
                rows += [rows[-1]] * pick.choice([1, 4])
    return rows


def test_repairs_against_whole_search(spark):
    rows = odd_rows()
    # one conversation that holds most rows, over many blocks and partitions
    pick = random.Random(5)
    rows += [(1000, i, pick.choice(["user", "assistant", "system"]), pick.choice(["Yes.", "no", f"t{i}.", f"t{i}", " "])) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"content": F.lit("clash"), "edits": F.lit(1)})
    ids = spark.createDataFrame([(c, None, None, None) for c in [*range(125), None, 1000]], SCHEMA)
    got = as_dict(conversation.repair(df, ids))
    want = brute(rows, [*range(125), None])
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv
    stats, edits = conversation.plan(df)
    assert edits.filter("conv_id = 1000").select("part", "block").distinct().count() > 5
    made = conversation.repaired_rows(df, edits).filter("conv_id = 1000").orderBy("part", "block", "at", "k").collect()
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in made).encode()).hexdigest() == want[1000][7]


def test_blocks_of_every_size_give_the_same_walk():
    pick = random.Random(9)
    for _ in range(300):
        n = pick.randrange(1, 12)
        codes, again = bytes(pick.randrange(9) for _ in range(n)), [pick.choice([0, 0, 0, 2]) for _ in range(n)]
        whole = conversation.walk(codes, again, list(conversation._END), 0, True)[0]
        for size in range(1, n):
            cuts = [(codes[i : i + size], again[i : i + size]) for i in range(0, n, size)]
            after = [list(conversation._END)]
            for c, a in reversed(cuts[1:]):
                after.append(conversation.before_block(conversation.block_matrix(c, a), after[-1]))
            state, texts = 0, []
            for k, (c, a) in enumerate(cuts):
                done, _, state = conversation.walk(c, a, after[len(cuts) - 1 - k], state, k == len(cuts) - 1)
                texts += done
            assert texts == whole


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversation.repair(none, none).collect() == []
    assert as_dict(conversation.repair(none, spark.createDataFrame([(7, 1, "user", "x")], SCHEMA))) == brute([], [7])


def test_registered_query(spark, small):
    rows = [tuple(r) for r in table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(None, 1, None, None), (None, None, "user", "a. b! c?"), (3, None, "assistant", None)]
    given = spark.createDataFrame(rows, SCHEMA)
    left = []
    for c, t, r, x in rows:
        shown = [" " if v is None else str(v) for v in (c, t)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        r, x = (" " if v is None else v for v in (r, x))
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        left += [] if kind == 0 else [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    assert as_dict(conversation.repair(queries.damaged(given), given)) == brute(left, {c for c, *_ in rows})
    got = as_dict(queries.op13(spark, small))
    assert len(got) == len({c for c, *_ in rows[:-3]}) and any(v[6].count("I") for v in got.values()) and any(v[6].count("R") for v in got.values())
