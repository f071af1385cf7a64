"""Locks of cases and projects, and seeds kept in a selection, against plain Python."""

import random

import pytest

from tessera.operators import locks as L
from tessera.operators.retention import retain_seeds


def test_locks_name_what_changed_and_refuse(spark):
    make = lambda cases, files: L.items(spark.createDataFrame(cases, "split string, case_id long, score long, note string"), spark.createDataFrame(files, "project_id string, path string, content string"), ["score", "note"])
    cases = [("a", k, k, None if k % 3 else "x") for k in range(40)] + [(None, None, None, None)]
    files = [("p", f"f{k}", f"text {k}") for k in range(60)] + [("q", "f1", None), ("q", "f1", None), ("r", "g", "")]
    then = make(cases, files)
    assert {(r.scope, r.name): r.verified for r in L.verify(L.buckets(then), L.buckets(make(cases[::-1], files[::-1]))).collect()} == {("cases", "a"): True, ("cases", ""): True, ("project", "p"): True, ("project", "q"): True, ("project", "r"): True}
    moved = [f for f in files if f[1] != "f7"] + [("p", "new", "n")]
    moved = [(p, f, "other" if f == "f9" else c) for p, f, c in moved][:-4] + [("q", "f1", None), ("p", "new", "n"), ("s", "g", "")]
    now = make(cases, moved)
    b_then, b_now = L.buckets(then), L.buckets(now)
    assert {(r.scope, r.name, r.item, r.change) for r in L.changes(then, now, b_then, b_now).collect()} == {
        ("project", "p", "f7", "removed"), ("project", "p", "f9", "changed"), ("project", "p", "new", "added"), ("project", "q", "f1", "changed"), ("project", "r", "g", "removed"), ("project", "s", "g", "added"),
    }
    state = {r.name: (r.verified, r.n_then, r.n_now) for r in L.verify(b_then, b_now).filter("scope = 'project'").collect()}
    assert state == {"p": (False, 60, 60), "q": (False, 1, 1), "r": (False, 1, 0), "s": (False, 0, 1)}
    assert all(r.verified for r in L.verify(L.migrate(b_then, b_now), b_now).collect())
    other = L.buckets(make([("a", 0, 1, "x"), *cases[1:]], files))
    with pytest.raises(ValueError, match="sealed cases"):
        L.migrate(b_then, other)


def plain(selected, seeds, near, limit, most):
    held, done = [(p, not e and not c) for _, p, e, c in sorted(selected)], []
    for _, path, _, grounded in sorted(s for s in seeds if s[2])[:most]:
        names = [p for p, _ in held]
        if path in names:
            continue
        if not grounded:
            done.append((path, "ungrounded"))
        elif not set(names) & near.get(path, set()):
            done.append((path, "unrelated"))
        else:
            if len(held) >= limit:
                loose = next((i for i, (_, x) in enumerate(held) if x), None)
                if loose is not None:
                    held.pop(loose)
            if len(held) >= limit:
                done.append((path, "full"))
            else:
                held.insert(0, (path, False))
                done.append((path, "retained"))
    return [p for p, _ in held], done


@pytest.mark.parametrize("limit,near", [(3, 20), (2, 1), (9, 2)])
def test_seeds_against_a_plain_loop(spark, limit, near):
    pick = random.Random(6)
    names = [f"f{k}" for k in range(14)]
    edges = {(pick.choice(names), pick.choice(names)) for _ in range(30)}
    around = {}
    for f in names:
        out, back = {b for a, b in edges if a == f and b != f}, {a for a, b in edges if b == f and a != f}
        around[f] = set([g for _, g in sorted([(0, g) for g in out] + [(1, g) for g in back - out])][:near])
    selected = {t: [(k, f, pick.random() < 0.5, pick.choice([True, False, None])) for k, f in enumerate(pick.sample(names, pick.randrange(4)))] for t in range(60)}
    seeds = {t: [(k, f, pick.random() < 0.8, pick.random() < 0.8) for k, f in enumerate(pick.sample(names, pick.randrange(6)))] for t in range(60)}
    rows = lambda d: [(t, "p", f, k, a, b) for t, own in d.items() for k, f, a, b in own]
    schema = "task_id int, project_id string, path string, pos int, editable boolean, {} boolean"
    selection, decisions = retain_seeds(
        spark.createDataFrame(rows(selected), schema.format("confirmed")).repartition(3), spark.createDataFrame(rows(seeds), schema.format("grounded")).repartition(3),
        spark.createDataFrame([("p", a, b, "import") for a, b in edges] + [("p", b, a, "imported-by") for a, b in edges], "project_id string, src string, dst string, kind string"), limit, near=near,
    )
    got, why = {}, {}
    for r in selection.orderBy("task_id", "pos").collect():
        got.setdefault(r.task_id, []).append(r.path)
    for r in decisions.collect():
        why.setdefault(r.task_id, set()).add((r.path, r.outcome))
    for t in range(60):
        held, done = plain(selected[t], seeds[t], around, limit, 3)
        assert (got.get(t, []), why.get(t, set())) == (held, set(done))
    assert {o for s in why.values() for _, o in s} >= {"retained", "ungrounded", "unrelated"} and (limit == 9 or any(o == "full" for s in why.values() for _, o in s))
