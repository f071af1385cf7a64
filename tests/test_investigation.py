"""Bounded traces against a plain walk, with limits that bind."""

import random

import pytest

from tessera.operators import investigation as I


def walk(seeds, symbols, files, facts, edges, hops, most, most_symbols, near, owners):
    """Hop by hop over lists, for one project."""
    asked = {t: [s for _, s in sorted((p, s) for tt, s, p in symbols if tt == t)][:most_symbols] for t in {t for t, *_ in seeds}}
    ahead = {(a, b) for a, b, k in edges if k != "imported-by" and a != b}
    out = {f: sorted(b for a, b in ahead if a == f)[:near] for f in files}
    back = {f: sorted(a for a, b in ahead if b == f)[:near] for f in files}
    declares = lambda s: sorted({f for f, k, x in facts if x == s and k != "reference"})[: owners + 1]
    has = lambda f: {x for g, _, x in facts if g == f}
    result = {}
    for t, names in asked.items():
        first = sorted({(p, f) for tt, f, p in seeds if tt == t and f in files})
        found, front = {}, []
        for p, f in first:
            if f not in found and len(found) < most:
                found[f] = (0, len(found) + 1, "seed", None, None, [f])
                front.append(f)
        for hop in range(1, hops + 1):
            new = {}
            for f in front:
                place = found[f][1]
                offers = [(2, place, 0, f, None, g) for g in out[f]] + [(3, place, 0, f, None, g) for g in back[f]]
                for at, s in enumerate(names):
                    if s in has(f):
                        pos = next(p for tt, x, p in symbols if tt == t and x == s)
                        offers += [(1, place, pos, f, s, g) for g in [d for d in declares(s) if d != f][:owners] if g in files]
                for o in offers:
                    if o[5] in files and o[5] not in found and (o[5] not in new or (o[:4], o[4] or "") < (new[o[5]][:4], new[o[5]][4] or "")):
                        new[o[5]] = o
            front = []
            for g, o in sorted(new.items(), key=lambda x: (x[1][:3], x[0])):
                if len(found) < most:
                    found[g] = (hop, len(found) + 1, I.WAYS[o[0]], o[4], o[3], [*found[o[3]][5], g])
                    front.append(g)
        result[t] = found
    return result


@pytest.mark.parametrize("limits", [(3, 16, 32, 8, 4), (2, 5, 1, 2, 1), (1, 3, 32, 1, 2)])
def test_traces_against_a_plain_walk(spark, limits):
    pick = random.Random(11)
    files = {f"f{k:02}": pick.choice(["page", "service", "repository", "unknown", None]) for k in range(40)}
    names = list(files)
    edges = [(pick.choice(names), pick.choice(names), pick.choice(["import", "hook-import", "imported-by"])) for _ in range(110)]
    facts = list({(pick.choice(names), pick.choice(["declaration", "state", "reference", "reference"]), f"s{pick.randrange(8)}") for _ in range(90)})
    seeds = [(t, pick.choice([*names, "gone"]), p) for t in range(25) for p in range(pick.choice([1, 2, 6]))]
    symbols = [(t, s, p) for t in range(25) for p, s in enumerate(pick.sample([f"s{k}" for k in range(8)], 3))]
    make = spark.createDataFrame
    nodes, ends = I.trace(
        make([(t, "p", f, p) for t, f, p in seeds], "task_id int, project_id string, file string, pos int"), make(symbols, "task_id int, symbol string, pos int"),
        make([("p", f, r) for f, r in files.items()] + [("q", "f00", "page")], "project_id string, path string, role string"), make([("p", *x) for x in facts] + [("q", "f01", "declaration", "s0")], "project_id string, file string, kind string, symbol string"),
        make([("p", *e) for e in edges] + [("q", "f00", "f01", "import")], "project_id string, src string, dst string, kind string"), *limits,
    )
    rows = nodes.collect()
    got = {}
    for r in rows:
        got.setdefault(r.task_id, {})[r.file] = (r.hop, r.place, r.way, r.symbol, r.parent, r.trail)
    want = walk(seeds, symbols, files, facts, edges, *limits)
    assert got == {t: f for t, f in want.items() if f}
    assert any(len(f) == limits[1] for f in want.values()) and any(r.way == "defines_symbol" for r in rows)
    asked = {t: {s for tt, s, p in symbols if tt == t and p < limits[2]} for t in want}
    for r in rows:
        kinds = {k for f, k, s in facts if f == r.file and s in asked[r.task_id]}
        role = "state-owner" if "state" in kinds else "producer" if "declaration" in kinds else "consumer" if kinds else "candidate"
        owner = role in ("state-owner", "producer")
        assert (r.role, r.strength) == (role, ("strong" if r.way in ("seed", "defines_symbol") else "probable") if owner else "reference" if kinds else "weak")
    layer = {r: n for n, rs in I.LAYERS.items() for r in rs}
    for r in ends.collect():
        seen = {layer.get(files[f]) for f in want[r.task_id]}
        assert (r.n_files, r.stopped, r.layers) == (len(want[r.task_id]), len(want[r.task_id]) >= limits[1], [n for n in I.LAYERS if n not in seen])
