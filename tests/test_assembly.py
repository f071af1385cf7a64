"""Assembled contexts against a plain search that follows the rules one file at a time."""

import random
import re

import pytest

from tessera.operators import assembly as A

ROLES = {
    "page": "source", "component": "source", "ui-component": "source", "layout": "source", "style": "style", "hook": "source", "client-api": "source", "app-entry": "source", "api-route": "source",
    "service": "source", "repository": "source", "db-schema": "source", "store": "source", "types": "source", "utility": "source", "server-entry": "source", "test": "test", "docs": "docs", "config": "config",
}
TASKS = [
    ("ui", "Restyle the order form and its input field", False), ("ui", "Show a loading state in the header menu", False), ("backend", "Add an endpoint to query orders in the database", False),
    ("backend", "Check the token of a session", False), ("backend", "Change the payload types", False), ("fullstack", "Add a route and a page for orders with schema", False), ("fullstack", "Session token for shop", False),
    ("tests", "Write tests of orderForm", False), ("docs", "Describe the input formula in the readme", False), ("docs", "Update docs", False), ("build", "Tune the vite build config", False), ("bugfix", "Fix the mobile style of the form field", False),
    ("refactor", "Move and split the shopHelper", False), ("general", "Something about shop", False), ("ui", "Review the page", True), ("fullstack", "Review orders", True), ("general", None, None),
]
LIMITS = {"ui": 6, "backend": 7, "fullstack": 10, "docs": 8, "tests": 8, "build": 6, "bugfix": 6, "refactor": 8}
STRONG = {k: v for k, v in A.EDGE_POINTS.items() if k != "imported-by"}


def asks(text):
    said = " " + re.sub(r"[^a-z0-9]+", " ", (text or "").lower()) + " "
    return {s for s, words in A.SIGNALS.items() for w in words if "*" not in w and f" {w} " in said}


def folder(path):
    return path.rsplit("/", 1)[0] if "/" in path else ""


def space(path):
    parts = path.lower().split("/")
    if "src" in parts[1:]:
        return "/".join(parts[: len(parts) - 1 - parts[::-1].index("src")])
    return "/".join(parts[:2]) if parts[0] in ("apps", "packages") and len(parts) > 1 else parts[0] if len(parts) > 1 else ""


def words(path):
    stem = re.sub(r"([^.])\.[^.]*$", r"\1", path.split("/")[-1])
    return [w for w in re.split("[^a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", stem).lower()) if len(w) >= 4 and w not in A.PLAIN_PARTS]


def plain(area, text, review, files, edges):
    """[(path, part, pos)] of one task: files are dicts of a window's columns, edges {(src, dst): kinds}."""
    sig, said, limit, review = asks(text), (text or "").lower(), LIMITS.get(area, 12), bool(review)
    from_role = lambda f, *r: f["role"] in r
    src = lambda f: f["kind"] in ("source", "style", "test")
    front, back = (lambda f: src(f) and f["role"] in A.FRONTEND), (lambda f: src(f) and f["role"] in A.BACKEND)
    test, docs, conf = (lambda f: f["role"] == "test"), (lambda f: f["role"] == "docs"), (lambda f: f["role"] == "config")
    for f in files:
        f["name"], f["words"] = f["path"].split("/")[-1].lower(), words(f["path"])
        hits = [said.index(w) for w in f["words"] if w in said]
        f["mention"] = max(4000, 30000 - 100 * min(hits)) if hits else 0
        f["domain"] = 18000 + min(8000, 500 * max(len(w) for w in f["words"] if w in said)) if hits else 0
        bare = re.sub("[^a-z0-9]", "", re.sub(r"([^.])\.[^.]*$", r"\1", f["name"]))
        f["symbol"] = (55000 if len(bare) >= 9 else 28000) if f["symbol_hits"] else 0
        f["meant"] = any(s in sig and f["role"] in r for s, r in A.SERVES.items())
        f["met"], f["depth"] = f["filename_hits"] > 0 or f["overlap"] > 0, len(f["path"].split("/"))
        f["known"] = bool(f["explicit"] or f["met"] or f["meant"] or f["symbol"])
        f["lock"], f["builder"] = f["name"].endswith(("lock", "lockb")) or f["name"] in ("package-lock.json", "pnpm-lock.yaml"), f["name"].startswith(tuple(A.BUILD_NAMES))
        if review:
            primary = False
        elif conf(f):
            primary = area == "build"
        elif area in ("docs", "tests"):
            primary = docs(f) if area == "docs" else test(f)
        else:
            shut = {"backend": ("page", "component", "ui-component", "style", "client-api"), "ui": ("api-route", "service", "repository", "db-schema", "server-entry"), "fullstack": ("style",)}.get(area, ())
            primary = f["role"] not in shut and f["role"] != "layout"
        f["primary"] = primary
        fit = 0
        if area == "ui":
            fit = 5000 if f["role"] in A.FRONTEND else 2500 if from_role(f, "types", "utility") else -2000
        elif area == "backend":
            fit = 5000 if f["role"] in A.BACKEND else -2500 if f["role"] in A.FRONTEND else 0
        elif area == "fullstack":
            fit = 4500 if f["role"] in A.BACKEND + A.FRONTEND else 0
        elif area == "tests":
            fit = 6000 if test(f) else 2000
        elif area == "docs":
            fit = 6000 if docs(f) else 3500 if conf(f) else 1000
        elif area == "build":
            fit = 6000 if conf(f) else 2500 if f["kind"] == "source" else 0
        elif area in ("bugfix", "refactor"):
            fit = 4000 if f["kind"] == "source" else 0
        p = 1_000_000 * f["explicit"] + 30_000 * f["filename_hits"] + 12_000 * f["overlap"] + 18_000 * f["meant"] + 8_000 * primary + f["mention"] + f["symbol"] + fit + f["score"]
        p -= 4_000 * (not f["explicit"] and not f["met"]) + 8_000 * (f["role"] == "page" and not f["met"])
        if area in ("bugfix", "refactor"):
            p += 14_000 * (f["role"] == "utility") - 42_000 * (f["role"] == "types" and "types" not in sig and not f["explicit"]) - 14_000 * (f["role"] == "app-entry" and not f["filename_hits"] and not f["explicit"])
        if area == "build" and conf(f):
            p += 25_000 + 18_000 * f["builder"] - 30_000 * f["lock"] + (0 if f["name"] != "package.json" else 12_000 if f["depth"] <= 2 else 5_000)
        f["priority"] = p
    order = sorted(files, key=lambda f: (-f["priority"], -f["score"], f["path"]))
    if area == "build":
        fit = lambda f: conf(f) or from_role(f, "app-entry", "server-entry", "layout")
    else:
        fit = {"ui": front, "backend": back, "fullstack": lambda f: front(f) or back(f), "tests": test, "docs": docs}.get(area, src)
    strong = [f for f in order if f["known"] and fit(f)]
    sure = lambda f: f["explicit"] or f["filename_hits"] >= 2 or f["overlap"] >= 2
    exact = lambda f: f["explicit"] or f["met"] or f["mention"]
    entry = lambda f: f["role"] in A.ENTRY
    if review:
        anchors = strong[:3]
    elif area == "tests":
        anchors = strong[: max(1, min(2, sum(f["explicit"] for f in strong)))]
    elif area == "fullstack":
        behind, ahead = [f for f in strong if back(f)], [f for f in strong if front(f)]
        gates = [f for f in behind if entry(f)]
        pool = [f for f in gates if exact(f)] or [f for f in gates if f["role"] == "server-entry"] or gates or behind
        faces = [f for f in ahead if sure(f) or f["symbol"]] or ahead
        anchors = pool[:1] + faces[:1]
        anchors += [f for f in ahead if f not in anchors and f["primary"] and sure(f)][:1]
    elif area == "backend":
        own = [f for f in strong if "types" in sig or f["role"] != "types"]
        gates = [f for f in own if entry(f)] if "endpoint" in sig else []
        anchors = ([f for f in gates if exact(f)] or gates or own)[:1]
    elif area == "build":
        topic = [f for f in strong if conf(f) and (f["mention"] or (f["name"] == "package.json" and f["depth"] <= 2 and "config" in sig))]
        anchors = topic[:3] or [f for f in strong if conf(f)][:1] or [f for f in order if f["known"] and f["kind"] == "source"][:1]
    elif area in ("bugfix", "refactor"):
        anchors = [f for f in strong if f["kind"] == "source" and f["role"] != "types"][: 2 if "relocation" in sig else 1]
    else:
        anchors = strong[:1]
    if not anchors:
        return []
    spots = [a["path"] for a in anchors]
    shown, server = bool(sig & {"appearance", "responsive"}), area in ("backend", "fullstack")
    control = lambda f: from_role(f, "component", "ui-component") and any(c in f["name"] for c in A.CONTROLS)
    for f in files:
        f["relation"] = max([A.EDGE_POINTS[k] for a in spots for k in edges.get((a, f["path"]), ())] or [0]) if f["path"] not in spots else max([A.EDGE_POINTS[k] for a in spots if a != f["path"] for k in edges.get((a, f["path"]), ())] or [0])
        f["near"] = any((f["path"], a) in edges for a in spots if a != f["path"])
        theirs = [w for a in spots for w in words(a)]
        f["affinity"] = 7000 if set(f["words"]) & set(theirs) else 4500 if any(p.startswith(q) or q.startswith(p) for p in f["words"] for q in theirs) else 0
        low = f["path"].lower()
        f["home"] = folder(low) != "" and folder(low) in [folder(a.lower()) for a in spots]
        f["space"] = space(low) != "" and space(low) in [space(a) for a in spots]
        shared = 0
        for a in spots:
            n, left, right = 0, low.split("/"), a.lower().split("/")
            while n < min(len(left), len(right)) and left[n] == right[n]:
                n += 1
            shared = max(shared, n)
        f["nearby"] = max(3000 * f["home"], 1500 * f["space"], 250 * shared)
        r = f["role"]
        bonus = 2500 * (r in A.LOGIC) + (r in A.PERSISTENCE) * (4000 if "storage" in sig else 1200) + (r == "types") * (3500 if "types" in sig else 1800) + (r == "client-api") * (3500 if area in ("ui", "fullstack") else 500)
        bonus += 2800 * (r == "hook" and area == "ui") + 2300 * (r == "layout" and area in ("ui", "build")) + 3200 * (r == "style" and shown) + 4500 * (bool(control(f)) and "input" in sig)
        bonus += conf(f) * (2500 if "config" in sig or area == "docs" else 300) + test(f) * (2500 if "tests" in sig else -2000)
        f["support"] = 100_000 * f["explicit"] + f["relation"] + 7_000 * f["filename_hits"] + 3_000 * f["overlap"] + bonus + f["nearby"] + f["score"] - 10_000 * (r == "page" and not f["relation"] and not f["met"])
        pieces = re.split("[/.]", low)
        f["moves"] = bool({"migrate", "migration", "migrations"} & set(pieces))
        layer = 7000 if {"query", "queries", "repository", "repositories"} & set(pieces) else 2500 if {"database", "storage", "schema"} & set(pieces) else -5000 if f["moves"] else 0
        if area == "docs":
            f["special"] = ((10_000 if f["depth"] <= 2 else 6_000) if f["name"] == "package.json" else 12_000 if f["name"] in A.ENV_EXAMPLES else 6_500 if f["name"] in A.MANIFESTS else 0) - 8_000 * f["lock"] + max(0, 3_000 - 300 * f["depth"]) + f["nearby"]
        elif area == "build":
            f["special"] = f["support"] + 12_000 * f["builder"] + 8_000 * (f["name"] == "package.json") - 15_000 * f["lock"] + max(0, 3_000 - 250 * f["depth"]) + 8_000 * (f["mention"] > 0)
        else:
            f["special"] = f["affinity"] if r == "types" else layer
        f["guard"] = "security" in sig and conf(f) and (f["home"] or f["space"])
    result = list(anchors)
    by_support = sorted(files, key=lambda f: (-f["support"], -f["score"], f["path"]))
    by_special = sorted(files, key=lambda f: (-f["special"], -f["support"], f["path"]))
    has = lambda t: any(t(f) for f in result)

    def add(test_, pool=by_support, n=1, cap=limit):
        for f in [f for f in pool if f not in result and test_(f)][:n]:
            if len(result) < cap:
                result.append(f)

    persists, role_is = (lambda f: f["role"] in A.PERSISTENCE), (lambda *r: lambda f: f["role"] in r)

    def coverage():
        guard_conf = lambda f: "security" in sig and conf(f) and f["space"]
        if area == "backend":
            if not has(role_is(*A.LOGIC)):
                add(role_is(*A.LOGIC))
            if "storage" in sig and not has(persists):
                add(persists)
            if has(persists) and not has(entry):
                add(entry)
            if not has(conf):
                add(guard_conf)
        if area == "fullstack":
            for t, pool in ((back, by_support), (front, by_support), (role_is("client-api"), by_support), (role_is("types"), by_special)):
                if not has(t):
                    add(t, pool)
            add(persists, by_special)
            if not has(conf):
                add(guard_conf)
        if area == "ui":
            for t in (role_is("hook", "client-api"), role_is("store"), role_is("types", "ui-component", "layout")):
                add(t)
            if "navigation" in sig:
                add(role_is("layout"))
            if "input" in sig:
                add(control)
        if area == "tests":
            add(lambda f: not test(f) and f["kind"] == "source" and f["home"], n=4)
            add(lambda f: not test(f) and f["relation"])
            add(lambda f: not test(f) and f["known"])
            add(lambda f: not test(f) and (f["known"] or f["relation"]))
        if area == "docs":
            add(lambda f: conf(f) and f["name"] in A.ENV_EXAMPLES, by_special)
            root = lambda f: conf(f) and f["name"] in A.MANIFESTS and f["depth"] <= 2
            add(root if any(root(f) for f in files) else lambda f: conf(f) and f["name"] in A.MANIFESTS, by_special)
            if shown or sig & {"formula", "input"}:
                add(lambda f: not docs(f) and not conf(f) and f["kind"] == "source" and (f["met"] or f["role"] == "utility" or f["symbol"]))
            add(conf, by_special, n=8)
        if area == "build":
            add(conf, by_special)
            add(role_is("layout", "app-entry", "server-entry"), by_special)
            add(conf, by_special)
        if area in ("bugfix", "refactor"):
            if shown:
                add(role_is("style"))
            if "input" in sig:
                add(control)
            add(lambda f: from_role(f, "page", "component", "ui-component", "style", "hook", "utility") and (f["relation"] or f["known"]))

    if server:
        coverage()
    if area == "ui":
        add(lambda f: from_role(f, "component", "ui-component", "hook", "store", "types", "utility") and (f["space"] or f["relation"]) and f["domain"])
    add(lambda f: (f["relation"] or f["known"]) and (f["mention"] or f["symbol"]))
    reach = {
        "backend": back, "fullstack": lambda f: back(f) or front(f), "ui": lambda f: front(f) or from_role(f, "types", "store", "utility"), "tests": lambda f: not docs(f) and not conf(f),
        "build": lambda f: conf(f) or from_role(f, "layout", "app-entry", "server-entry"), "bugfix": lambda f: f["kind"] in ("source", "style"), "refactor": lambda f: f["kind"] in ("source", "style"),
    }.get(area, lambda f: False)
    direct = sorted([f for f in files if f["relation"] and reach(f)], key=lambda f: (-f["affinity"], -f["relation"], -f["support"], f["path"]))
    if area == "ui" and sig & {"interaction", "navigation", "input"}:
        add(control, direct, n=2)
    add(lambda f: True, direct, n={"backend": 3, "fullstack": 3, "ui": 3, "tests": 3, "refactor": 2, "bugfix": 2, "build": 2}.get(area, 0))
    if not server:
        coverage()
    soft_cap = min(limit, 5 if review else 8 if area == "fullstack" else 7)
    idle = lambda f: f["role"] == "page" and not f["relation"] and not f["explicit"] and not f["filename_hits"] and f["overlap"] < 2
    add(lambda f: not (area == "ui" and (docs(f) or conf(f))) and (f["relation"] or f["known"] or (area in ("docs", "build") and conf(f)) or f["support"] >= 5_500) and not idle(f), n=8, cap=soft_cap)

    stays = {
        "ui": lambda f: front(f) or from_role(f, "types", "store", "utility"), "backend": lambda f: back(f) or ("endpoint" in sig and f["role"] == "client-api") or f["guard"],
        "fullstack": lambda f: front(f) or back(f) or f["guard"], "tests": src, "docs": lambda f: docs(f) or conf(f) or src(f), "build": reach, "bugfix": reach, "refactor": reach,
    }.get(area, src)
    top = max(a["score"] for a in anchors)
    rows = []
    for turn, f in enumerate(result):
        r, hard, said_it = f["role"], f["relation"] > 3500, bool(f["mention"] or f["symbol"] or f["domain"])
        e = 100 * f["explicit"] + 32 * (f["filename_hits"] > 0) + min(30, 12 * f["overlap"]) + 25 * f["meant"] + 45 * (f["mention"] > 0) + 55 * (f["symbol"] > 0) + 35 * (f["domain"] > 0) + 28 * (f["affinity"] > 0)
        e += 100 if hard else 12 if f["relation"] else 0
        e += 35 * (area == "docs" and (conf(f) or docs(f))) + 35 * (area == "build" and conf(f)) + 25 * (area == "tests" and f["name"] == "package.json")
        e += 25 * ("types" in sig and r == "types") + 25 * ("storage" in sig and persists(f)) + 25 * ("endpoint" in sig and entry(f)) + 48 * (server and r == "server-entry") + 90 * (area == "fullstack" and r == "client-api") + 48 * (server and persists(f))
        e += 22 * ("data_flow" in sig and r in ("hook", "client-api", "service", "api-route")) + 30 * (shown and r == "style") + 20 * ("input" in sig and r in ("component", "ui-component")) + 48 * ("navigation" in sig and r in ("layout", "component", "ui-component")) + 48 * f["guard"]
        e -= 35 * bool(f["relation"] and not hard and not ("navigation" in sig and r == "layout") and not f["affinity"] and not f["domain"])
        if r == "page" and not f["relation"] and not f["explicit"]:
            e -= 55 if f["met"] else 100
        e -= 100 * bool(area == "ui" and r in A.BACKEND and not f["relation"] and not f["explicit"]) + 80 * (f["moves"] and "migration" not in sig)
        points = max(
            8500 * (area == "fullstack" and (r == "client-api" or persists(f))), 8000 * (area == "backend" and "endpoint" in sig and r == "client-api"), 8500 * bool(area == "ui" and sig & {"interaction", "input"} and control(f)),
            8000 * (area == "ui" and "data_flow" in sig and r in ("hook", "client-api", "store", "types")), 8500 * bool(area in ("bugfix", "refactor") and ((shown and r == "style") or ("input" in sig and control(f)))), 9000 * f["guard"],
        )
        close = f["near"] or hard
        keep = 100_000 * f["explicit"] + 90_000 * said_it + 8 * points + 65_000 * hard + 42_000 * close + 8_000 * f["filename_hits"] + 3_000 * f["overlap"] + 4_000 * f["meant"] + f["score"]
        if f["explicit"]:
            safe = True
        elif not stays(f):
            safe = False
        elif r == "page" and not said_it and not hard:
            safe = e >= 52
        else:
            safe = bool(said_it or points or close or (area == "ui" and r in ("store", "types") and f["affinity"]) or e >= 32 or f["score"] >= max(72, 0.42 * top))
        rows.append({"path": f["path"], "turn": turn, "e": e, "keep": keep, "safe": safe, "support": f["support"], "anchor": f in anchors, "part": "anchor" if f in anchors else "pruned"})
    budget = {"fullstack": 4, "backend": 4, "tests": 4, "docs": 4, "build": 3, "bugfix": 3, "refactor": 3}.get(area, 2)
    if area == "ui" and sig & {"navigation", "input", "appearance", "responsive", "data_flow"}:
        budget = 3
    budget = min(budget, 3) if review else budget
    soft = max(0, min(limit, len(anchors) + budget) - len(anchors))
    safe = sorted([x for x in rows if x["safe"] and not x["anchor"]], key=lambda x: (-x["keep"], -x["e"], -x["support"], x["turn"]))[: min(max(0, limit - len(anchors)), soft + 2)]
    for x in safe:
        x["part"] = "protected"
    for x in sorted([x for x in rows if x["part"] == "pruned" and x["e"] >= 32], key=lambda x: (-x["e"], -x["support"], x["turn"]))[: max(0, soft - len(safe))]:
        x["part"] = "optional"
    out, pos = [], 0
    for x in rows:
        pos += x["part"] != "pruned"
        out.append((x["path"], x["part"], x["e"], x["keep"], None if x["part"] == "pruned" else pos))
    return out


@pytest.mark.parametrize("size", [0, 4, 26])
def test_assembly_against_a_plain_search(spark, size):
    pick = random.Random(size)
    places = ["", "src/shop/", "apps/web/src/orders/", "server/src/queries/", "server/migrations/", "packages/core/src/lib/"]
    stems = ["orderForm", "shopHelper", "index", "inputField", "orders", "headerMenu", "package.json", ".env.example", "vite.config.ts", "pnpm-lock.yaml", "README.md", "go.mod", "selectCard", "sessionToken"]
    windows, edges, want = [], [], {}
    for t in range(6 * len(TASKS)):
        area, text, review = TASKS[t % len(TASKS)]
        files = {}
        for k in range(size if t % 7 else 2):
            role = pick.choice(list(ROLES))
            name = pick.choice(stems)
            path = pick.choice(places) + (name if "." in name else f"{name}{pick.choice(['', k])}.ts")
            files[path] = {"path": path, "kind": ROLES[role], "role": role, "explicit": int(pick.random() < 0.08), "overlap": pick.choice([0, 0, 1, 2]), "filename_hits": pick.choice([0, 0, 0, 1, 2]), "symbol_hits": int(pick.random() < 0.1), "score": pick.choice([20, 40, 64, 80, 150])}
        names = list(files)
        own = {}
        for _ in range(2 * len(names)):
            pair = (pick.choice(names), pick.choice(names))
            if pair[0] != pair[1]:
                own.setdefault(pair, set()).add(pick.choice(list(A.EDGE_POINTS)))
        windows += [(t, f"p{t}", f["path"], f["kind"], f["role"], area, f["explicit"], f["overlap"], f["filename_hits"], f["symbol_hits"], f["score"]) for f in files.values()]
        edges += [(f"p{t}", a, b, k) for (a, b), kinds in own.items() for k in kinds]
        want[t] = plain(area, text, review, list(files.values()), own)
    tasks = spark.createDataFrame([(t, *TASKS[t % len(TASKS)][1:]) for t in range(6 * len(TASKS))], "task_id int, raw_task string, review_only boolean")
    window = spark.createDataFrame(windows, "task_id int, project_id string, path string, kind string, role string, area string, explicit int, overlap long, filename_hits long, symbol_hits int, score int").repartition(3)
    links = spark.createDataFrame(edges, "project_id string, src string, dst string, kind string").repartition(3)
    got = {}
    for r in A.assemble(window, tasks, links).collect():
        got.setdefault(r.task_id, set()).add((r.path, r.part, r.evidence, r.retention, r.pos))
    for t in want:
        assert got.get(t, set()) == set(want[t]), (t, TASKS[t % len(TASKS)])
    if size == 26:
        assert {p for w in want.values() for _, p, *_ in w} == {"anchor", "protected", "optional", "pruned"}
