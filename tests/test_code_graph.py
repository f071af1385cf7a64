"""Bindings, the code graph, resolved names and symbol evidence on small sources that meet every rule."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import modules as M
from tessera.operators import code_graph as G

STATEMENTS = {
    "import a from './a'": [("default", "a", "default", False)],
    "import type A from './a'": [("default", "A", "default", True)],
    "import type from './a'": [("default", "type", "default", False)],
    'import a, { b, c as d } from "./a";': [("b", "b", "named", False), ("c", "d", "named", False), ("default", "a", "default", False)],
    "import { type T, u AS v, 1x, } from './a'": [("T", "T", "named", True), ("u", "v", "named", False)],
    "import type { T,\n  U as V\n} from './a'": [("T", "T", "named", True), ("U", "V", "named", True)],
    "import * as all from './a'": [("*", "all", "namespace", False)],
    "import d, * as all from './a'": [("*", "all", "namespace", False), ("default", "d", "default", False)],
    "import{a}from'./a'": [("a", "a", "named", False)],
    "import './side'": [],
    "export { a, b as default } from './a'": [("a", "a", "reexport", False), ("b", "default", "reexport", False)],
    "export type { T } from './a'": [("T", "T", "reexport", True)],
    "export{a}from\"./a\"": [("a", "a", "reexport", False)],
}
NOTHING = [
    "", None, "// import a from './a'", "/* import a from './a'\n*/", "const s = \"import a from './a'\"", "const s = `\nimport a from './a'\n` + x", "importer.from('x')", "export const a = 1",
    "export { a }", "const p = import('./a')", "export default from_x", "x.import (a)",
]


def test_bindings_of_every_form(spark):
    texts = [*STATEMENTS, *NOTHING]
    files = spark.createDataFrame([("p", str(k), t) for k, t in enumerate(texts)], "project_id string, path string, content string")
    got = {k: [] for k in range(len(texts))}
    for r in G.bindings(files).orderBy("pos").collect():
        got[int(r.src)].append((r.imported, r.local, r.kind, r.type_only))
        assert r.module == "./a"
    assert [got[k] for k in range(len(texts))] == [*STATEMENTS.values(), *([[]] * len(NOTHING))]
    # the same statements in one text, with comments and strings between them, and a clause of any length
    long = "import { " + ", ".join(f"n{k}" for k in range(3000)) + " } from './a'"
    whole = "\n".join(f"{s} // from './b'\n/* '{k} */ const q{k} = 'http://x';" for k, s in enumerate([*STATEMENTS, long]))
    one = spark.createDataFrame([("p", "x", whole)], files.schema)
    found = [(r.imported, r.local, r.kind, r.type_only) for r in G.bindings(one).orderBy("pos").collect()]
    assert found == [b for bs in STATEMENTS.values() for b in bs] + [(f"n{k}", f"n{k}", "named", False) for k in range(3000)]


def test_specifiers_and_identifiers(spark):
    text = "import a from './a'; const b = require( './b' )\nconst c = await import(`./c`) // require('./no')\n@import url('./d.css');\nimport './a'\nlet s = 'x.require(y)'"
    files = spark.createDataFrame([("p", "f", text), ("p", "g", None)], "project_id string, path string, content string")
    assert sorted(r.specifier for r in G.specifiers(files).collect()) == ["./a", "./b", "./c", "./d.css"]
    names = files.select(M.identifiers(F.col("content")).alias("n")).first().n
    assert "a" in names and "await" in names and "y" not in names and "no" not in names


def test_edges_of_all_kinds(spark):
    content = {
        "src/app/page.tsx": "\n".join(f"import '{m}'" for m in ["./x.css", "../hooks/useA", "../services/s", "../lib/l", "../api/y", "../client", "../repo/db/r", "../types/t", "../ui/Button", "./local/part", "../plain", "react", "./none"]),
        "src/plain.test.ts": "import '@/plain'",
    }
    others = [
        ("src/app/x.css", "style", "style"), ("src/hooks/useA.ts", "source", "hook"), ("src/services/s.ts", "source", "service"), ("src/lib/l.ts", "source", "utility"), ("src/api/y.ts", "source", "unknown"),
        ("src/client.ts", "source", None), ("src/repo/db/r.ts", "source", "unknown"), ("src/types/t.ts", "source", "types"), ("src/ui/Button.tsx", "source", "ui-component"), ("src/app/local/part.ts", "source", "unknown"),
        ("src/plain.ts", None, None),
    ]
    rows = [("p", f, "source", "page", c) for f, c in content.items()] + [("p", f, k, r, None) for f, k, r in others]
    files = spark.createDataFrame(rows, "project_id string, path string, kind string, role string, content string")
    got = {(r.src, r.dst, r.kind) for r in G.edges(files).collect()}
    kinds = ["style-import", "hook-import", "service-import", "utility-import", "client-api-import", "client-api-import", "storage-import", "types-import", "component-import", "route-local", "import"]
    want = {("src/app/page.tsx", f, k) for (f, _, _), k in zip(others, kinds)}
    want |= {("src/plain.test.ts", "src/plain.ts", "route-local"), ("src/plain.test.ts", "src/plain.ts", "test-target"), ("src/plain.ts", "src/plain.test.ts", "proposed-test")}
    assert got == want | {(b, a, "imported-by") for a, b, _ in want}
    assert {k for *_, k in got} == {*kinds, "test-target", "proposed-test", "imported-by"}


@pytest.mark.parametrize("length", [1, 5, 23])
def test_names_through_chains_and_circles(spark, length):
    files = [(f"f{k}", f"export {{ n{k + 1} as n{k} }} from './f{k + 1}'") for k in range(length)]
    files += [
        (f"f{length}", f"export const n{length} = 1"), ("use", "import { n0 as mine, gone } from './f0'; import { c0 } from './c0'; import * as all from './f0'; import x from 'react'"),
        ("c0", "export { c1 as c0 } from './c1'"), ("c1", "export { c0 as c1 } from './c0'"), ("own", "export { n0 } from './f0'\nexport const n0 = 2"), ("use2", "import { n0 } from './own'"),
    ]
    df = spark.createDataFrame([("p", f"{n}.ts", c) for n, c in files] + [("q", "use.ts", "import { n0 } from './f0'")], "project_id string, path string, content string")
    found = df.select("project_id", F.col("path"), "content")
    declared = found.select("project_id", F.col("path").alias("file"), F.explode(F.regexp_extract_all("content", F.lit(r"export const (\w+)"), 1)).alias("name"))
    resolved = G.resolve_imports(found.select("project_id", "path"), G.specifiers(found))
    got = {(r.src, r.local): (r.file, r.name, r.hops) for r in G.resolve_names(G.bindings(found), resolved, declared).collect()}
    last = (f"f{length}.ts", f"n{length}")
    assert got[("use.ts", "mine")] == (*last, length) and got[("use2.ts", "n0")] == ("own.ts", "n0", 0)
    assert ("use.ts", "gone") not in got and ("use.ts", "c0") not in got and ("use.ts", "all") not in got
    assert all(got[(f"f{k}.ts", f"n{k}")] == (*last, length - k - 1) for k in range(length))


def test_evidence_with_limits_that_bind(spark):
    roles = {"a/owner.ts": "service", "a/state.ts": "store", "types/shape.ts": "types", "x/plain.ts": "unknown", "r/cartPage.ts": "api-route", "r/cartHelperPage.ts": "page", **{f"c/use{k:02}.ts": "component" for k in range(40)}}
    files = spark.createDataFrame([("p", f, r) for f, r in roles.items()], "project_id string, path string, role string")
    uses = [("p", f"c/use{k:02}.ts", "reference", "TotalSum") for k in range(40)]
    facts = spark.createDataFrame(
        [("p", "a/owner.ts", "declaration", "totalSum"), ("p", "a/owner.ts", "reference", "totalSum"), ("p", "a/state.ts", "state", "totalSum"), ("p", "types/shape.ts", "property", "total_sum"),
         ("p", "x/plain.ts", "property", "totalSum"), ("p", "r/cartPage.ts", "declaration", "CartPage"), ("p", "r/cartHelperPage.ts", "declaration", "CartHelperPage"), ("q", "z.ts", "declaration", "totalSum"), *uses],
        "project_id string, file string, kind string, name string",
    )
    graph = spark.createDataFrame([("p", "c/use00.ts", "a/owner.ts", "import"), ("p", "a/owner.ts", "c/use01.ts", "route-local"), ("p", "c/use01.ts", "a/owner.ts", "import"), ("p", "c/use02.ts", "a/state.ts", "imported-by")], "project_id string, src string, dst string, kind string")
    tasks = spark.createDataFrame([(1, "p", "please adjust the TotalSum of all carts soon"), (2, "p", "cart"), (3, "q", "cart"), (4, "p", None)], "task_id int, project_id string, raw_task string")
    asked = G.query_symbols(tasks)
    assert {(r.task_id, r.symbol) for r in asked.collect()} >= {(1, "totalsum"), (2, "cart")}
    links = G.evidence_links(asked, files, facts, graph).cache()
    total = [r for r in links.collect() if r.symbol == "totalsum"]
    assert {(r.file, r.role, r.evidence) for r in total if r.related is None} == {("a/owner.ts", "producer", "symbol_exact"), ("a/state.ts", "state-owner", "state_graph"), ("types/shape.ts", "contract", "symbol_exact")}
    per_owner = {o: sorted(r.file for r in total if r.related == o) for o in ("a/owner.ts", "a/state.ts", "types/shape.ts")}
    # the owner refers to its own name, which takes one of the first nine consumers from the others
    assert per_owner["a/owner.ts"] == [f"c/use{k:02}.ts" for k in range(8)] and per_owner["a/state.ts"] == ["a/owner.ts"] + [f"c/use{k:02}.ts" for k in range(7)]
    how = {(r.related, r.file): (r.role, r.relation) for r in total}
    assert how[("a/owner.ts", "c/use00.ts")] == ("consumer", "import_graph") and how[("a/owner.ts", "c/use01.ts")] == ("consumer", "route_local")
    assert how[("a/state.ts", "c/use02.ts")] == ("reference", "identifier_reference")
    assert [(r.task_id, r.symbol, r.file, r.role, r.evidence) for r in links.collect() if r.evidence == "route_graph"] == [(2, "CartPage", "r/cartPage.ts", "route", "route_graph")]
    best = {(r.task_id, r.file): (r.ownership, r.roles, r.symbols, r.links) for r in G.best_by_file(links).collect()}
    assert best[(1, "a/owner.ts")] == ("symbol_exact", ["producer", "reference"], ["totalsum"], 3)
    assert [(r.rank, r.owner, r.consumer) for r in G.chains(links, 1).collect()] == [(1, "a/owner.ts", "c/use00.ts")] and G.chains(links).count() == 2
