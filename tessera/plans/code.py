"""Queries of source facts, test pairs, traces and rename impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts as X
from ..operators import graph as G
from .bindings import FILES_SQL, files, read, spread
from .linking import graph as shop_graph
from .scalars import _in, quoted_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def sources(spark, sf_dir):
    """A small source text for each part."""
    k, slug = F.col("p_partkey").cast("string"), F.replace("p_name", F.lit(" "), F.lit("_"))
    lines = [
        F.concat(F.lit("import { "), slug, F.lit(" } from './"), slug, F.lit("'")), F.concat(F.lit("import type X"), k, F.lit(" from \"lib"), k, F.lit("\"")),
        F.concat(F.lit("const lazy = import('./lazy"), k, F.lit("'); const fs = require('fs')")), F.concat(F.lit("export async function run_"), slug, F.lit("() {}")),
        F.concat(F.lit("export class "), slug, k, F.lit(" {}")), F.concat(F.lit("router.get('/items/"), k, F.lit("', run); app.use(\"/api\")")),
        F.concat(F.lit("const [open"), k, F.lit(", setOpen] = useState(false); t('menu."), slug, F.lit("')")),
    ]
    return spread(read(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", F.concat_ws("\n", *lines).alias("content"))


_SOURCES = """src AS (SELECT p_partkey, replace(p_name, ' ', '_') AS slug, p_partkey::VARCHAR AS k FROM part),
content AS (SELECT p_partkey, concat_ws(chr(10), 'import { ' || slug || ' } from ''./' || slug || '''', 'import type X' || k || ' from "lib' || k || '"', 'const lazy = import(''./lazy' || k || '''); const fs = require(''fs'')', 'export async function run_' || slug || '() {}',
    'export class ' || slug || k || ' {}', 'router.get(''/items/' || k || ''', run); app.use("/api")', 'const [open' || k || ', setOpen] = useState(false); t(''menu.' || slug || ''')') AS content FROM src)"""


_BEHIND = [
    ("route", "(", [f"{r}.{v}" for r in ("router", "app") for v in ("get", "post", "put", "patch", "delete", "use")]), ("route_key", ":", ["path", "routePath"]),
    ("translation", "(", ["t", "translate", "i18n.t"]), ("translation_key", ":", ["labelKey", "descriptionKey", "titleKey", "translationKey"]),
]


@query("fn_source_facts", f"""WITH {_SOURCES}, pieces AS MATERIALIZED (SELECT p_partkey, regexp_split_to_array(content, '["''`]') AS pieces FROM content), quotes AS MATERIALIZED (SELECT p_partkey, {quoted_sql("pieces")} AS qs FROM pieces), v AS (""" + " UNION ALL ".join(
    "SELECT p_partkey, '{}' AS kind, list_filter(list_transform(regexp_extract_all(content, '{}', 1), lambda x: trim(x)), lambda x: x <> '') AS v FROM content".format(k, p.replace("'", "''")) for k, p in X.PATTERNS.items()
) + "".join(
    f" UNION ALL SELECT p_partkey, '{k}', list_filter(list_transform(list_filter(qs, lambda x: x.s = '{s}' AND string_split(x.n, '-')[-1] IN {_in(n)}), lambda x: trim(x.v)), lambda x: x <> '') FROM quotes" for k, s, n in _BEHIND
) + """), d AS (SELECT p_partkey, kind, list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(v, v[i]) = i), lambda i: v[i]) AS v FROM v)
SELECT p_partkey, kind, v[i] AS value, (i - 1)::INT AS pos FROM (SELECT p_partkey, kind, v, unnest(range(1, len(v) + 1)) AS i FROM d)""")  # fmt: skip
def source_facts(spark, sf_dir):
    rows = sources(spark, sf_dir).select("p_partkey", F.explode(X.facts(F.col("content"))).alias("f"))
    return rows.select("p_partkey", "f.kind", "f.value", "f.pos")


_TEST = "(" + " OR ".join(f"contains(lower(path), '{m}')" for m in (".test.", ".spec.", "/tests/", "/__tests__/", ".smoke.", ".replay.")) + " OR starts_with(lower(path), 'tests/') OR starts_with(lower(path), '__tests__/'))"


@query("jon_pair_tests", f"""WITH {FILES_SQL}, ts AS (SELECT project_id, path, regexp_replace(path, '\\.ts$', '') AS base FROM files WHERE ends_with(path, '.ts') AND NOT {_TEST}),
f AS (SELECT project_id, path FROM files UNION SELECT project_id, CASE length(path) % 3 WHEN 0 THEN base || '.test.ts' WHEN 1 THEN regexp_replace(base, '^src/', 'tests/') || '.spec.ts' ELSE 'misc/__tests__/' || upper(string_split(base, '/')[-1]) || '.spec.ts' END FROM ts),
t AS (SELECT project_id, path AS test, regexp_replace(path, '\\.(test|spec)\\.(tsx|jsx|ts|js)$', '.\\2') AS plain FROM f WHERE {_TEST}),
u AS (SELECT *, regexp_replace(plain, '(^|/)__tests__/', '\\1', 'g') AS one, regexp_replace(plain, '(^|/)tests?/', '\\1src/', 'g') AS two FROM t), u2 AS (SELECT *, lower(regexp_replace(string_split(one, '/')[-1], '([^.])\\.[^.]*$', '\\1')) AS stem FROM u),
s AS (SELECT project_id, path AS source, lower(regexp_replace(string_split(path, '/')[-1], '([^.])\\.[^.]*$', '\\1')) AS stem FROM f WHERE NOT {_TEST}),
m AS (SELECT u2.project_id, test, source, 1 AS r FROM u2 JOIN s ON u2.project_id = s.project_id AND one = source UNION ALL SELECT u2.project_id, test, source, 2 FROM u2 JOIN s ON u2.project_id = s.project_id AND two = source
UNION ALL SELECT u2.project_id, test, g.source, 3 FROM u2 JOIN (SELECT project_id, stem, min(source) AS source FROM s GROUP BY ALL) g ON u2.project_id = g.project_id AND u2.stem = g.stem)
SELECT project_id, test, arg_min(source, r) AS source FROM m GROUP BY ALL""")  # fmt: skip
def pair_tests(spark, sf_dir):
    own = files(spark, sf_dir).select("project_id", "path")
    marked = F.rlike(F.lower("path"), F.lit(r"\.(test|spec|smoke|replay)\.|(^|/)(tests|__tests__)/"))
    base = F.regexp_replace("path", r"\.ts$", "")
    made = (
        F.when(F.length("path") % 3 == 0, F.concat(base, F.lit(".test.ts"))).when(F.length("path") % 3 == 1, F.concat(F.regexp_replace(base, "^src/", "tests/"), F.lit(".spec.ts")))
        .otherwise(F.concat(F.lit("misc/__tests__/"), F.upper(F.element_at(F.split(base, "/"), -1)), F.lit(".spec.ts")))
    )
    tests = own.filter(F.endswith("path", F.lit(".ts")) & ~marked).select("project_id", made.alias("path"))
    return G.pair_tests(own.unionByName(tests).distinct())


@query("ret_trace", """WITH e AS (SELECT DISTINCT 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
h0 AS (SELECT c_custkey AS task_id, 'c' || c_custkey AS node, 0 AS hop FROM customer), h1 AS (SELECT DISTINCT task_id, b AS node, 1 AS hop FROM h0 JOIN e ON node = a), h2 AS (SELECT DISTINCT task_id, b AS node, 2 AS hop FROM h1 JOIN e ON node = a), h3 AS (SELECT DISTINCT task_id, b AS node, 3 AS hop FROM h2 JOIN e ON node = a)
SELECT task_id, node, min(hop)::INT AS hop FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY ALL""")  # fmt: skip
def trace(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = shop_graph(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    edges = edges.unionByName(read(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("a"), name("n", "s_nationkey").alias("b")))
    edges = edges.unionByName(read(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("a"), name("r", "n_regionkey").alias("b")))
    seeds = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), name("c", "c_custkey").alias("node"))
    return G.trace(seeds, edges)


@query("ret_rename_impact", """WITH RECURSIVE b AS (SELECT DISTINCT 'f' || l_partkey AS file, 'f' || (l_partkey // 2) AS module, 'n' || l_linenumber AS symbol, l_partkey % 3 > 0 AS reexports FROM lineitem WHERE l_partkey > 0),
r AS (SELECT DISTINCT 'f' || (l_partkey // 2) AS file, 'n' || l_linenumber AS symbol, true AS reexports, 0 AS depth FROM lineitem WHERE l_partkey % 50 = 1
UNION ALL SELECT b.file, b.symbol, b.reexports, depth + 1 FROM r JOIN b ON b.module = r.file AND b.symbol = r.symbol WHERE r.reexports)
SELECT symbol, file, min(depth)::INT AS depth FROM r GROUP BY symbol, file""")
def rename_impact(spark, sf_dir):
    """Parts as files of a binary tree of imports, two thirds of which re-export what they import; order lines name
    what they import, and every fiftieth part's module declares it."""
    item = read(spark, sf_dir, "lineitem").filter("l_partkey > 0")
    module = F.concat(F.lit("f"), F.expr("l_partkey div 2").cast("string"))
    symbol = F.concat(F.lit("n"), F.col("l_linenumber").cast("string"))
    bound = item.select(F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file"), module.alias("module"), symbol.alias("symbol"), (F.col("l_partkey") % 3 > 0).alias("reexports"))
    declared = item.filter("l_partkey % 50 = 1").select(module.alias("file"), symbol.alias("symbol")).distinct()
    return G.rename_impact(bound, declared, declared.select("symbol").distinct())
