"""Queries of module bindings, the code graph, resolved names and symbol evidence.

Each part is a source file of one of 20 projects. It takes names from its parent (half its place in the project) and
its successor, hands its parent's name on under its own in two of three cases, and declares it in the third.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import modules as M
from ..functions import paths as P
from ..functions import text as X
from ..operators import code_graph as G
from ..operators import investigation as I
from ..operators.joins import resolve_imports
from ..operators.lineage import cut
from ..operators.retention import retain_seeds
from .bindings import read, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Folder of a file by its place in the project.
PLACES = ["src/components", "src/hooks", "server/services", "src/utils", "src/client", "server/db", "src/types", "src/app/shop"]
#: Word at the end of the class that a part's file declares.
ENDS = ["Page", "Service", "Route", "Hook", "Store", "Modal", "Client"]


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _place(q):
    return F.element_at(F.array(*[F.lit(p) for p in PLACES]), (q % len(PLACES) + 1).cast("int"))


def _path(k):
    q = F.floor(k / 20)
    return F.concat(_place(q), F.lit("/m"), k.cast("string"), F.when(q % 8 == 0, ".tsx").otherwise(".ts"))


def code(spark, sf_dir):
    """(project_id, path, kind, role, content): a source file for each part, and tests of some."""
    k = F.col("p_partkey").cast("long")
    q, j, t = F.floor(k / 20), k % 20, lambda c: c.cast("string")
    parent, after = F.floor(q / 2) * 20 + j, k + 20
    up = F.repeat(F.lit("../"), F.size(F.split(_place(q), "/")))
    to = lambda other: F.concat(up, _place(F.floor(other / 20)), F.lit("/m"), t(other))
    word = F.initcap(F.substring_index("p_name", " ", 1))
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    named = join("export {\n  r", t(parent), " as r", t(k), ",\n  type T", t(parent), "\n} from '", to(parent), "';")
    tight = join("export{r", t(parent), " as r", t(k), '}from"', to(parent), '"; import def', t(k), ", { type T", t(parent), " as U", t(k), ' } from "', to(parent), '"')
    space = join("import * as ns", t(k), " from '", to(parent), "'\nimport './side.css'")
    lines = [
        F.lit("// import { ghost } from './ghost'\n/* export { gone } from './gone'\n*/ const url = 'http://x/y' // import a from 'b'"),
        F.when(q > 0, F.when(q % 3 == 1, named).when(q % 3 == 2, tight).otherwise(space)),
        F.when(q % 3 == 0, join("export const r", t(k), " = 1")),
        join("import type { T", t(after), " } from '", to(after), "'\nimport { r", t(after), " as c", t(k), " } from '", to(after), "'"),
        join("export function fn", t(k), "() { return fn", t(parent), "(c", t(k), ", fn", t(k + 40), ", sharedTotal) }"),
        F.when(q == 1, "export const sharedTotal = 0"),
        join("export class ", word, t(k), F.element_at(F.array(*[F.lit(e) for e in ENDS]), (k % len(ENDS) + 1).cast("int")), " {}"),
    ]
    rows = spread(read(spark, sf_dir, "part").select("p_partkey", "p_name")).select(join("p", t(j)).alias("project_id"), _path(k).alias("path"), F.concat_ws("\n", *lines).alias("content"), k.alias("k"), q.alias("q"))
    tests = rows.filter("k % 7 = 0 and q % 8 = 3").select("project_id", F.concat(F.lit("src/utils/m"), t(F.col("k")), F.lit(".test.ts")).alias("path"), join("import { fn", t(F.col("k")), " } from './m", t(F.col("k")), "'").alias("content"))
    both = rows.select("project_id", "path", "content").unionByName(tests).withColumn("kind", P.kind(F.col("path")))
    return cut(both.withColumn("role", P.role(F.col("path"), F.col("kind"))).select("project_id", "path", "kind", "role", "content"))


def facts(found):
    """(project_id, file, kind, name): what files declare, and all identifiers in them."""
    plain = M.without_comments(F.col("content"))
    own = lambda kind, values: found.select("project_id", F.col("path").alias("file"), F.lit(kind).alias("kind"), F.explode(values).alias("name"))
    declared = F.regexp_extract_all(plain, F.lit(rf"export\s+(?:function|const|class)\s+({M.NAME})"), 1)
    return own("declaration", declared).unionByName(own("reference", M.identifiers(F.col("content"))))


def asked(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("Inspect "), F.initcap(F.substring_index("p_name", " ", 1)), k, F.lit(" near fn"), k, F.lit(" then r"), k, F.when(F.col("p_partkey") % 3 == 0, " with sharedTotal").otherwise(""))
    tasks = spread(read(spark, sf_dir, "part").select("p_partkey", "p_name")).select(F.col("p_partkey").alias("task_id"), F.concat(F.lit("p"), (F.col("p_partkey") % 20).cast("string")).alias("project_id"), text.alias("raw_task"))
    return G.query_symbols(tasks)


_FILE = f"""[{", ".join(f"'{p}'" for p in PLACES)}][((k // 20) % 8 + 1)::INT] || '/m' || k || CASE WHEN (k // 20) % 8 = 0 THEN '.tsx' ELSE '.ts' END"""
#: Files, and their imports of files: (k, other, how), other being a part's number whether there is one or not.
CODE_SQL = f"""n AS MATERIALIZED (SELECT k, 'p' || (k % 20) AS project_id, k // 20 AS q, (k // 40) * 20 + k % 20 AS parent, k + 20 AS after, p_name, {_FILE} AS path, [{", ".join(f"'{p}'" for p in PLACES)}][((k // 20) % 8 + 1)::INT] AS folder FROM (SELECT p_partkey AS k, p_name FROM part)),
up AS MATERIALIZED (SELECT *, repeat('../', len(string_split(folder, '/'))) AS up FROM n), pl AS MATERIALIZED (SELECT unnest(range(0, (SELECT max(k) + 41 FROM n))) AS k),
stub AS MATERIALIZED (SELECT k, regexp_replace({_FILE}, '\\.tsx?$', '') AS stub FROM pl),
b AS MATERIALIZED (
  SELECT k, parent AS other, 'r' || parent AS imported, 'r' || k AS local, 'reexport' AS kind, false AS type_only FROM n WHERE q > 0 AND q % 3 IN (1, 2)
  UNION ALL SELECT k, parent, 'T' || parent, 'T' || parent, 'reexport', true FROM n WHERE q > 0 AND q % 3 = 1
  UNION ALL SELECT k, parent, 'default', 'def' || k, 'default', false FROM n WHERE q % 3 = 2
  UNION ALL SELECT k, parent, 'T' || parent, 'U' || k, 'named', true FROM n WHERE q % 3 = 2
  UNION ALL SELECT k, parent, '*', 'ns' || k, 'namespace', false FROM n WHERE q > 0 AND q % 3 = 0
  UNION ALL SELECT k, after, 'T' || after, 'T' || after, 'named', true FROM n UNION ALL SELECT k, after, 'r' || after, 'c' || k, 'named', false FROM n),
tests AS MATERIALIZED (SELECT k, project_id, 'src/utils/m' || k || '.test.ts' AS path, path AS source FROM n WHERE k % 7 = 0 AND q % 8 = 3)"""


@query("fn_bindings", f"""WITH {CODE_SQL} SELECT project_id, path AS src, up || stub AS module, imported, local, kind, type_only FROM b JOIN up USING (k) JOIN stub ON stub.k = other
UNION ALL SELECT project_id, path, './m' || k, 'fn' || k, 'fn' || k, 'named', false FROM tests""")
def bindings(spark, sf_dir):
    return G.bindings(code(spark, sf_dir)).drop("pos")


_EDGES = """e AS MATERIALIZED (SELECT DISTINCT a.project_id, a.path AS src, o.path AS dst, up || stub AS module, CASE o.q % 8 WHEN 0 THEN 'component-import' WHEN 1 THEN 'hook-import' WHEN 2 THEN 'service-import' WHEN 3 THEN 'utility-import' WHEN 4 THEN 'client-api-import' WHEN 5 THEN 'storage-import'
    WHEN 6 THEN 'types-import' ELSE CASE WHEN a.folder = o.folder THEN 'route-local' ELSE 'import' END END AS kind FROM b JOIN up a USING (k) JOIN n o ON o.k = b.other JOIN stub ON stub.k = b.other
  UNION ALL SELECT project_id, path, source, './m' || k, 'utility-import' FROM tests UNION ALL SELECT project_id, path, source, NULL, 'test-target' FROM tests UNION ALL SELECT project_id, source, path, NULL, 'proposed-test' FROM tests)"""


@query("ret_code_graph", f"WITH {CODE_SQL}, {_EDGES} SELECT * FROM e UNION ALL SELECT project_id, dst, src, module, 'imported-by' FROM e")
def code_graph(spark, sf_dir):
    return G.edges(code(spark, sf_dir))


@query("ret_resolved_names", f"""WITH RECURSIVE {CODE_SQL}, ask AS (SELECT b.k, local, other AS f, imported AS name FROM b JOIN n o ON o.k = b.other WHERE imported <> '*'),
own AS (SELECT k AS f, 'r' || k AS name FROM n WHERE q % 3 = 0 UNION ALL SELECT k, 'fn' || k FROM n),
w AS (SELECT k, local, f, name, 0 AS hops FROM ask UNION ALL SELECT w.k, w.local, b.other, b.imported, hops + 1 FROM w JOIN b ON b.k = w.f AND b.local = w.name AND b.kind = 'reexport' JOIN n ON n.k = b.other)
SELECT a.project_id, a.path AS src, local, o.path AS file, name, hops::BIGINT AS hops FROM w JOIN own USING (f, name) JOIN n a ON a.k = w.k JOIN n o ON o.k = w.f
UNION ALL SELECT project_id, path, 'fn' || k, source, 'fn' || k, 0 FROM tests""")
def resolved_names(spark, sf_dir):
    """Names that files import and the file that declares them, through any number of files that hand them on."""
    found = code(spark, sf_dir)
    resolved = resolve_imports(found.select("project_id", "path"), G.specifiers(found))
    return G.resolve_names(G.bindings(found), resolved, facts(found).filter("kind = 'declaration'").drop("kind"))


_ENDS = "[" + ", ".join(f"'{e}'" for e in ENDS) + "]"
_ASKED = """said AS MATERIALIZED (SELECT k AS task_id, project_id, list_filter(['inspect', lower(split_part(p_name, ' ', 1)) || k, 'near', 'fn' || k, 'then', 'r' || k] || CASE WHEN k % 3 = 0 THEN ['sharedtotal'] ELSE [] END, lambda s: length(s) >= 4) AS s FROM n),
ask AS MATERIALIZED (SELECT task_id, project_id, unnest(s) AS symbol, (unnest(range(0, len(s))))::INT AS pos FROM said)"""
_LINKS = f"""{_EDGES}, {_ASKED},
own AS MATERIALIZED (SELECT project_id, 'fn' || k AS symbol, path AS owner, q FROM n UNION ALL SELECT project_id, 'r' || k, path, q FROM n WHERE q % 3 = 0 UNION ALL SELECT project_id, 'sharedtotal', path, q FROM n WHERE q = 1),
ref AS MATERIALIZED (SELECT project_id, 'fn' || parent AS symbol, path AS consumer FROM n UNION SELECT project_id, 'fn' || (k + 40), path FROM n UNION SELECT project_id, 'r' || parent, path FROM n WHERE q > 0 AND q % 3 IN (1, 2)
  UNION SELECT project_id, 'r' || after, path FROM n UNION SELECT project_id, 'sharedtotal', path FROM n UNION SELECT project_id, 'fn' || k, path FROM tests),
m AS (SELECT own.project_id, symbol, owner, consumer, row_number() OVER (PARTITION BY own.project_id, symbol, owner ORDER BY consumer) AS rn FROM own JOIN ref USING (project_id, symbol) WHERE owner <> consumer),
rel AS MATERIALIZED (SELECT project_id, a, b, arg_min(relation, (way, relation)) AS relation FROM (SELECT project_id, src AS a, dst AS b, 0 AS way, CASE WHEN kind = 'route-local' THEN 'route_local' ELSE 'import_graph' END AS relation FROM e
    UNION ALL SELECT project_id, dst, src, 1, CASE WHEN kind = 'route-local' THEN 'route_local' ELSE 'import_graph' END FROM e) GROUP BY ALL),
of_symbol AS (SELECT project_id, symbol, owner AS file, CASE WHEN q % 8 = 6 THEN 'contract' ELSE 'producer' END AS role, 'symbol_exact' AS evidence, 'same_file' AS relation, NULL AS related FROM own
  UNION ALL SELECT m.project_id, symbol, consumer, CASE WHEN relation IS NULL THEN 'reference' ELSE 'consumer' END, CASE WHEN relation IS NULL THEN 'content_supported' ELSE 'reference_graph' END, coalesce(relation, 'identifier_reference'), owner
    FROM m LEFT JOIN rel ON rel.project_id = m.project_id AND a = owner AND b = consumer WHERE rn <= 8),
links AS MATERIALIZED (SELECT task_id, project_id, symbol, pos, file, role, evidence, relation, related FROM ask JOIN of_symbol USING (project_id, symbol)
  UNION ALL SELECT k, n.project_id, upper(left(p_name, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) || k || {_ENDS}[(k % {len(ENDS)} + 1)::INT], pos, path, 'producer', 'route_graph', NULL, NULL FROM n JOIN ask ON task_id = k AND symbol = lower(split_part(p_name, ' ', 1)) || k)"""


@query("jon_suffix_owner", f"""WITH {CODE_SQL} SELECT k AS task_id, project_id, lower(split_part(p_name, ' ', 1)) || k AS symbol, path AS file, upper(left(p_name, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) || k || {_ENDS}[(k % {len(ENDS)} + 1)::INT] AS declaration FROM n""")
def suffix_owner(spark, sf_dir):
    return G.suffix_owners(asked(spark, sf_dir), facts(code(spark, sf_dir)))


def _links(spark, sf_dir):
    found = code(spark, sf_dir)
    return G.evidence_links(asked(spark, sf_dir), found.select("project_id", "path", "role"), facts(found), G.edges(found))


@query("ret_symbol_evidence", f"WITH {CODE_SQL}, {_LINKS} SELECT * FROM links")
def symbol_evidence(spark, sf_dir):
    return _links(spark, sf_dir)


@query("agg_best_evidence", f"""WITH {CODE_SQL}, {_LINKS}, g AS (SELECT task_id, project_id, file, symbol, min(pos) AS pos, list(DISTINCT role) AS roles, min(list_position({G.EVIDENCE}, evidence)) AS rank, count(*) AS n FROM links GROUP BY ALL)
SELECT task_id, project_id, file, {G.EVIDENCE}[min(rank)::INT] AS ownership, array_to_string(list_sort(list_distinct(flatten(list(roles)))), ',') AS roles, array_to_string((list(symbol ORDER BY pos, symbol))[:12], ',') AS symbols, least(sum(n), 16)::BIGINT AS links FROM g GROUP BY ALL""")
def best_evidence(spark, sf_dir):
    return G.best_by_file(_links(spark, sf_dir)).withColumns({c: F.array_join(c, ",") for c in ("roles", "symbols")})


@query("ret_evidence_chains", f"""WITH {CODE_SQL}, {_LINKS}, c AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY pos, symbol, related, file)::INT AS rank, symbol, related AS owner, file AS consumer, relation FROM links WHERE role = 'consumer') SELECT * FROM c WHERE rank <= 24""")
def evidence_chains(spark, sf_dir):
    return G.chains(_links(spark, sf_dir))


def _trace(spark, sf_dir):
    """Traces from each part's file for the symbols that its task names."""
    found, tasks = code(spark, sf_dir), asked(spark, sf_dir)
    k = F.col("p_partkey").cast("long")
    seeds = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"), F.concat(F.lit("p"), (k % 20).cast("string")).alias("project_id"), _path(k).alias("file"), F.lit(0).alias("pos"))
    named = facts(found).select("project_id", "file", "kind", X.canonical_symbol(F.col("name")).alias("symbol")).filter("symbol <> ''")
    return I.trace(seeds, tasks.select("task_id", "symbol", "pos"), found.select("project_id", "path", "role"), named, G.edges(found))


def _trace_sql(hops: int, most: int) -> str:
    """The hops as common table expressions, each from the files found last; none of the operator's text is used."""
    out = f"""{_EDGES}, {_ASKED}, ahead AS MATERIALIZED (SELECT DISTINCT project_id, src, dst FROM e WHERE src <> dst),
step AS MATERIALIZED (SELECT * FROM (SELECT project_id, src AS parent, dst AS file, 2 AS way, row_number() OVER (PARTITION BY project_id, src ORDER BY dst) AS rn FROM ahead UNION ALL SELECT project_id, dst, src, 3, row_number() OVER (PARTITION BY project_id, dst ORDER BY src) FROM ahead) WHERE rn <= 8),
decl AS MATERIALIZED (SELECT project_id, path AS file, 'fn' || k AS symbol FROM n UNION SELECT project_id, path, 'r' || k FROM n WHERE q % 3 = 0 UNION SELECT project_id, path, 'sharedtotal' FROM n WHERE q = 1),
refs AS MATERIALIZED (SELECT project_id, path AS file, 'fn' || unnest([k, parent, k + 40]) AS symbol FROM n UNION SELECT project_id, path, 'r' || after FROM n UNION SELECT project_id, path, 'r' || k FROM n WHERE q = 0 OR q % 3 IN (0, 1, 2) UNION SELECT project_id, path, 'r' || parent FROM n WHERE q > 0 AND q % 3 IN (1, 2)
  UNION SELECT project_id, path, 'sharedtotal' FROM n UNION SELECT project_id, path, 'fn' || k FROM tests),
own2 AS MATERIALIZED (SELECT project_id, file, symbol FROM decl UNION SELECT project_id, file, symbol FROM refs),
f0 AS MATERIALIZED (SELECT k AS task_id, project_id, path AS file, 0 AS hop, 1 AS place, 0 AS way, NULL::VARCHAR AS symbol, NULL::VARCHAR AS parent, [path] AS trail FROM n)"""
    for h in range(1, hops + 1):
        out += f""", c{h} AS (SELECT task_id, f.project_id, s.file, s.way, f.place AS pp, 0 AS pos, f.file AS parent, NULL::VARCHAR AS symbol, f.trail FROM f{h - 1} f JOIN step s ON f.project_id = s.project_id AND f.file = s.parent WHERE f.hop = {h - 1}
  UNION ALL SELECT f.task_id, f.project_id, d.file, 1, f.place, ask.pos, f.file, ask.symbol, f.trail FROM f{h - 1} f JOIN ask ON ask.task_id = f.task_id JOIN own2 o ON o.project_id = f.project_id AND o.file = f.file AND o.symbol = ask.symbol JOIN decl d ON d.project_id = f.project_id AND d.symbol = ask.symbol AND d.file <> f.file WHERE f.hop = {h - 1}),
b{h} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, file ORDER BY way, pp, pos, parent, symbol) AS rn FROM c{h} c WHERE NOT EXISTS (SELECT 1 FROM f{h - 1} f WHERE f.task_id = c.task_id AND f.file = c.file)) WHERE rn = 1),
p{h} AS (SELECT b.*, (SELECT max(place) FROM f{h - 1} f WHERE f.task_id = b.task_id) + row_number() OVER (PARTITION BY task_id ORDER BY way, pp, pos, file) AS place FROM b{h} b),
f{h} AS MATERIALIZED (SELECT * FROM f{h - 1} UNION ALL SELECT task_id, project_id, file, {h}, place, way, symbol, parent, list_append(trail, file) FROM p{h} WHERE place <= {most})"""
    return out


_NODES = _trace_sql(3, 16) + """, have AS MATERIALIZED (SELECT f.task_id, f.file, bool_or(d.symbol IS NOT NULL) AS owns FROM f3 f JOIN ask USING (task_id) JOIN own2 o ON o.project_id = f.project_id AND o.file = f.file AND o.symbol = ask.symbol LEFT JOIN decl d ON d.project_id = f.project_id AND d.file = f.file AND d.symbol = ask.symbol GROUP BY ALL)"""


@query("ret_bounded_trace", f"""WITH {CODE_SQL}, {_NODES} SELECT f.task_id, f.project_id, f.file, hop::INT AS hop, place::INT AS place, ['seed', 'defines_symbol', 'imports', 'imported_by'][way + 1] AS way, symbol, parent, array_to_string(trail, '>') AS trail,
CASE WHEN owns THEN 'producer' WHEN owns IS NULL THEN 'candidate' ELSE 'consumer' END AS role, CASE WHEN owns AND way < 2 THEN 'strong' WHEN owns THEN 'probable' WHEN owns IS NULL THEN 'weak' ELSE 'reference' END AS strength FROM f3 f LEFT JOIN have h ON h.task_id = f.task_id AND h.file = f.file""")
def bounded_trace(spark, sf_dir):
    return _trace(spark, sf_dir)[0].withColumn("trail", F.array_join("trail", ">"))


@query("ret_trace_ends", f"""WITH {CODE_SQL}, {_NODES}, l AS (SELECT task_id, CASE WHEN contains(file, '.test.') THEN NULL WHEN contains(file, '/components/') OR contains(file, '/hooks/') THEN 'ui' WHEN contains(file, '/db/') THEN 'storage' WHEN contains(file, '/services/') OR contains(file, '/utils/') THEN 'service' WHEN contains(file, '/types/') THEN 'contract' END AS layer FROM f3)
SELECT task_id, count(*) AS n_files, count(*) >= 16 AS stopped, array_to_string(list_filter(['ui', 'api', 'service', 'storage', 'contract'], lambda x: NOT list_contains(coalesce(list(layer) FILTER (layer IS NOT NULL), []), x)), ',') AS layers FROM l GROUP BY task_id""")
def trace_ends(spark, sf_dir):
    return _trace(spark, sf_dir)[1].withColumn("layers", F.array_join("layers", ","))


def _retained(spark, sf_dir):
    """Each part's task selects up to three files of its project, and tries its file's parent, a far one and the parent's parent."""
    found = code(spark, sf_dir)
    k = F.col("p_partkey").cast("long")
    j = k % 20
    parent = lambda x: F.floor(x / 40) * 20 + j
    row = lambda n, other, a, b: F.struct(F.lit(n).alias("pos"), other.alias("other"), a.alias("editable"), b.alias("own"))
    yes, no = F.lit(True), F.lit(False)

    def named(*rows, own):
        each = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"), F.concat(F.lit("p"), j.cast("string")).alias("project_id"), F.explode(F.array(*rows)).alias("r"))
        given = each.select("task_id", "project_id", _path(F.col("r.other")).alias("path"), "r.pos", "r.editable", F.col("r.own").alias(own))
        return given.join(found.select("project_id", "path"), ["project_id", "path"], "left_semi").dropDuplicates(["task_id", "pos"])

    selected = named(row(0, k, yes, no), row(1, k + 20, no, k % 3 == 0), row(2, k + 40, k % 4 > 1, no), own="confirmed")
    seeds = named(row(0, parent(k), yes, k % 5 > 0), row(1, k + 80, yes, yes), row(2, parent(parent(k)), k % 7 > 0, yes), own="grounded")
    return retain_seeds(selected, seeds, G.edges(found), 3)


_RETAINED = f"""{_EDGES}, here AS MATERIALIZED (SELECT k, project_id, path FROM n), ed AS (SELECT DISTINCT project_id, src, dst FROM e WHERE src <> dst), nb AS MATERIALIZED (SELECT project_id, a AS path, list(DISTINCT b) AS near FROM (SELECT project_id, src AS a, dst AS b FROM ed UNION ALL SELECT project_id, dst, src FROM ed) GROUP BY ALL),
sel AS MATERIALIZED (SELECT t.k AS task_id, list(h.path ORDER BY pos) AS held, list(pos = 1 AND t.k % 3 > 0 OR pos = 2 AND t.k % 4 <= 1 ORDER BY pos) AS loose FROM n t, (VALUES (0), (1), (2)) v(pos) JOIN here h ON h.k = t.k + 20 * pos GROUP BY 1),
want AS (SELECT k, 0 AS pos, parent AS other, k % 5 > 0 AS grounded FROM n UNION ALL SELECT k, 1, k + 80, true FROM n UNION ALL SELECT k, 2, (parent // 40) * 20 + k % 20, true FROM n WHERE k % 7 > 0),
seed AS MATERIALIZED (SELECT w.k AS task_id, row_number() OVER (PARTITION BY w.k ORDER BY pos) AS nth, h.path, grounded, coalesce(near, []) AS near FROM want w JOIN here h ON h.k = w.other LEFT JOIN nb ON nb.project_id = h.project_id AND nb.path = h.path),
r AS (SELECT task_id, 0 AS step, held, loose, []::VARCHAR[] AS done FROM sel UNION ALL
  SELECT task_id, step + 1, CASE WHEN o = 'retained' THEN list_prepend(path, rp) WHEN o = 'full' THEN rp ELSE held END, CASE WHEN o = 'retained' THEN list_prepend(false, rl) WHEN o = 'full' THEN rl ELSE loose END, CASE WHEN o IS NULL THEN done ELSE list_append(done, path || '=' || o) END
  FROM (SELECT *, CASE WHEN path IS NULL OR list_contains(held, path) THEN NULL WHEN NOT grounded THEN 'ungrounded' WHEN NOT list_has_any(held, near) THEN 'unrelated' WHEN len(rp) >= 3 THEN 'full' ELSE 'retained' END AS o
    FROM (SELECT r.*, seed.path, grounded, near, CASE WHEN len(held) >= 3 AND list_contains(loose, true) THEN list_filter(held, lambda x, i: i <> list_position(loose, true)) ELSE held END AS rp, CASE WHEN len(held) >= 3 AND list_contains(loose, true) THEN list_filter(loose, lambda x, i: i <> list_position(loose, true)) ELSE loose END AS rl
      FROM r LEFT JOIN seed ON seed.task_id = r.task_id AND nth = step + 1 WHERE step < 3)))"""


@query("jon_retained_seeds", f"WITH RECURSIVE {CODE_SQL}, {_RETAINED} SELECT task_id, held[i] AS path, (i - 1)::INT AS pos FROM (SELECT task_id, held, unnest(range(1, len(held) + 1)) AS i FROM r WHERE step = 3)")
def retained_seeds(spark, sf_dir):
    return _retained(spark, sf_dir)[0]


@query("jon_seed_decisions", f"WITH RECURSIVE {CODE_SQL}, {_RETAINED} SELECT task_id, split_part(d, '=', 1) AS path, split_part(d, '=', 2) AS outcome FROM (SELECT task_id, unnest(done) AS d FROM r WHERE step = 3)")
def seed_decisions(spark, sf_dir):
    return _retained(spark, sf_dir)[1]
