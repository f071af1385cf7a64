"""Queries of the path and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import paths as P
from ..functions import text as X
from .bindings import CONTENT_SQL, FILES_SQL, TASKS_SQL, content_files, files, read, tasks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _has(col: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains({col}, '{p}')" for p in parts) + ")"


def _begins(col: str, *parts: str) -> str:
    return "(" + " OR ".join(f"starts_with({col}, '{p}')" for p in parts) + ")"


_PARTS = """parts AS (SELECT *, lower(path) AS p, string_split(path, '/') AS seg FROM files),
named AS (SELECT *, seg[-1] AS name, lower(seg[-1]) AS lname FROM parts),
ext AS (SELECT *, CASE WHEN ends_with(lname, '.db-wal') THEN '.db-wal' WHEN ends_with(lname, '.db-shm') THEN '.db-shm' ELSE regexp_extract(lname, '[^.](\\.[^.]*)$', 1) END AS ext,
    regexp_replace(lname, '([^.])\\.[^.]*$', '\\1') AS stem FROM named)"""
_KIND = f"""CASE WHEN {_has("p", *L.TEST_MARKS)} THEN 'test'
    WHEN lname IN {_in(L.DOC_FILE_NAMES)} OR contains(p, '/docs/') OR ext IN ('.md', '.mdx') THEN 'docs'
    WHEN lname IN {_in(L.CONFIG_FILE_NAMES)} OR regexp_matches(lname, '^(tsconfig|jsconfig).*\\.json$') OR ends_with(lname, '.env.example') THEN 'config'
    WHEN ext IN {_in(L.STYLE_EXTENSIONS)} THEN 'style' WHEN ext IN {_in(L.SOURCE_EXTENSIONS)} THEN 'source'
    WHEN ext IN {_in(L.ASSET_EXTENSIONS)} THEN 'asset' WHEN ext IN {_in(L.DATA_EXTENSIONS)} THEN 'data'
    WHEN contains(p, '/logs/') OR ext IN ('.log', '.tmp') THEN 'runtime' ELSE 'unknown' END"""
_ROLE = f"""CASE WHEN kind IN ('docs', 'style', 'config', 'test', 'asset', 'data', 'runtime') THEN kind
    WHEN {_begins("p", "app/api/", "pages/api/", "api/")} OR {_has("p", "/app/api/", "/pages/api/")} OR lname IN {_in(L.ROUTE_FILES)} THEN 'api-route'
    WHEN {_begins("p", "routes/", "controllers/")} OR {_has("p", "/routes/", "/controllers/")} THEN 'api-route'
    WHEN lname IN {_in(L.PAGE_FILES)} OR contains(p, '/pages/') THEN 'page' WHEN lname IN {_in(L.LAYOUT_FILES)} THEN 'layout'
    WHEN contains(p, '/ui/') THEN 'ui-component' WHEN contains(p, '/components/') THEN 'component'
    WHEN {_has("p", "/db/", "/database/", "/schema/")} OR regexp_matches(p, 'schema\\.(prisma|sql)$') OR regexp_matches(lname, '^(db|database)\\.[cm]?[jt]s$') THEN 'db-schema'
    WHEN {_has("p", "/repositories/", "/repository/")} THEN 'repository'
    WHEN {_has("p", "/types/", "/interfaces/")} OR regexp_matches(lname, '(^|[.-])(types?|interfaces?)\\.[cm]?[jt]sx?$') THEN 'types'
    WHEN {_has("p", "/services/", "/service/")} OR regexp_matches(lname, 'service\\.[cm]?[jt]sx?$') THEN
        CASE WHEN {_has("p", "/client/", "/web/", "/frontend/", "/renderer/")} THEN 'client-api' ELSE 'service' END
    WHEN regexp_matches(p, '/api\\.[jt]s$') OR {_has("p", "/api/client", "/client/api", "/lib/api")} OR regexp_matches(lname, '(api|client)\\.[cm]?[jt]sx?$') OR regexp_matches(stem, '(api|client)$') THEN 'client-api'
    WHEN {_has("p", "/store/", "/stores/")} THEN 'store' WHEN contains(p, '/hooks/') OR regexp_matches(stem, '^use[a-z0-9]') THEN 'hook'
    WHEN lname IN ('server.ts', 'server.js') OR starts_with(p, 'server/index.') THEN 'server-entry'
    WHEN regexp_matches(lname, '^(robots|sitemap|manifest|middleware)\\.[cm]?[jt]s$') THEN 'config'
    WHEN regexp_matches(lname, '^(config|settings)\\.[cm]?[jt]s$') AND (starts_with(p, 'server/') OR contains(p, '/server/')) THEN 'config'
    WHEN {_has("p", "/utils/", "/utilities/", "/helpers/", "/lib/")} OR regexp_matches(stem, '^(calculations?|formatters?|validators?|parsers?|classify|scoring|risk|appearance)([.-]|$)') THEN 'utility'
    WHEN (starts_with(p, 'server/') OR contains(p, '/server/')) AND regexp_matches(stem, '^(auth|session|queue|worker|processor|provider|manager|ai)([.-]|$)') THEN 'service'
    WHEN lname IN {_in(L.ENTRY_FILES)} THEN 'app-entry' WHEN regexp_matches(name, '^[A-Z]') THEN 'component'
    WHEN ({_begins("p", "src/app/", "app/")} OR {_has("p", "/src/app/", "/app/")}) AND ext IN ('.tsx', '.jsx') THEN 'component'
    WHEN kind = 'source' THEN 'unknown' ELSE kind END"""
#: The inventory with what its paths tell, as SQL.
INVENTORY_SQL = f"{FILES_SQL}, {_PARTS}, kinds AS (SELECT *, {_KIND} AS kind FROM ext), inventory AS (SELECT *, {_ROLE} AS role FROM kinds)"


def inventory(spark, sf_dir):
    """The path inventory with kind and role."""
    found = files(spark, sf_dir).withColumn("kind", P.kind(F.col("path")))
    return found.withColumn("role", P.role(F.col("path"), F.col("kind")))


@query("prj_path_parts", f"""WITH {FILES_SQL}, {_PARTS} SELECT project_id, path, p AS norm, len(seg)::INT AS depth, name,
    array_to_string(seg[1:len(seg) - 1], '/') AS dir, ext, regexp_replace(name, '([^.])\\.[^.]*$', '\\1') AS stem FROM ext""")  # fmt: skip
def path_parts(spark, sf_dir):
    p = F.col("path")
    name = P.base_name(p)
    return files(spark, sf_dir).select("project_id", "path", P.norm_path(p).alias("norm"), P.depth(p).alias("depth"), name.alias("name"), P.directory(p).alias("dir"), P.extension(name).alias("ext"), P.stem(name).alias("stem"))


query("prj_kind_and_role", f"WITH {INVENTORY_SQL} SELECT project_id, path, size_bytes, kind, role FROM inventory")(inventory)


@query("prj_route_path", f"""WITH {FILES_SQL}, {_PARTS}, a AS (SELECT *, coalesce(nullif(coalesce(list_position(seg, 'app'), 0), 0), coalesce(list_position(seg, 'pages'), 0)) AS spot FROM named)
SELECT project_id, path, CASE WHEN lname IN {_in([*L.PAGE_FILES, "route.ts", "route.js"])} AND spot > 0 THEN '/' || coalesce(array_to_string(list_transform(list_filter(seg[spot + 1:len(seg) - 1],
    lambda s: NOT starts_with(s, '(') AND NOT starts_with(s, '_') AND s NOT IN ('index', '')), lambda s: regexp_replace(s, '^\\[(.+)\\]$', ':\\1')), '/'), '') END AS route FROM a""")  # fmt: skip
def route_path(spark, sf_dir):
    return files(spark, sf_dir).select("project_id", "path", P.route_path(F.col("path")).alias("route"))


@query("prj_generated_and_readable", f"""WITH {FILES_SQL}, {_PARTS} SELECT project_id, path,
    lname IN {_in(L.GENERATED_FILE_NAMES)} OR {_has("('/' || p)", *L.GENERATED_PATH_PARTS)} AS generated,
    CASE WHEN lname = '.env' OR (starts_with(lname, '.env.') AND NOT contains(lname, 'example')) THEN false
        WHEN ends_with(lname, '.env.example') OR lname = 'env.example' THEN true ELSE ext IN {_in(L.TEXT_EXTENSIONS)} END AS readable FROM ext""")  # fmt: skip
def generated(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select("project_id", "path", P.is_generated(p).alias("generated"), P.can_read_text(P.base_name(p)).alias("readable"))


@query("prj_workspace_root", f"""WITH {FILES_SQL}, {_PARTS}, l AS (SELECT *, string_split(p, '/') AS q FROM named),
a AS (SELECT *, coalesce(list_max(list_filter(range(1, len(q) + 1), lambda i: q[i] = 'src')), 0) AS spot FROM l)
SELECT project_id, path, CASE WHEN spot > 1 THEN array_to_string(q[1:spot - 1], '/') WHEN q[1] IN ('apps', 'packages') AND len(q) > 1 THEN q[1] || '/' || q[2] ELSE q[1] END AS root FROM a""")  # fmt: skip
def workspace_root(spark, sf_dir):
    return files(spark, sf_dir).select("project_id", "path", P.workspace_root(F.col("path")).alias("root"))


_FLAGS = f"""name IN {_in(L.DOC_NAMES_EXACT)} OR path = 'docs' OR starts_with(path, 'docs/') AS is_docs, name IN {_in(L.ENV_EXAMPLES)} AS is_env_example,
    list_contains(seg, 'tests') OR list_contains(seg, '__tests__') OR regexp_matches(lname, '\\.(test|spec)\\.[cm]?[jt]sx?$') AS is_test_file,
    regexp_matches(lname, '^((vitest|jest|playwright|cypress)\\.config|karma\\.conf|wdio\\.conf|test)\\.[cm]?[jt]s$') AS is_test_config,
    regexp_matches(p, '^\\.github/workflows/[^/]+\\.ya?ml$') OR path IN ('.gitlab-ci.yml', 'azure-pipelines.yml', 'bitbucket-pipelines.yml') AS is_ci,
    regexp_matches(lname, '^(tsconfig(\\..+)?\\.json|(vite|webpack|rollup|eslint|tailwind)\\.config\\.[cm]?[jt]s|docker-compose\\.ya?ml|dockerfile)$') AS is_config,
    name IN {_in(L.LOCK_FILES)} AS is_lock, name IN {_in(L.README_NAMES)} AS is_readme, name IN {_in(L.AGENT_NAMES)} AS is_agents, regexp_matches(lname, '^tsconfig(\\..+)?\\.json$') AS is_tsconfig"""
FLAGS_SQL = f"{FILES_SQL}, {_PARTS}, flags AS (SELECT project_id, path, {_FLAGS} FROM named)"


def readiness_flags(spark, sf_dir):
    return files(spark, sf_dir).select("project_id", "path", *[c.alias(n) for n, c in P.readiness_flags(F.col("path")).items()])


query("prj_readiness_flags", f"WITH {FLAGS_SQL} SELECT * FROM flags")(readiness_flags)


@query("prj_support_flags", f"""WITH {INVENTORY_SQL}, s AS (SELECT *, lname = 'package.json' OR regexp_matches(lname, '^(\\.env|env)[._-](example|sample|template)$')
    OR regexp_matches(lname, '^(pyproject\\.toml|cargo\\.toml|go\\.mod|pom\\.xml|composer\\.json|gemfile|requirements(-dev)?\\.txt)$') OR regexp_matches(lname, '^docker-compose(\\.[^.]+)?\\.ya?ml$') AS doc_support FROM inventory)
SELECT project_id, path, doc_support, doc_support AND len(seg) = 1 AS root_doc_support,
    role IN ('repository', 'db-schema', 'store') OR (regexp_matches(p, '(^|/)(db|database|storage|repository|repositories|persistence)(/|$)') AND regexp_matches(lname, '(query|queries|repository|database|storage|schema|model|adapter)')) AS persistence,
    role = 'test' OR {_has("p", *L.TEST_MARKS)} AS test_like FROM s""")  # fmt: skip
def support_flags(spark, sf_dir):
    found = inventory(spark, sf_dir)
    return found.select("project_id", "path", *[c.alias(n) for n, c in P.support_flags(F.col("path"), F.col("role")).items()])


@query("prj_safe_relative", """WITH u AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS path, page_id % 4 AS k FROM pages),
v AS (SELECT page_id, CASE k WHEN 0 THEN substr(path, 2) WHEN 1 THEN '../' || substr(path, 2) WHEN 2 THEN 'a/../..' || path ELSE path END AS path FROM u),
s AS (SELECT *, list_transform(string_split(path, '/'), lambda x: CASE WHEN x = '..' THEN -1 WHEN x IN ('', '.') THEN 0 ELSE 1 END) AS steps FROM v)
SELECT page_id, path, path <> '' AND NOT starts_with(path, '/') AND NOT regexp_matches(path, '^[A-Za-z]:')
    AND coalesce(list_min(list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i]))), 0) >= 0 AS safe FROM s""")
def safe_relative(spark, sf_dir):
    path = F.regexp_replace("url", "^https?://[^/]*", "")
    k = F.col("page_id") % 4
    made = F.when(k == 0, F.substring(path, 2, 1 << 30)).when(k == 1, F.concat(F.lit("../"), F.substring(path, 2, 1 << 30))).when(k == 2, F.concat(F.lit("a/../.."), path)).otherwise(path)
    rows = read(spark, sf_dir, "pages").select("page_id", made.alias("path"))
    return rows.withColumn("safe", P.is_safe_relative(F.col("path")))


_HINT_TOKENS = f"""list_filter(regexp_split_to_array(lower(regexp_replace(content, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-zа-яё0-9]+'),
    lambda w: length(w) BETWEEN 3 AND 32 AND w NOT IN {_in(L.HINT_STOP_WORDS)} AND NOT regexp_matches(w, '^[0-9]+$'))"""


_HEADS = r"array_to_string(regexp_extract_all(content, '(?:^|\n)#{1,6}[ \t]+([^\n]+)', 1), ' ')"
_HINTED = f"(path || ' ' || content || ' ' || {_HEADS} || ' ' || {_HEADS})"


@query("agg_top_hints", f"""WITH {CONTENT_SQL}, t AS (SELECT project_id, path, unnest({_HINT_TOKENS.replace("content", _HINTED)}) AS token FROM content_files),
c AS (SELECT project_id, path, token, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY n DESC, token) AS rn FROM c),
h AS (SELECT project_id, path, string_agg(token, ' ' ORDER BY rn) AS hints FROM r WHERE rn <= 18 GROUP BY ALL)
SELECT project_id, path, coalesce(hints, '') AS hints FROM content_files LEFT JOIN h USING (project_id, path)""")  # fmt: skip
def top_hints(spark, sf_dir):
    from ..operators.aggregates import top_hints as hints

    return hints(content_files(spark, sf_dir)).withColumn("hints", F.array_join("hints", " "))


@query("fn_task_tokens", f"""WITH {TASKS_SQL} SELECT task_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(
    lower(trim(regexp_replace(regexp_replace(raw_task, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g'))), '[^\\p{{L}}\\p{{N}}_-]+'),
    lambda w: length(w) >= 3 AND w NOT IN {_in(L.TASK_STOP_WORDS)}))), ' ') AS tokens FROM tasks""")  # fmt: skip
def task_tokens(spark, sf_dir):
    return tasks(spark, sf_dir).select("task_id", F.array_join(F.array_sort(X.task_words(F.col("raw_task"))), " ").alias("tokens"))


@query("fn_expand_tokens")
def expand_tokens(spark, sf_dir):
    words = tasks(spark, sf_dir).select(F.explode(X.task_words(F.col("raw_task"))).alias("token")).distinct()
    return words.select("token", F.array_join(X.expand_tokens(F.col("token")), " ").alias("expanded"))


@query("fn_canonical_symbol", """WITH n AS (SELECT DISTINCT p_name || '_' || p_brand || 'TypeABCDef' AS name FROM part)
SELECT name, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 2 AND NOT list_contains(__STOP__, w)), '') AS canonical,
    array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 2), ' ') AS parts FROM n""".replace("__STOP__", "[" + ", ".join(f"'{w}'" for w in L.IDENTIFIER_STOP_WORDS) + "]"))
def canonical_symbol(spark, sf_dir):
    name = F.concat("p_name", F.lit("_"), "p_brand", F.lit("TypeABCDef"))
    names = read(spark, sf_dir, "part").select(name.alias("name")).distinct()
    return names.select("name", X.canonical_symbol(F.col("name")).alias("canonical"), F.array_join(X.tokenize_identifier(F.col("name")), " ").alias("parts"))


@query("fn_search_tokens", """WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 2) AS w FROM benchmark),
d AS (SELECT item_id, list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i]) AS w FROM w)
SELECT item_id, array_to_string(w[1:12], ' ') AS tokens FROM d""")
def search_tokens(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.search_tokens(F.col("text")), " ").alias("tokens"))


@query("fn_token_keys", """WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 2)) AS token FROM benchmark)
SELECT token, CASE WHEN length(token) > 4 AND ends_with(token, 's') THEN left(token, length(token) - 1) ELSE token END AS plural_key,
    CASE WHEN length(token) >= 8 THEN left(token, 6) WHEN length(token) >= 5 THEN left(token, 4) END AS prefix_key FROM w""")
def token_keys(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)
    rows = read(spark, sf_dir, "benchmark").select(F.explode(words).alias("token")).distinct()
    return rows.select("token", X.plural_key(F.col("token")).alias("plural_key"), X.prefix_key(F.col("token")).alias("prefix_key"))


@query("fn_extract_sampled", """WITH e AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, 'href="([^"]+)"', 1), lambda x: trim(x)), lambda x: x <> '') AS v FROM pages),
d AS (SELECT page_id, list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(v, v[i]) = i), lambda i: v[i]) AS v FROM e),
c AS (SELECT page_id, v, greatest(2, (len(v) - 1) // 2) AS m FROM d),
s AS (SELECT page_id, CASE WHEN len(v) <= 4 THEN v ELSE list_concat(list_concat(v[1:2], v[m + 1:m + 1]), v[len(v):len(v)]) END AS s FROM c)
SELECT page_id, array_to_string(list_transform(list_filter(range(1, len(s) + 1), lambda i: list_position(s, s[i]) = i), lambda i: s[i]), ' ') AS links FROM s""")
def extract_sampled(spark, sf_dir):
    links = X.sampled(X.extract_distinct(F.col("html"), 'href="([^"]+)"'), 4)
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(links, " ").alias("links"))


@query("fn_bounded_text", f"""WITH {CONTENT_SQL}, l AS (SELECT *, length(content) AS n FROM content_files)
SELECT project_id, path, md5(CASE WHEN n <= 2000 THEN content ELSE left(content, 900) || chr(10) || '...' || chr(10) || substr(content, greatest(900, (n - 500) // 2) + 1, 500) || chr(10) || '...' || chr(10) || right(content, 600) END) AS digest FROM l""")  # fmt: skip
def bounded_text(spark, sf_dir):
    return content_files(spark, sf_dir).select("project_id", "path", F.md5(X.bounded_text(F.col("content"), 2000)).alias("digest"))


@query("fn_content_preview", """SELECT page_id, left(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)/\\*.*?\\*/', ' ', 'g'), '(?m)//.*$', ' ', 'g'), '\\s+', ' ', 'g')), 360) AS preview FROM pages""")
def content_preview(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.content_preview(F.col("html")).alias("preview"))


def _concat_all(lists: list[str]) -> str:
    return lists[0] if len(lists) == 1 else f"list_concat({lists[0]}, {_concat_all(lists[1:])})"


def quoted_sql(pieces: str) -> str:
    """Of a column of pieces between quotes: a list of (n, s, v), the name and the sign before each value."""
    before = f"right(regexp_replace({pieces}[i - 1], '\\s+$', ''), 120)"
    rows = f"list_transform(range(2, len({pieces})), lambda i: {{'n': regexp_extract({before}, '([\\w.$-]+)\\s*[:=(]$', 1), 's': right({before}, 1), 'v': {pieces}[i]}})"
    return f"list_filter({rows}, lambda x: x.n <> '')"


_HINT_LISTS = [(":", "title", 220), (":", "description", 260), (":", "label", 180), (":", "heading", 180), (":", "subtitle", 180), ("=", "aria-label", 160)]
_HINTS = _concat_all([
    f"list_transform(list_filter(qs, lambda x: x.s = '{sign}' AND regexp_matches(lower(x.n), '(^|[.$-]){name}$') AND length(x.v) BETWEEN 3 AND {most}), lambda x: x.v)" for sign, name, most in _HINT_LISTS
] + ["list_filter(list_transform(list_filter(list_transform(ended[:-2], lambda x: regexp_split_to_array(x, '(?i)<(?:h1|h2|h3)(?:\\s[^>]*)?>')), lambda x: len(x) > 1), lambda x: x[-1]), lambda x: length(x) <= 260)"])


@query("fn_page_hints", f"""WITH p0 AS MATERIALIZED (SELECT page_id, regexp_split_to_array(html, '["''`]') AS pieces, regexp_split_to_array(html, '(?i)</(?:h1|h2|h3)>') AS ended FROM pages), p1 AS MATERIALIZED (SELECT page_id, ended, {quoted_sql("pieces")} AS qs FROM p0),
f AS (SELECT page_id, {_HINTS} AS v FROM p1),"""  + r"""
b AS (SELECT page_id, list_filter(list_transform(v, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '[{}()\[\]`$]', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: length(x) BETWEEN 3 AND 260) AS v FROM f)
SELECT page_id, array_to_string(list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(v, v[i]) = i), lambda i: v[i])[1:24], ' | ') AS hints FROM b""".replace("\\\\", "\\"))
def page_hints(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(X.page_hints(F.col("html")), " | ").alias("hints"))


_V = "[\"''`]?[^\\s\"'',`}:=]+"
_SET = rf"\b\w+\s*[:=]+\s*{_V}(?:\s*(?::=|[:=])\s*{_V}|[:=]+{_V}){{0,50}}[:=]*"
_AT = "\\b[A-Za-z][A-Za-z0-9+.-]*://[^\\s@]+@[^\\s\"'',`})]+"
_KEY = "(SECRET|TOKEN|PASS|API_KEY|PRIVATE_KEY|DATABASE_URL|ACCESS_KEY)"


@query("fn_redact_secrets", rf"""WITH m AS MATERIALIZED (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '{_SET}'))) AS m FROM documents),
g AS MATERIALIZED (SELECT doc_id, regexp_split_to_array(text, '{_SET}') AS rest, regexp_extract_all(text, '{_SET}') AS found FROM documents),
s AS (SELECT m, regexp_split_to_array(m, '[:=]') AS parts FROM (SELECT DISTINCT m FROM m)),
k AS (SELECT m, parts, list_position(list_transform(parts[:-2], lambda p: regexp_matches(upper(regexp_extract(p, '(\w+)\s*$', 1)), '{_KEY}')), true) AS spot FROM s),
c AS MATERIALIZED (SELECT map_from_entries(list((m, regexp_replace(left(m, length(array_to_string(parts[1:spot], ':'))), '\s+$', '') || '=<redacted>'))) AS how FROM k WHERE spot > 0),
o AS MATERIALIZED (SELECT doc_id, array_to_string(list_transform(range(1, len(rest) + 1), lambda i: rest[i] || CASE WHEN i <= len(found) THEN coalesce(how[found[i]], found[i]) ELSE '' END), '') AS text FROM g, c),
a AS MATERIALIZED (SELECT doc_id, regexp_split_to_array(text, '{_AT}') AS rest, regexp_extract_all(text, '{_AT}') AS found FROM o)
SELECT doc_id, sha256(array_to_string(list_transform(range(1, len(rest) + 1), lambda i: rest[i] || CASE WHEN i > len(found) THEN '' WHEN contains(lower(found[i]), 'postgresql://') THEN left(found[i], instr(lower(found[i]), 'postgresql://') + 12) || '<redacted>@<host>'
    WHEN contains(lower(found[i]), 'postgres://') THEN left(found[i], instr(lower(found[i]), 'postgres://') + 10) || '<redacted>@<host>' ELSE found[i] END), '')) AS digest FROM a""")
def redact(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(X.redact_secrets(F.col("text")), 256).alias("digest"))


@query("fn_snippet", """WITH h AS (SELECT doc_id, text, instr(lower(text), 'tion') AS spot FROM documents),
b AS (SELECT *, greatest(1, spot - 90) AS b, least(length(text), spot - 1 + 4 + 140) AS e FROM h WHERE spot > 0)
SELECT doc_id, CASE WHEN b > 1 THEN '...' ELSE '' END || trim(regexp_replace(substr(text, b, e - b + 1), '\\s+', ' ', 'g')) || CASE WHEN e < length(text) THEN '...' ELSE '' END AS snippet,
    (length(left(text, spot - 1)) - length(replace(left(text, spot - 1), chr(10), '')) + 1)::INT AS line FROM b""")
def snippet(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), F.lit("tion")).alias("s"))
    return rows.filter("s is not null").select("doc_id", "s.snippet", "s.line")


@query("fn_truncate", "SELECT conv_id, turn, left(text, 240) AS shown, length(text) > 240 AS truncated, length(text)::INT AS n FROM conversations")
def truncate(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", X.truncated(F.col("text"), 240).alias("t"))
    return rows.select("conv_id", "turn", F.col("t.text").alias("shown"), "t.truncated", F.col("t.length").alias("n"))


@query("fn_markdown_sections", """WITH m AS (SELECT conv_id, turn, '## Goal' || chr(10) || text || chr(10) || '## Role ' || role || chr(10) || 'body' AS md FROM conversations),
s AS (SELECT conv_id, turn, unnest(string_split(chr(10) || md, chr(10) || '## ')[2:]) AS p FROM m)
SELECT conv_id, turn, trim(string_split(p, chr(10))[1]) AS title, md5(trim(substr(p, length(string_split(p, chr(10))[1]) + 2))) AS digest FROM s""")
def markdown_sections(spark, sf_dir):
    md = F.concat(F.lit("## Goal\n"), "text", F.lit("\n## Role "), "role", F.lit("\nbody"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(X.markdown_sections(md)).alias("s"))
    return rows.select("conv_id", "turn", F.col("s.key").alias("title"), F.md5("s.value").alias("digest"))


@query("fn_stable_id", f"WITH {FILES_SQL} SELECT project_id, path, 'candidate_' || left(sha256(path), 14) AS id FROM files")
def stable_id(spark, sf_dir):
    return files(spark, sf_dir).select("project_id", "path", X.stable_id(F.col("path")).alias("id"))


@query("fn_value_kind", """WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_orderkey % 7 WHEN 0 THEN 'https://x.io/' || l_partkey WHEN 1 THEN '#' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') WHEN 2 THEN l_partkey || 'px'
    WHEN 3 THEN l_partkey::VARCHAR WHEN 4 THEN 'true' WHEN 5 THEN l_returnflag || l_partkey ELSE l_returnflag || ' - ' || l_partkey END AS value FROM lineitem)
SELECT l_orderkey, l_linenumber, value, CASE WHEN regexp_matches(value, '^https?://\\S+$') THEN 'url' WHEN regexp_matches(value, '^#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$') THEN 'color'
    WHEN regexp_matches(value, '^-?[0-9]+(?:\\.[0-9]+)?(?:px|rem|em|%|vh|vw|ms|s)$') THEN 'measure' WHEN regexp_matches(value, '^-?[0-9]+(?:\\.[0-9]+)?$') THEN 'number'
    WHEN value IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(value, '^[A-Za-z_$][A-Za-z0-9_$]*$') THEN 'identifier' ELSE 'text' END AS kind FROM v""")
def value_kind(spark, sf_dir):
    key, part = F.col("l_orderkey") % 7, F.col("l_partkey").cast("string")
    value = (
        F.when(key == 0, F.concat(F.lit("https://x.io/"), part)).when(key == 1, F.concat(F.lit("#"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")))
        .when(key == 2, F.concat(part, F.lit("px"))).when(key == 3, part).when(key == 4, F.lit("true")).when(key == 5, F.concat("l_returnflag", part))
        .otherwise(F.concat("l_returnflag", F.lit(" - "), part))
    )
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value")).withColumn("kind", X.value_kind(F.col("value")))


@query("fn_exact_value", """SELECT doc_id, nullif(regexp_extract(text, '["''`«]([^"''`«»\\n]{1,200})["''`»]', 1), '') AS value FROM documents""")
def exact_value(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.exact_value(F.col("text")).alias("value"))


@query("fn_shared_prefix_depth", f"""WITH {FILES_SQL}, f AS (SELECT project_id, path, first_value(path) OVER (PARTITION BY project_id ORDER BY path) AS anchor FROM files),
s AS (SELECT *, string_split(path, '/') AS a, string_split(anchor, '/') AS b FROM f)
SELECT project_id, path, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) - 1, len(a))::INT AS shared FROM s""")  # fmt: skip
def shared_prefix(spark, sf_dir):
    from pyspark.sql import Window

    anchor = F.first("path").over(Window.partitionBy("project_id").orderBy("path"))
    return files(spark, sf_dir).withColumn("anchor", anchor).select("project_id", "path", X.shared_prefix_depth(F.col("path"), F.col("anchor")).alias("shared"))


@query("fn_jaccard", """WITH w AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS w FROM conversations),
p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM w)
SELECT conv_id, turn, round(len(list_intersect(w, q)) / len(list_distinct(list_concat(w, q))), 3) AS jaccard FROM p WHERE q IS NOT NULL""")
def jaccard(spark, sf_dir):
    from pyspark.sql import Window

    w = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    w = w.withColumn("q", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("q is not null")
    return w.select("conv_id", "turn", X.jaccard(F.col("w"), F.col("q")).alias("jaccard"))
