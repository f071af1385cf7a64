"""Path classification as column expressions: every rule is a built-in expression on one path column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups as L


def any_of(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def has(text: Column, *parts: str) -> Column:
    return any_of(F.contains(text, F.lit(p)) for p in parts)


def begins(text: Column, *parts: str) -> Column:
    return any_of(F.startswith(text, F.lit(p)) for p in parts)


def like(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def norm_path(path: Column) -> Column:
    """Forward slashes, no leading ``./``, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")))


def segments(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: s != "")


def depth(path: Column) -> Column:
    return F.size(segments(path))


def base_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(segments(path), F.lit(-1)), F.lit(""))


def directory(path: Column) -> Column:
    parts = segments(path)
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; a leading dot alone begins none; the two database side files are their own."""
    low = F.lower(name)
    plain = F.regexp_extract(low, r"[^.](\.[^.]*)$", 1)
    return F.when(F.endswith(low, F.lit(".db-wal")), ".db-wal").when(F.endswith(low, F.lit(".db-shm")), ".db-shm").otherwise(plain)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"([^.])\.[^.]*$", "$1")


def is_generated(path: Column) -> Column:
    full = F.concat(F.lit("/"), F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))
    return base_name(full).isin(L.GENERATED_FILE_NAMES) | has(full, *L.GENERATED_PATH_PARTS)


def can_read_text(name: Column) -> Column:
    low = F.lower(name)
    secret = (low == ".env") | (F.startswith(low, F.lit(".env.")) & ~F.contains(low, F.lit("example")))
    example = F.endswith(low, F.lit(".env.example")) | (low == "env.example")
    return F.when(secret, False).when(example, True).otherwise(extension(low).isin(L.TEXT_EXTENSIONS))


def is_config_name(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(L.CONFIG_FILE_NAMES) | like(low, r"^(tsconfig|jsconfig).*\.json$") | F.endswith(low, F.lit(".env.example"))


def kind(path: Column) -> Column:
    """One of nine kinds; the first rule that fits decides."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = base_name(p)
    ext = extension(name)
    return (
        F.when(has(p, *L.TEST_MARKS), "test")
        .when(name.isin(L.DOC_FILE_NAMES) | has(p, "/docs/") | ext.isin(".md", ".mdx"), "docs")
        .when(is_config_name(name), "config")
        .when(ext.isin(L.STYLE_EXTENSIONS), "style")
        .when(ext.isin(L.SOURCE_EXTENSIONS), "source")
        .when(ext.isin(L.ASSET_EXTENSIONS), "asset")
        .when(ext.isin(L.DATA_EXTENSIONS), "data")
        .when(has(p, "/logs/") | ext.isin(".log", ".tmp"), "runtime")
        .otherwise("unknown")
    )


def role(path: Column, file_kind: Column) -> Column:
    """One of 23 roles. Frontend folders come before names that look like a domain's; services of a client are clients."""
    raw = F.replace(path, F.lit("\\"), F.lit("/"))
    p = F.lower(raw)
    name = base_name(p)
    own = stem(name)
    first = F.regexp_replace(own, "[.-].*$", "")
    script = extension(name).isin(".ts", ".js", ".mts", ".mjs", ".cts", ".cjs")
    in_server = begins(p, "server/") | has(p, "/server/")
    code = r"\.[cm]?[jt]sx?$"
    rules = [
        (file_kind.isin("docs", "style", "config", "test", "asset", "data", "runtime"), file_kind),
        (begins(p, "app/api/", "pages/api/", "api/") | has(p, "/app/api/", "/pages/api/") | name.isin(L.ROUTE_FILES), "api-route"),
        (begins(p, "routes/", "controllers/") | has(p, "/routes/", "/controllers/"), "api-route"),
        (name.isin(L.PAGE_FILES) | has(p, "/pages/"), "page"),
        (name.isin(L.LAYOUT_FILES), "layout"),
        (has(p, "/ui/"), "ui-component"),
        (has(p, "/components/"), "component"),
        (has(p, "/db/", "/database/", "/schema/") | like(p, r"schema\.(prisma|sql)$") | like(name, r"^(db|database)\.[cm]?[jt]s$"), "db-schema"),
        (has(p, "/repositories/", "/repository/"), "repository"),
        (has(p, "/types/", "/interfaces/") | like(name, r"(^|[.-])(types?|interfaces?)" + code), "types"),
        (
            has(p, "/services/", "/service/") | like(name, "service" + code),
            F.when(has(p, "/client/", "/web/", "/frontend/", "/renderer/"), "client-api").otherwise("service"),
        ),
        (like(p, r"/api\.[jt]s$") | has(p, "/api/client", "/client/api", "/lib/api") | like(name, "(api|client)" + code) | like(own, "(api|client)$"), "client-api"),
        (has(p, "/store/", "/stores/"), "store"),
        (has(p, "/hooks/") | like(own, "^use[a-z0-9]"), "hook"),
        (name.isin("server.ts", "server.js") | begins(p, "server/index."), "server-entry"),
        (script & own.isin(L.CONFIG_STEMS), "config"),
        (script & own.isin(L.SERVER_CONFIG_STEMS) & in_server, "config"),
        (
            has(p, "/utils/", "/utilities/", "/helpers/", "/lib/") | first.isin(L.UTILITY_STEMS),
            "utility",
        ),
        (in_server & first.isin(L.SERVICE_STEMS), "service"),
        (name.isin(L.ENTRY_FILES), "app-entry"),
        (like(base_name(raw), "^[A-Z]"), "component"),
        ((begins(p, "src/app/", "app/") | has(p, "/src/app/", "/app/")) & extension(name).isin(".tsx", ".jsx"), "component"),
    ]
    out = F
    for test, value in rules:
        out = out.when(test, value)
    return out.otherwise(F.when(file_kind == "source", "unknown").otherwise(file_kind))


def route_path(path: Column) -> Column:
    """The route of a page or route file under ``app`` (else ``pages``); null for other files.

    Groups in parentheses, private folders and ``index`` leave no part; ``[id]`` becomes ``:id``.
    """
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    app, pages = F.array_position(parts, "app"), F.array_position(parts, "pages")
    start = F.when(app > 0, app).otherwise(pages).cast("int")
    inner = F.slice(parts, start + 1, F.greatest(F.size(parts) - start - 1, F.lit(0)))
    shown = F.filter(inner, lambda s: ~begins(s, "(", "_") & ~s.isin("index", ""))
    named = F.transform(shown, lambda s: F.regexp_replace(s, r"^\[(.+)\]$", ":$1"))
    file = F.lower(F.element_at(parts, -1))
    return F.when(file.isin([*L.PAGE_FILES, "route.ts", "route.js"]) & (start > 0), F.concat(F.lit("/"), F.array_join(named, "/")))


def workspace_root(path: Column) -> Column:
    """What stands before the last ``src``; else an app's or package's folder; else the first part."""
    parts = F.filter(F.split(F.lower(F.trim(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", ""))), "/"), lambda s: s != "")
    back = F.array_position(F.reverse(parts), "src").cast("int")
    last = F.when(back > 0, F.size(parts) - back).otherwise(0)
    return (
        F.when(last > 0, F.array_join(F.slice(parts, 1, F.greatest(last, F.lit(0))), "/"))
        .when(F.get(parts, F.lit(0)).isin("apps", "packages") & (F.size(parts) > 1), F.array_join(F.slice(parts, 1, 2), "/"))
        .otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("")))
    )


def is_safe_relative(path: Column) -> Column:
    """Whether a relative path stays below its root at every step."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    steps = F.transform(F.split(p, "/"), lambda s: F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1))
    low = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda a, x: F.struct((a["now"] + x).alias("now"), F.least(a["low"], a["now"] + x).alias("low")),
        lambda a: a["low"],
    )
    return (p != "") & ~begins(p, "/") & ~like(p, "^[A-Za-z]:") & (low >= 0)


def readiness_flags(path: Column) -> dict[str, Column]:
    name = base_name(path)
    return {
        "is_docs": name.isin(L.DOC_NAMES_EXACT) | (path == "docs") | begins(path, "docs/"),
        "is_env_example": name.isin(L.ENV_EXAMPLES),
        "is_test_file": F.array_contains(F.split(path, "/"), "tests") | F.array_contains(F.split(path, "/"), "__tests__") | like(F.lower(name), r"\.(test|spec)\.[cm]?[jt]sx?$"),
        "is_test_config": like(F.lower(name), r"^((vitest|jest|playwright|cypress)\.config|karma\.conf|wdio\.conf|test)\.[cm]?[jt]s$"),
        "is_ci": like(F.lower(path), r"^\.github/workflows/[^/]+\.ya?ml$") | path.isin(".gitlab-ci.yml", "azure-pipelines.yml", "bitbucket-pipelines.yml"),
        "is_config": like(F.lower(name), r"^(tsconfig(\..+)?\.json|(vite|webpack|rollup|eslint|tailwind)\.config\.[cm]?[jt]s|docker-compose\.ya?ml|dockerfile)$"),
        "is_lock": name.isin(L.LOCK_FILES),
        "is_readme": name.isin(L.README_NAMES),
        "is_agents": name.isin(L.AGENT_NAMES),
        "is_tsconfig": like(F.lower(name), r"^tsconfig(\..+)?\.json$"),
    }


def support_flags(path: Column, file_role: Column) -> dict[str, Column]:
    """Documentation support, the same at the root, persistence, and test-like files."""
    p, name = norm_path(path), F.lower(base_name(path))
    support = (
        (name == "package.json")
        | like(name, r"^(\.env|env)[._-](example|sample|template)$")
        | like(name, r"^(pyproject\.toml|cargo\.toml|go\.mod|pom\.xml|composer\.json|gemfile|requirements(-dev)?\.txt)$")
        | like(name, r"^docker-compose(\.[^.]+)?\.ya?ml$")
    )
    stored = like(p, "(^|/)(db|database|storage|repository|repositories|persistence)(/|$)") & like(name, "(query|queries|repository|database|storage|schema|model|adapter)")
    return {
        "doc_support": support,
        "root_doc_support": support & (depth(path) == 1),
        "persistence": file_role.isin("repository", "db-schema", "store") | stored,
        "test_like": (file_role == "test") | has(p, *L.TEST_MARKS),
    }
