"""A task's context put together: anchors first, then files that support them, seat by seat within a budget.

A task's window of candidates is bounded, so what is chosen in turn is chosen within one row of a task. Candidates meet
edges by (project, anchor, candidate), three pairs at most for each candidate, never by an anchor alone.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import rules as R
from ..functions import text as X
from . import selection as S
from .lineage import cut

#: Words of a task that ask for something; * stands for the rest of a word. Fixed values.
SIGNALS = {
    "storage": ["database", "storage", "repository", "schema", "sqlite", "prisma", "query", "queries", "db", "баз*", "хранилищ*", "репозитор*", "схем*", "запрос*"],
    "types": ["type", "types", "interface", "interfaces", "contract", "payload", "dto", "тип", "типы", "интерфейс*", "контракт*", "пейлоад*"],
    "tests": ["test", "tests", "тест*", "проверки"],
    "config": ["config", "build", "deploy", "environment", "env", "sitemap", "robots", "vite", "tsconfig", "конфиг*", "сборк*", "деплой*", "окружен*", "робот*"],
    "docs": ["readme", "doc", "docs", "documentation", "ридми", "документац*"],
    "formula": ["formula", "calculation", "calculate", "calculator", "формул*", "расчет*", "расчёт*"],
    "input": ["input", "field", "form", "value", "validation", "invalid", "zero", "negative", "поле", "поля", "форм*", "значен*", "валидац*", "нулев*", "отриц*"],
    "appearance": ["appearance", "style", "theme", "visual", "backdrop", "density", "внешн*", "оформлен*", "стил*", "тема", "тему", "темы", "фон*", "плотност*"],
    "responsive": ["responsive", "breakpoint", "mobile", "adaptive", "адаптив*", "брейкпоинт*", "мобил*"],
    "navigation": ["navigation", "navbar", "header", "menu", "focus", "active state", "навигац*", "меню", "фокус*", "активн*"],
    "endpoint": ["endpoint", "route", "router", "handler", "api method", "эндпоинт*", "роут*", "маршрут*", "обработчик*"],
    "interaction": ["ux", "interaction", "control", "button", "dropdown", "select", "input", "form", "keyboard", "focus", "взаимодейств*", "контрол*", "кноп*", "дропдаун*", "селект*", "клавиатур*"],
    "data_flow": ["load", "loading", "fetch", "request", "response", "retry", "error state", "empty state", "async", "загруз*", "получен*", "ответ*", "повтор*", "ошибк*", "асинхрон*"],
    "security": ["auth", "authentication", "authorization", "token", "session", "credential", "permission", "expiry", "expiration", "авторизац*", "аутентификац*", "токен*", "сесси*", "разрешен*"],
    "migration": ["migrate", "migration", "migrations", "миграц*"],
    "relocation": ["move", "extract", "split", "deduplicate", "centralize", "вынес*", "перенес*", "раздел*"],
}
#: Roles by side and layer. Fixed values.
FRONTEND = ["page", "component", "ui-component", "layout", "style", "hook", "client-api", "app-entry"]
BACKEND = ["api-route", "service", "repository", "db-schema", "store", "types", "utility", "server-entry"]
ENTRY, LOGIC, PERSISTENCE = ["api-route", "server-entry"], ["service", "utility"], ["repository", "db-schema", "store"]
#: Which roles answer a signal. A file of such a role is meant by the task.
SERVES = {
    "storage": PERSISTENCE, "types": ["types"], "tests": ["test"], "config": ["config"], "docs": ["docs"], "appearance": ["style"], "responsive": ["style"],
    "navigation": ["layout"], "endpoint": ENTRY, "data_flow": ["hook", "client-api"],
}
#: What an edge from an anchor to a file weighs. Fixed values.
EDGE_POINTS = {
    "test-target": 9000, "proposed-test": 8500, "service-import": 8000, "utility-import": 7800, "storage-import": 7500, "types-import": 7200, "client-api-import": 7000,
    "hook-import": 6500, "component-import": 6000, "style-import": 5500, "route-local": 5000, "import": 4000, "imported-by": 3500,
}
#: Name parts that tell nothing of a file, and pieces of names of controls. Fixed values.
PLAIN_PARTS = ["controller", "service", "component", "route", "page", "index", "types"]
CONTROLS = ["input", "field", "slider", "select", "form", "card"]
MANIFESTS = ["package.json", "pyproject.toml", "cargo.toml", "go.mod", "pom.xml", "composer.json", "requirements.txt"]
ENV_EXAMPLES = [".env.example", ".env.sample", ".env.template", "env.example", "env.sample", "env.template"]
BUILD_NAMES = ["next", "vite", "webpack", "rollup", "tsconfig", "eslint", "postcss", "tailwind", "robots", "sitemap"]
#: How many supports a task of an area is given, and how many files that an anchor's edge leads to. Fixed values.
BUDGETS = {"fullstack": 4, "backend": 4, "tests": 4, "docs": 4, "build": 3, "bugfix": 3, "refactor": 3}
DIRECT = {"backend": 3, "fullstack": 3, "ui": 3, "tests": 3, "refactor": 2, "bugfix": 2, "build": 2}


def seat(want: str | list[str], unless: str | list[str] = (), given: str | list[str] = (), by: str = "support", cap: str = "limit") -> dict:
    """A seat for the first file in an order that has one of the traits; passed if a chosen file has one of ``unless``,
    or none has one of ``given``, or ``cap`` files are chosen."""
    as_list = lambda v: [v] if isinstance(v, str) else list(v)
    return {"want": as_list(want), "unless": as_list(unless), "given": as_list(given), "by": by, "cap": cap}


ORDERS = ["anchor", "support", "direct", "special"]
#: The seats of anchors, by area.
ANCHORS = {
    "review": [seat("fits", by="anchor")] * 3,
    "tests": [seat("named-test", by="anchor")] * 2 + [seat("test", "test", by="anchor")],
    "fullstack": [
        seat("known-entry", by="anchor"), seat("server-entry", "backend", by="anchor"), seat("entry", "backend", by="anchor"), seat("backend", "backend", by="anchor"),
        seat("sure-frontend", by="anchor"), seat("frontend", "frontend", by="anchor"), seat("second-frontend", by="anchor"),
    ],
    "ui": [seat("frontend", by="anchor")],
    "backend": [seat("asked-known-entry", by="anchor"), seat("asked-entry", "entry", by="anchor"), seat("asked-backend", ["asked-entry", "asked-known-entry"], by="anchor")],
    "docs": [seat("docs", by="anchor")],
    "build": [seat("build-topic", by="anchor")] * 3 + [seat("config", "config", by="anchor"), seat("source", "config", by="anchor")],
    "bugfix": [seat("plain-source", by="anchor"), seat("moved-source", by="anchor")],
    "refactor": [seat("plain-source", by="anchor"), seat("moved-source", by="anchor")],
    "general": [seat("fits", by="anchor")],
}
_SAID = [seat("said")]
_CARE = [seat("asked-style"), seat("asked-control"), seat("tied-surface")]
#: The seats of each area's layers.
COVERAGE = {
    "backend": [seat("logic", "logic"), seat("asked-persistence", "persistence"), seat("entry", "entry", "persistence"), seat("guard-config", "config")],
    "fullstack": [
        seat("backend", "backend"), seat("frontend", "frontend"), seat("client-api", "client-api"), seat("types", "types", by="special"), seat("persistence", by="special"), seat("guard-config", "config"),
    ],
    "ui": [seat(["hook", "client-api"]), seat("store"), seat(["types", "ui-component", "layout"]), seat("asked-layout"), seat("asked-control")],
    "tests": [seat("beside")] * 4 + [seat("tied-source"), seat("known-source"), seat(["tied-source", "known-source"])],
    "docs": [seat("env-example", by="special"), seat("root-manifest", by="special"), seat("manifest", "root-manifest", by="special"), seat("domain-source")] + [seat("config", by="special")] * 8,
    "build": [seat("config", by="special"), seat(["layout", "app-entry", "server-entry"], by="special"), seat("config", by="special")],
    "bugfix": _CARE, "refactor": _CARE, "general": [],
}


def seats_of(area: str) -> list[dict]:
    """The seats of an area's supports in turn: layers of server tasks before what the task says, others' behind."""
    early = area in ("backend", "fullstack")
    direct = [seat("direct", by="direct")] * DIRECT.get(area, 0)
    first = [seat("feature")] if area == "ui" else []
    controls = [seat("direct-control", by="direct")] * 2 if area == "ui" else []
    return (COVERAGE[area] if early else first) + _SAID + controls + direct + ([] if early else COVERAGE[area]) + [seat("fill", cap="soft")] * 8


def signals(task: Column) -> Column:
    """The names of the signals that a text gives."""
    return X.let(F.array_join(R.clauses(task), " "), lambda said: F.array_compact(F.array(*[F.when(R.has_any(said, words), name) for name, words in SIGNALS.items()])))


def _parts(path: Column) -> Column:
    """The parts of four characters or more of a file's name that tell something."""
    words = F.split(F.lower(X.camel_split(P.stem(P.base_name(path)), "a-z0-9")), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(PLAIN_PARTS)))


def _points(table: dict[str, int], value: Column, other: int = 0) -> Column:
    out = F
    for name, n in table.items():
        out = out.when(value == name, n)
    return out.otherwise(other)


def _facts(window: DataFrame, tasks: DataFrame) -> DataFrame:
    """Candidates with what a task says of them, and their anchor's priority."""
    asked = cut(tasks.select("task_id", F.lower("raw_task").alias("said"), F.coalesce("review_only", F.lit(False)).alias("review_only"), signals(F.col("raw_task")).alias("signals")))
    rows = window.join(asked, "task_id").withColumns({"low": F.lower("path"), "name": F.lower(F.substring_index("path", "/", -1)), "parts": _parts(F.col("path"))})
    signal = lambda s: F.array_contains("signals", s)
    at = F.array_min(F.filter(F.transform("parts", lambda p: F.instr(F.col("said"), p)), lambda n: n > 0))
    long = F.array_max(F.transform(F.filter("parts", lambda p: F.contains(F.col("said"), p)), lambda p: F.length(p)))
    role, area, kind = F.col("role"), F.col("area"), F.col("kind")
    served = [signal(s) & role.isin(roles) for s, roles in SERVES.items()]
    rows = rows.withColumns({
        "mention": F.when(at.isNotNull(), F.greatest(F.lit(4000), 30000 - 100 * (at - 1))).otherwise(0), "domain": F.when(long.isNotNull(), 18000 + F.least(F.lit(8000), 500 * long)).otherwise(0),
        "symbol": F.when(F.col("symbol_hits") > 0, F.when(F.length(F.regexp_replace(P.stem(F.col("name")), "[^a-z0-9]", "")) >= 9, 55000).otherwise(28000)).otherwise(0),
        "meant": P.any_of(served), "primary": S.usage(area, F.col("review_only")) == "inspect-and-edit",
        "front": kind.isin("source", "style", "test") & role.isin(FRONTEND), "back": kind.isin("source", "style", "test") & role.isin(BACKEND), "test": (kind == "test") | (role == "test"),
        "docs": (kind == "docs") | (role == "docs"), "config": (kind == "config") | (role == "config"), "like_source": kind.isin("source", "style", "test"),
    })
    named, met = F.col("explicit") > 0, (F.col("filename_hits") > 0) | (F.col("overlap") > 0)
    care = area.isin("bugfix", "refactor")
    fit = (
        F.when(area == "ui", F.when(role.isin(FRONTEND), 5000).when(role.isin("types", "utility"), 2500).otherwise(-2000))
        .when(area == "backend", F.when(role.isin(BACKEND), 5000).when(role.isin(FRONTEND), -2500).otherwise(0))
        .when(area == "fullstack", F.when(role.isin(FRONTEND + BACKEND), 4500).otherwise(0)).when(area == "tests", F.when(F.col("test"), 6000).otherwise(2000))
        .when(area == "docs", F.when(F.col("docs"), 6000).when(F.col("config"), 3500).otherwise(1000))
        .when(area == "build", F.when(F.col("config"), 6000).when(role.isin("app-entry", "server-entry") | (kind == "source"), 2500).otherwise(0))
        .when(care & (kind == "source"), 4000).otherwise(0)
    )
    lock = F.endswith("name", F.lit("lock")) | F.endswith("name", F.lit("lockb")) | (F.col("name") == "package-lock.json") | (F.col("name") == "pnpm-lock.yaml")
    builder = P.any_of([F.startswith("name", F.lit(b)) for b in BUILD_NAMES])
    depth = F.size(F.split("path", "/"))
    priority = (
        F.col("explicit") * 1_000_000 + F.col("filename_hits") * 30_000 + F.col("overlap") * 12_000 + F.col("meant").cast("int") * 18_000 + F.col("primary").cast("int") * 8_000
        + F.col("mention") + F.col("symbol") + fit + F.col("score") - F.when(~named & ~met, 4_000).otherwise(0) - F.when((role == "page") & ~met, 8_000).otherwise(0)
        - F.when(care & (role == "types") & ~signal("types") & ~named, 42_000).otherwise(0) - F.when(care & (role == "app-entry") & (F.col("filename_hits") == 0) & ~named, 14_000).otherwise(0)
        + F.when(care & (role == "utility"), 14_000).otherwise(0)
        + F.when((area == "build") & F.col("config"), 25_000 + F.when(builder, 18_000).otherwise(0) + F.when(F.col("name") == "package.json", F.when(depth <= 2, 12_000).otherwise(5_000)).otherwise(0) - F.when(lock, 30_000).otherwise(0)).otherwise(0)
    )
    fits = (
        F.when(area == "ui", F.col("front")).when(area == "backend", F.col("back")).when(area == "fullstack", F.col("front") | F.col("back")).when(area == "tests", F.col("test"))
        .when(area == "docs", F.col("docs")).when(area == "build", F.col("config") | role.isin("app-entry", "server-entry", "layout")).otherwise(F.col("like_source"))
    )
    known = named | met | F.col("meant") | (F.col("symbol") > 0)
    return rows.withColumns({"priority": priority.cast("long"), "known": known, "fits": fits & known, "lock": lock, "builder": builder, "depth": depth, "named": named, "met": met})


def _traits(pairs: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in pairs.items()]))


_SEAT = "want:array<string>,unless:array<string>,given:array<string>,by:int,soft:boolean"


def _choose(rows: DataFrame, seats: dict[str, list[dict]], key: Column, chosen: Column | None = None) -> DataFrame:
    """Rows of a task with ``files`` (array of path, traits and places in each order) and their ``picked`` paths in turn.

    Each seat takes the first file of its order that fits and is not chosen. A task has some dozens of files and seats.
    """
    # one constant for all areas: a table of literals would take thousands of calls to build
    plain = {name: [{**s, "by": ORDERS.index(s["by"]), "soft": s["cap"] == "soft"} for s in own] for name, own in seats.items()}
    table = F.element_at(F.from_json(F.lit(json.dumps(plain)), f"map<string,array<struct<{_SEAT}>>>"), key)

    def take(picked: Column, s: Column) -> Column:
        has = lambda x, names: F.arrays_overlap(x["traits"], names)
        held = F.filter("files", lambda x: F.array_contains(picked, x["path"]))
        passed = F.exists(held, lambda x: has(x, s["unless"])) | ((F.size(s["given"]) > 0) & ~F.exists(held, lambda x: has(x, s["given"])))
        passed = passed | (F.size(picked) >= F.when(s["soft"], F.col("soft")).otherwise(F.col("limit")))
        fitting = F.filter("files", lambda x: has(x, s["want"]) & ~F.array_contains(picked, x["path"]))
        first = F.array_min(F.transform(fitting, lambda x: F.struct(F.get(x["places"], s["by"]).alias("place"), x["path"].alias("path"))))
        return F.when(passed | first.isNull(), picked).otherwise(F.concat(picked, F.array(first["path"])))

    start = F.array().cast("array<string>") if chosen is None else chosen
    return rows.withColumn("picked", F.aggregate(table, start, take))


def _places(rows: DataFrame, orders: dict[str, list]) -> DataFrame:
    ranks = {f"by_{name}": F.row_number().over(Window.partitionBy("task_id").orderBy(*order)) for name, order in orders.items()}
    return rows.withColumns(ranks)


def assemble(window: DataFrame, tasks: DataFrame, edges: DataFrame, limits: dict[str, int] = S.AREA_LIMITS, usual: int = 12) -> DataFrame:
    """(task_id, project_id, path, part, evidence, retention, pos): the context of each task with an anchor.

    ``window``: of ``selection.window``, a bounded number of candidates a task; ``tasks``: (task_id, raw_task,
    review_only); ``edges``: (project_id, src, dst, kind). An area has seats for anchors and for the layers its tasks
    need; files that an anchor's edges lead to, or that the task names, follow, then the best of the rest. What is
    chosen stays as it is ``protected`` (area, role, edges, the task's words, or a score of 72 and 0.42 times the best
    anchor's) up to two more than the area's budget, or ``optional`` with evidence of 32 within the budget; the rest is
    ``pruned`` and has no ``pos``. Ties go by path. Tasks without an anchor have no rows; null texts give no signals.

    Shared tokens stand for matches of a file's identity, the roles that serve a signal for role intents.
    """
    area, role, kind = F.col("area"), F.col("role"), F.col("kind")
    limit = _points(limits, area, usual)
    facts = cut(_facts(window, tasks))
    signal = lambda s: F.array_contains("signals", s)
    twice = (F.col("filename_hits") >= 2) | (F.col("overlap") >= 2)
    entry, front, back, fits = role.isin(ENTRY), F.col("front"), F.col("back"), F.col("fits")
    plain = fits & (kind == "source") & (role != "types")
    asked_back = fits & back & (signal("types") | (role != "types"))
    config_topic = P.any_of([F.col("mention") > 0, (F.col("name") == "package.json") & (F.col("depth") <= 2) & signal("config")])
    anchor_traits = {
        "fits": fits, "test": fits & F.col("test"), "named-test": fits & F.col("test") & F.col("named"), "known-entry": fits & back & entry & (F.col("named") | F.col("met") | (F.col("mention") > 0)),
        "server-entry": fits & back & (role == "server-entry"), "entry": fits & back & entry, "backend": fits & back, "frontend": fits & front,
        "sure-frontend": fits & front & (F.col("named") | twice | (F.col("symbol") > 0)), "second-frontend": fits & front & F.col("primary") & (F.col("named") | twice),
        "asked-known-entry": asked_back & entry & signal("endpoint") & (F.col("named") | F.col("met") | (F.col("mention") > 0)), "asked-entry": asked_back & entry & signal("endpoint"), "asked-backend": asked_back,
        "docs": fits & F.col("docs"), "build-topic": fits & F.col("config") & config_topic, "config": fits & F.col("config"), "source": F.col("known") & (kind == "source"),
        "plain-source": plain, "moved-source": plain & signal("relocation"),
    }
    graded = _places(facts.withColumn("traits", _traits(anchor_traits)), {"anchor": [F.desc("priority"), F.desc("score"), "path"]})
    one = F.struct("path", "traits", F.array("by_anchor").alias("places"))
    grouped = graded.groupBy("task_id").agg(F.collect_list(one).alias("files"), F.first("area").alias("area"), F.first("review_only").alias("review_only"))
    grouped = grouped.withColumns({"limit": limit, "soft": limit})
    anchored = _choose(grouped, ANCHORS, F.when(F.col("review_only"), "review").otherwise(area)).filter(F.size("picked") > 0)
    anchors = cut(anchored.select("task_id", F.col("picked").alias("anchors")))

    rows = facts.join(anchors, "task_id")
    pairs = rows.select("task_id", "project_id", F.col("path").alias("other"), F.explode("anchors").alias("anchor")).filter("other <> anchor")
    links = edges.filter("src <> dst").select("project_id", "src", "dst", _points(EDGE_POINTS, F.col("kind"), 3000).alias("points"))
    links = links.groupBy("project_id", "src", "dst").agg(F.max("points").alias("points"), F.min("points").alias("least"))
    out = pairs.join(links.withColumnsRenamed({"src": "anchor", "dst": "other"}), ["project_id", "anchor", "other"]).select("task_id", "other", "points", "least", F.lit(0).alias("near"))
    back_to = pairs.join(links.withColumnsRenamed({"src": "other", "dst": "anchor"}), ["project_id", "anchor", "other"]).select("task_id", "other", F.lit(0).alias("points"), F.lit(None).cast("int").alias("least"), F.lit(1).alias("near"))
    tied = out.unionByName(back_to).groupBy("task_id", F.col("other").alias("path")).agg(F.max("points").alias("relation"), F.max("near").alias("near"))
    rows = rows.join(tied, ["task_id", "path"], "left").na.fill(0, ["relation", "near"])

    folder = P.directory(F.col("low"))
    homes = F.transform("anchors", lambda a: P.directory(F.lower(a)))
    space = lambda p: F.coalesce(P.workspace_root(p), F.lit(""))
    same_space = F.exists("anchors", lambda a: (space(F.col("low")) != "") & (space(F.lower(a)) == space(F.col("low"))))
    same_folder = (folder != "") & F.array_contains(homes, folder)
    shared = F.array_max(F.transform("anchors", lambda a: X.shared_prefix_depth(F.col("low"), F.lower(a))))
    theirs = F.flatten(F.transform("anchors", _parts))
    alike = F.exists("parts", lambda p: F.exists(theirs, lambda q: F.startswith(p, q) | F.startswith(q, p)))
    rows = cut(rows.withColumns({
        "affinity": F.when(F.arrays_overlap("parts", theirs), 7000).when(alike, 4500).otherwise(0), "same_folder": same_folder, "same_space": same_space,
        "nearby": F.greatest(F.when(same_folder, 3000).otherwise(0), F.when(same_space, 1500).otherwise(0), shared * 250), "is_anchor": F.array_contains("anchors", F.col("path")),
    }))

    strong = F.col("relation") > EDGE_POINTS["imported-by"]
    control = role.isin("component", "ui-component") & P.any_of([F.contains("name", F.lit(c)) for c in CONTROLS])
    shown = signal("appearance") | signal("responsive")
    server = area.isin("backend", "fullstack")
    guard = signal("security") & F.col("config") & (F.col("same_folder") | F.col("same_space"))
    bonus = (
        F.when(role.isin(LOGIC), 2500).otherwise(0) + F.when(role.isin(PERSISTENCE), F.when(signal("storage"), 4000).otherwise(1200)).otherwise(0)
        + F.when(role == "types", F.when(signal("types"), 3500).otherwise(1800)).otherwise(0) + F.when(role == "client-api", F.when(area.isin("fullstack", "ui"), 3500).otherwise(500)).otherwise(0)
        + F.when((role == "hook") & (area == "ui"), 2800).otherwise(0) + F.when((role == "layout") & area.isin("ui", "build"), 2300).otherwise(0) + F.when((role == "style") & shown, 3200).otherwise(0)
        + F.when(control & signal("input"), 4500).otherwise(0) + F.when(F.col("config"), F.when(signal("config") | (area == "docs"), 2500).otherwise(300)).otherwise(0)
        + F.when(F.col("test"), F.when(signal("tests"), 2500).otherwise(-2000)).otherwise(0)
    )
    support = (
        F.col("explicit") * 100_000 + F.col("relation") + F.col("filename_hits") * 7_000 + F.col("overlap") * 3_000 + bonus + F.col("nearby") + F.col("score")
        - F.when((role == "page") & (F.col("relation") == 0) & ~F.col("met"), 10_000).otherwise(0)
    )
    manifest = F.col("name").isin(MANIFESTS)
    inner = F.slice(F.split("low", "[/.]"), 1, F.size(F.split("low", "[/.]")))
    layer = F.when(F.arrays_overlap(inner, X.strings("query", "queries", "repository", "repositories")), 7_000).when(F.arrays_overlap(inner, X.strings("database", "storage", "schema")), 2_500).when(F.arrays_overlap(inner, X.strings("migrate", "migration", "migrations")), -5_000).otherwise(0)
    special = (
        F.when(area == "docs", F.when(F.col("name") == "package.json", F.when(F.col("depth") <= 2, 10_000).otherwise(6_000)).when(F.col("name").isin(ENV_EXAMPLES), 12_000).when(manifest, 6_500).otherwise(0) - F.when(F.col("lock"), 8_000).otherwise(0) + F.greatest(F.lit(0), 3_000 - 300 * F.col("depth")) + F.col("nearby"))
        .when(area == "build", F.col("support") + F.when(F.col("builder"), 12_000).otherwise(0) + F.when(F.col("name") == "package.json", 8_000).otherwise(0) - F.when(F.col("lock"), 15_000).otherwise(0) + F.greatest(F.lit(0), 3_000 - 250 * F.col("depth")) + F.when(F.col("mention") > 0, 8_000).otherwise(0))
        .otherwise(F.when(role == "types", F.col("affinity")).otherwise(layer))
    )
    said = F.greatest("mention", "symbol", "domain") > 0
    tied_now = F.col("relation") > 0
    allowed = (
        F.when(area == "backend", back).when(area == "fullstack", back | front).when(area == "ui", front | role.isin("types", "store", "utility")).when(area == "tests", ~F.col("docs") & ~F.col("config"))
        .when(area == "build", F.col("config") | role.isin("layout", "app-entry", "server-entry")).when(area.isin("refactor", "bugfix"), kind.isin("source", "style")).otherwise(F.lit(False))
    )
    fill = (
        ~((area == "ui") & (F.col("docs") | F.col("config"))) & (tied_now | F.col("known") | (area.isin("docs", "build") & F.col("config")) | (F.col("support") >= 5_500))
        & ~((role == "page") & ~tied_now & ~F.col("named") & (F.col("filename_hits") == 0) & (F.col("overlap") < 2))
    )
    support_traits = {
        **{r: role == r for r in ["hook", "client-api", "store", "types", "ui-component", "layout", "app-entry", "server-entry"]},
        "test": F.col("test"), "config": F.col("config"), "backend": back, "frontend": front, "entry": entry, "logic": role.isin(LOGIC), "persistence": role.isin(PERSISTENCE),
        "asked-persistence": role.isin(PERSISTENCE) & signal("storage"), "guard-config": signal("security") & F.col("config") & F.col("same_space"),
        "asked-layout": (role == "layout") & signal("navigation"), "asked-control": control & signal("input"), "asked-style": (role == "style") & shown,
        "tied-surface": role.isin("page", "component", "ui-component", "style", "hook", "utility") & (tied_now | F.col("known")),
        "beside": ~F.col("test") & (kind == "source") & F.col("same_folder"), "tied-source": ~F.col("test") & tied_now, "known-source": ~F.col("test") & F.col("known"),
        "env-example": F.col("config") & F.col("name").isin(ENV_EXAMPLES), "root-manifest": F.col("config") & manifest & (F.col("depth") <= 2), "manifest": F.col("config") & manifest,
        "domain-source": (signal("formula") | signal("input") | shown) & ~F.col("docs") & ~F.col("config") & (kind == "source") & (F.col("met") | (role == "utility") | (F.col("symbol") > 0)),
        "feature": role.isin("component", "ui-component", "hook", "store", "types", "utility") & (F.col("same_space") | tied_now) & (F.col("domain") > 0),
        "said": (tied_now | F.col("known")) & (F.greatest("mention", "symbol") > 0), "direct": tied_now & allowed,
        "direct-control": tied_now & allowed & control & (signal("interaction") | signal("navigation") | signal("input")), "fill": fill,
    }
    rows = rows.withColumn("support", support.cast("long")).withColumn("special", special.cast("long")).withColumn("traits", _traits(support_traits))
    rows = cut(_places(rows, {
        "support": [F.desc("support"), F.desc("score"), "path"], "direct": [F.desc("affinity"), F.desc("relation"), F.desc("support"), "path"], "special": [F.desc("special"), F.desc("support"), "path"],
    }))
    two = F.struct("path", "traits", F.array(F.lit(0), "by_support", "by_direct", "by_special").alias("places"))
    grouped = rows.groupBy("task_id").agg(F.collect_list(two).alias("files"), F.first("area").alias("area"), F.first("review_only").alias("review_only"), F.first("anchors").alias("anchors"))
    grouped = grouped.withColumns({"limit": limit, "soft": F.least(limit, F.when(F.col("review_only"), 5).when(area == "fullstack", 8).otherwise(7))})
    chosen = _choose(grouped, {a: seats_of(a) for a in COVERAGE}, area, F.col("anchors"))
    picked = chosen.select("task_id", "limit", F.posexplode("picked").alias("turn", "path"), F.size("anchors").alias("n_anchors"))

    evidence = (
        F.col("explicit") * 100 + F.when(F.col("filename_hits") > 0, 32).otherwise(0) + F.least(F.lit(30), 12 * F.col("overlap")) + F.when(F.col("meant"), 25).otherwise(0) + F.when(F.col("mention") > 0, 45).otherwise(0)
        + F.when(F.col("symbol") > 0, 55).otherwise(0) + F.when(F.col("domain") > 0, 35).otherwise(0) + F.when(F.col("affinity") > 0, 28).otherwise(0) + F.when(strong, 100).when(tied_now, 12).otherwise(0)
        + F.when((area == "docs") & (F.col("config") | F.col("docs")), 35).otherwise(0) + F.when((area == "build") & F.col("config"), 35).otherwise(0) + F.when((area == "tests") & (F.col("name") == "package.json"), 25).otherwise(0)
        + F.when(signal("types") & (role == "types"), 25).otherwise(0) + F.when(signal("storage") & role.isin(PERSISTENCE), 25).otherwise(0) + F.when(signal("endpoint") & entry, 25).otherwise(0)
        + F.when(server & (role == "server-entry"), 48).otherwise(0) + F.when((area == "fullstack") & (role == "client-api"), 90).otherwise(0) + F.when(server & role.isin(PERSISTENCE), 48).otherwise(0)
        + F.when(signal("data_flow") & role.isin("hook", "client-api", "service", "api-route"), 22).otherwise(0) + F.when(shown & (role == "style"), 30).otherwise(0)
        + F.when(signal("input") & role.isin("component", "ui-component"), 20).otherwise(0) + F.when(signal("navigation") & role.isin("layout", "component", "ui-component"), 48).otherwise(0) + F.when(guard, 48).otherwise(0)
        - F.when(tied_now & ~strong & ~(signal("navigation") & (role == "layout")) & (F.col("affinity") == 0) & (F.col("domain") == 0), 35).otherwise(0)
        - F.when((role == "page") & ~tied_now & ~F.col("named"), F.when(F.col("met"), 55).otherwise(100)).otherwise(0) - F.when((area == "ui") & role.isin(BACKEND) & ~tied_now & ~F.col("named"), 100).otherwise(0)
        - F.when(F.arrays_overlap(inner, X.strings("migrate", "migration", "migrations")) & ~signal("migration"), 80).otherwise(0)
    )
    role_points = F.greatest(
        F.when((area == "fullstack") & role.isin("client-api", *PERSISTENCE), 8_500).otherwise(0), F.when((area == "backend") & signal("endpoint") & (role == "client-api"), 8_000).otherwise(0),
        F.when((area == "ui") & (signal("interaction") | signal("input")) & control, 8_500).otherwise(0), F.when((area == "ui") & signal("data_flow") & role.isin("hook", "client-api", "store", "types"), 8_000).otherwise(0),
        F.when(area.isin("bugfix", "refactor") & ((shown & (role == "style")) | (signal("input") & control)), 8_500).otherwise(0), F.when(guard, 9_000).otherwise(0),
    )
    close = (F.col("near") > 0) | strong
    retention = (
        F.col("explicit") * 100_000 + F.when(said, 90_000).otherwise(0) + role_points * 8 + F.when(strong, 65_000).otherwise(0) + F.when(close, 42_000).otherwise(0)
        + F.col("filename_hits") * 8_000 + F.col("overlap") * 3_000 + F.when(F.col("meant"), 4_000).otherwise(0) + F.col("score")
    )
    stays_in_area = (
        F.when(area == "ui", front | role.isin("types", "store", "utility")).when(area == "backend", back | (signal("endpoint") & (role == "client-api")) | guard)
        .when(area == "fullstack", front | back | (role == "types") | guard).when(area == "tests", F.col("test") | F.col("like_source")).when(area == "docs", F.col("docs") | F.col("config") | F.col("like_source"))
        .when(area == "build", F.col("config") | role.isin("layout", "app-entry", "server-entry")).when(area.isin("bugfix", "refactor"), kind.isin("source", "style")).otherwise(F.col("like_source"))
    )
    best = F.max(F.when(F.col("is_anchor"), F.col("score"))).over(Window.partitionBy("task_id"))
    scored = rows.withColumns({"evidence": evidence.cast("long"), "retention": retention.cast("long"), "floor": F.greatest(F.lit(72.0), 0.42 * best)}).withColumn("role_points", role_points)
    by_floor = (F.col("evidence") >= 32) | (F.col("score") >= F.col("floor"))
    kept = (
        F.when(F.col("named"), True).when(~stays_in_area, False).when((role == "page") & ~said & ~strong, F.col("evidence") >= 52)
        .when(said | (F.col("role_points") > 0) | close | ((area == "ui") & role.isin("store", "types") & (F.col("affinity") > 0)), True).otherwise(by_floor)
    )
    scored = scored.withColumn("safe", kept).select("task_id", "project_id", "path", "area", "is_anchor", "signals", "review_only", "evidence", "retention", "support", "safe").join(picked, ["task_id", "path"])
    budget = _points(BUDGETS, area, 2)
    budget = F.when((area == "ui") & F.arrays_overlap("signals", X.strings("navigation", "input", "appearance", "responsive", "data_flow")), 3).otherwise(budget)
    budget = F.when(F.col("review_only"), F.least(budget, F.lit(3))).otherwise(budget)
    soft = F.greatest(F.lit(0), F.least(F.col("limit"), F.col("n_anchors") + budget) - F.col("n_anchors"))
    most = F.least(F.greatest(F.lit(0), F.col("limit") - F.col("n_anchors")), soft + 2)
    first = Window.partitionBy("task_id").orderBy(F.when(~F.col("is_anchor") & F.col("safe"), 0).otherwise(1), F.desc("retention"), F.desc("evidence"), F.desc("support"), "turn")
    scored = scored.withColumn("protected", ~F.col("is_anchor") & F.col("safe") & (F.row_number().over(first) <= most))
    n_protected = F.count_if("protected").over(Window.partitionBy("task_id"))
    open_ = ~F.col("is_anchor") & ~F.col("protected") & (F.col("evidence") >= 32)
    second = Window.partitionBy("task_id").orderBy(F.when(open_, 0).otherwise(1), F.desc("evidence"), F.desc("support"), "turn")
    optional = open_ & (F.row_number().over(second) <= F.greatest(F.lit(0), soft - n_protected))
    scored = scored.withColumn("part", F.when(F.col("is_anchor"), "anchor").when(F.col("protected"), "protected").when(optional, "optional").otherwise("pruned"))
    stays = F.col("part") != "pruned"
    pos = F.when(stays, F.row_number().over(Window.partitionBy("task_id").orderBy(F.when(stays, 0).otherwise(1), "turn")))
    return scored.select("task_id", "project_id", "path", "part", "evidence", "retention", pos.alias("pos"))
