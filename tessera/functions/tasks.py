"""What a task text asks for: area, intents and safety, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .text import let

#: Words that the rules look for, in English and Russian. Fixed values.
GROUPS = {
    "surface": [
        "ui", "ux", "page", "screen", "component", "dashboard", "modal", "button", "layout", "style", "frontend",
        "интерфейс*", "страниц*", "компонент*", "дашборд*", "модал*", "кноп*", "верстк*", "стил*", "дизайн*", "фронтенд*",
    ],
    "server": [
        "endpoint", "backend", "server", "route", "service", "repository", "storage", "database", "schema", "api",
        "эндпоинт*", "бэкенд*", "бекенд*", "сервер*", "роут*", "сервис*", "хранилищ*", "репозитор*", "база", "схема", "апи",
    ],
    "server_side": ["backend", "server", "api", "бэкенд*", "бекенд*", "сервер*", "апи"],
    "client_side": ["frontend", "ui", "client", "фронтенд*", "интерфейс*", "клиент*"],
    "keep": [
        "do not touch", "don't touch", "do not change", "don't change", "keep", "avoid changing", "avoid modifying", "avoid touching",
        "without changing", "without modifying", "without touching", "must remain", "should remain", "remain", "remains", "stay", "stays",
        "unchanged", "untouched", "не трогай", "не меняй", "не изменяй", "без изменени*", "без правок",
    ],
    "review": [
        "do not edit", "don't edit", "no code changes", "review only", "analysis only", "suggest improvements",
        "код не меняй", "не редактируй", "без правок", "только анализ", "только review", "предложи улучшения", "посмотри ux",
    ],
    "papers": ["readme", "documentation", "doc", "docs", "setup guide", "документац*", "ридми", "инструкц*", "установка"],
    "test_kind": [
        "unit test", "unit tests", "integration test", "integration tests", "e2e test", "e2e tests", "smoke test", "smoke tests",
        "replay test", "replay tests", "regression test", "regression tests", "coverage", "assertion", "assertions", "test suite",
        "test case", "test cases", "test for", "tests for", "test of", "tests of", "тест для", "тесты для", "проверки для", "тесты на",
    ],
    "test": ["test", "tests", "тест", "тесты", "проверки"],
    "make": ["add", "write", "create", "implement", "update", "добавь", "напиши", "создай", "реализуй", "покрой"],
    "selector": [
        "selector", "scanner", "fallback", "scoring", "confidence", "safety policy", "context composer", "task pack builder",
        "file selection", "ядро", "селектор*", "сканер*", "фолбэк*", "скоринг*", "контекст композер", "выбор файлов",
    ],
    "fault": ["bug", "broken", "incorrect", "fail", "fails", "nan", "fix", "баг*", "ошиб*", "ломает*", "неверн*", "почини*"],
    "reshape": ["refactor", "cleanup", "restructure", "рефактор*", "без изменения логики"],
    "build": ["build", "tsconfig", "vite", "webpack", "compile", "bundl*", "config", "сборк*", "компиляц*", "конфиг*"],
    "secret_file": [
        ".env", ".env.*", "id_rsa", "id_dsa", "id_ed25519", "credentials.json", "service-account.json", "service_account.json", "*.pem",
        "*.key", "*.p12", "*.pfx",
    ],
    "secret_word": [
        "secret", "secrets", "token", "tokens", "api key", "api-key", "api_key", "apikey", "private key", "private-key", "private_key",
        "password", "credentials", "client secret", "client-secret", "client_secret", "database_url", "секрет*", "токен*", "ключ",
        "ключи", "ключа", "ключей", "ключом", "парол*", "учетн*", "учётн*",
    ],
    "expose": ["show", "print", "dump", "copy", "paste", "send", "expose", "leak", "покажи", "выведи", "скопируй", "отправь"],
    "touch_secret": ["read", "include", "pass", "add", "store", "save", "write", "commit", "прочитай", "добавь", "включи", "сохрани", "запиши"],
    "pack": ["task pack", "taskpack", "prompt", "agent", "codex", "claude", "cursor", "gemini", "агент*", "промпт*", "контекст*"],
    "never": [
        "do not", "don't", "never", "must not", "should not", "without adding", "without including", "without reading", "without showing",
        "without printing", "without copying", "without sending", "without exposing", "without leaking", "не", "никогда", "нельзя", "без секретов",
        "без токенов", "без ключей", "без паролей",
    ],
    "guard": [
        "mask*", "redact*", "sanitize*", "sanitise*", "scrub*", "detect*", "prevent*", "block*", "validat*", "test", "tests", "testing",
        "assert*", "маскир*", "редактир*", "санитиз*", "скрыт*", "обезлич*", "провер*", "тестир*", "блокир*",
    ],
    "session": [
        "auth", "authentication", "session", "jwt", "bearer", "expiry", "expiration", "validation", "verify", "verification", "refresh",
        "rotate", "revocation", "авторизац*", "аутентификац*", "сесси*", "срок*", "истеч*", "валидац*", "обнов*", "отзыв*",
    ],
    "token": ["token", "tokens", "токен*"],
    "made": [
        "node_modules/*", ".next/*", "dist/*", "build/*", "coverage/*", "out/*", "package-lock.json", "pnpm-lock.yaml", "yarn.lock",
    ],
    "change": ["fix", "change", "edit", "modify", "patch", "update", "create", "write", "add", "delete", "remove", "read", "include", "touch", "исправь", "измени", "обнови", "добавь", "удали"],
    "override": ["ignore", "disregard", "игнорируй", "забудь"],
    "prior": ["previous", "prior", "system", "developer", "user", "предыдущ*", "системн*", "пользовател*"],
    "orders": ["instruction", "instructions", "инструкц*"],
    "obey": ["follow", "obey", "execute", "apply", "следуй", "выполни", "примени"],
    "whatever": ["any instructions", "all instructions", "the instructions", "любые инструкции", "все инструкции"],
    "found_in": ["found", "written", "inside", "in", "from", "найден*", "из", "в"],
    "injection": ["prompt injection", "prompt-injection", "промпт-инъекц*", "промпт инъекц*"],
    "delete": ["delete", "remove", "wipe", "destroy", "удали*", "удаля*", "убери", "убрать", "сотри", "стереть", "уничтож*"],
    "wide": [
        "all", "everything", "project", "repo", "repository", "workspace", "server", "backend", "frontend", "source", "src", "files",
        "folder", "folders", "directory", "directories", "все", "всё", "весь", "проект*", "файлы", "репозитор*", "сервер*", "бэкенд*", "фронтенд*",
    ],
    "wipe": ["rm -rf", "del /s", "del /q", "rmdir /s"],
}
#: Names that look like secrets and are examples. Fixed values.
EXAMPLES = [".env.example", ".env.sample", ".env.template", "env.example", "example.env", "sample.env"]
#: Requested types that name an area outright. Fixed values.
REQUESTED = {
    "fullstack": ["fullstack", "full-stack"], "docs": ["docs", "documentation"], "tests": ["test", "tests", "testing"], "backend": ["backend", "server", "api"],
    "ui": ["ui", "ux", "frontend", "front-end"], "build": ["build", "config", "configuration"], "bugfix": ["bugfix", "bug-fix"], "refactor": ["refactor"],
}
#: An intent is there if its rule holds in a clause.
INTENTS = {
    "ui": [("surface",)],
    "backend": [("server",)],
    "backend_protected": [("keep", "server_side")],
    "frontend_protected": [("keep", "client_side")],
    "review_only": [("review",)],
    "docs": [("papers",)],
    "tests": [("test_kind",), ("make", "test")],
    "core": [("selector",)],
    "bugfix": [("fault",)],
    "refactor": [("reshape",)],
    "build": [("build",)],
}
#: The areas in the order of their rules: intents that must be there.
AREAS = [
    ("ui", "backend_protected", "ui"), ("backend", "frontend_protected", "backend"), ("review_only", "ui", "ui"), ("backend", "ui", "fullstack"),
    ("docs", "docs", "docs"), ("tests", "tests", "tests"), ("core", "core", "backend"), ("bugfix", "bugfix", "bugfix"), ("refactor", "refactor", "refactor"),
    ("backend", "backend", "backend"), ("build", "build", "build"), ("ui", "ui", "ui"),
]
#: A secret asked for, in one clause: its file whatever guards it; a secret word unless it is guarded, or is a token of
#: sessions that nobody is to see.
SECRET = [
    ("secret_file", "expose", R.NOT, "never"), ("secret_file", "touch_secret", R.NOT, "never"), ("secret_file", "pack", R.NOT, "never"),
    ("secret_word", "expose", R.NOT, "never", "guard"),
    ("secret_word", "touch_secret", R.NOT, "never", "guard", "session"), ("secret_word", "pack", R.NOT, "never", "guard", "session"),
    ("secret_word", "touch_secret", R.NOT, "never", "guard", "token"), ("secret_word", "pack", R.NOT, "never", "guard", "token"),
]
GENERATED = [("made", "change")]
INJECTION = [("override", "prior", "orders", R.NOT, "injection"), ("obey", "whatever", "found_in", R.NOT, "injection")]
DELETE = [("delete",)]
WIDE_DELETE = [("delete", "wide"), ("wipe",)]
#: A file named outright, as it stands between spaces.
NAMED = r" [^ ]*[a-z0-9_)\]-]\.[a-z]{1,6} "


def flags(task: Column) -> Column:
    """The intents of a task as a struct of booleans; its clauses are made once."""

    def some(cs: Column, rule) -> Column:
        return F.exists(cs, lambda c: R.holds(c, rule, GROUPS))

    return let(R.clauses(task), lambda cs: F.struct(*[some(cs, rule).alias(name) for name, rule in INTENTS.items()]))


def intents(task: Column) -> dict[str, Column]:
    found = flags(task)
    return {name: found[name] for name in INTENTS}


def area(task: Column, requested: Column) -> Column:
    """One of nine areas: what was requested, else protected scopes, mixed intents and then single ones, in order."""
    wish = F.lower(F.trim(requested))

    def ruled(i: Column) -> Column:
        out = F
        for name, words in REQUESTED.items():
            out = out.when(wish.isin(words), name)
        for one, other, name in AREAS:
            out = out.when(i[one] & i[other], name)
        return out.otherwise("general")

    return let(flags(task), ruled)


def safety(task: Column) -> Column:
    """The reasons why a task must be blocked: secrets asked for, generated files, overridden instructions, wide deletion.

    Files that only show what secrets look like are no secrets. A clause that deletes one named file, and says
    neither all nor everything, is no wide deletion.
    """

    def bare(clause: Column) -> Column:
        for name in EXAMPLES:
            clause = F.replace(clause, F.lit(f" {name} "), F.lit(" example "))
        return clause

    def one_file(clause: Column) -> Column:
        return (F.regexp_count(clause, F.lit(NAMED)) == 1) & ~R.has_any(clause, ["all", "everything", "все", "всё", "весь"])

    def parts(cs: Column) -> Column:
        some = lambda rule: F.exists(cs, lambda c: R.holds(c, rule, GROUPS))
        return F.struct(
            F.exists(cs, lambda c: R.holds(bare(c), SECRET, GROUPS)).alias("secret"), (some(GENERATED) & ~some(INTENTS["docs"])).alias("generated"),
            some(INJECTION).alias("injection"), some(DELETE).alias("delete"), F.exists(cs, lambda c: R.holds(c, WIDE_DELETE, GROUPS) & ~one_file(c)).alias("wide"),
        )

    def reasons(x: Column) -> Column:
        injection = x["injection"] & (x["delete"] | x["secret"] | x["generated"])
        found = [F.when(x["secret"], "secret"), F.when(x["generated"], "generated"), F.when(injection, "injection"), F.when(~injection & x["wide"], "destructive")]
        return F.array_compact(F.array(*found))

    return let(let(R.clauses(task), parts), reasons)
