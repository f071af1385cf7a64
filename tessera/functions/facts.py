"""Facts of source text by regular expressions: modules, declarations, routes, state, texts and keys.

Patterns are put together from lists of plain words; each has one group, the value. They hold for both Java's and
RE2's expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import by_table, let, quoted

#: Words of the language and of common libraries that facts hang on. Fixed values.
DECLARATIONS = ["function", "class", "const", "let", "var", "interface", "type", "enum", "namespace"]
TYPES = ["function", "class", "interface", "type", "enum"]
MODIFIERS = ["default", "declare", "abstract", "async"]
ROUTERS = ["router", "app"]
VERBS = ["get", "post", "put", "patch", "delete", "use"]
ROUTE_KEYS = ["path", "routePath"]
STATE_HOOKS = ["useState", "useReducer"]
STORES = ["createContext", "createStore", "configureStore"]
TRANSLATORS = ["t", "translate", "i18n.t"]
TRANSLATION_KEYS = ["labelKey", "descriptionKey", "titleKey", "translationKey"]

NAME = "[A-Za-z_$][A-Za-z0-9_$]*"
MARK = "[\"'`]"
TEXT = f"{MARK}([^\"'`]+){MARK}"
#: What may stand before a word that begins a name.
BEFORE = r"(?:^|[^A-Za-z0-9_$.])"


def _one_of(words: list[str]) -> str:
    return "(?:" + "|".join(w.replace(".", r"\.") for w in words) + ")"


def _call(names: str, argument: str = TEXT) -> str:
    return BEFORE + names + r"\s*\(\s*" + argument


def _after(words: str, name: str = f"({NAME})") -> str:
    return BEFORE + words + r"\s+" + name


#: Pattern of each kind of fact. Clauses of imports may be of any length.
PATTERNS = {
    # a module that an import clause, or an export of another module's names, takes its names from
    "import": BEFORE + r"import\s[^;\"'`]*?\sfrom\s+" + TEXT,
    "side_import": BEFORE + r"import\s+" + TEXT,
    "reexport": BEFORE + r"export\s[^;\"'`]*?\sfrom\s+" + TEXT,
    "dynamic_import": _call("import"),
    "require": _call("require"),
    "export": _after(r"export\s+(?:" + _one_of(MODIFIERS) + r"\s+)*" + _one_of(DECLARATIONS)),
    "export_list": BEFORE + r"export\s+(?:type\s+)?\{([^{}]*)\}",
    "symbol": _after(_one_of(TYPES)),
    "state": r"\[\s*(" + NAME + r")\s*,\s*" + NAME + r"\s*\]\s*=\s*(?:React\.)?" + _one_of(STATE_HOOKS),
    "store": _after("(?:const|let|var)", f"({NAME})" + r"\s*=\s*" + _one_of(STORES) + r"\s*[(<]"),
    "assignment": r"(?m)^\s*(" + NAME + r")\s*=[^=>]",
    "property": r"(?m)(?:^|[{,])[ \t]*(" + NAME + r")\??\s*:",
    "literal": MARK + "([^\"'`\\n]{2,220})" + MARK,
}


#: Facts that are quoted values behind a name and a sign: calls and keys.
QUOTED = {
    "route": ("(", [f"{r}.{v}" for r in ROUTERS for v in VERBS]), "route_key": (":", ROUTE_KEYS), "translation": ("(", TRANSLATORS), "translation_key": (":", TRANSLATION_KEYS),
}


def facts(content: Column) -> Column:
    """All facts of a text as an array of (kind, value, pos), each value once for its kind, in order."""

    def listed(kind: str, values: Column) -> Column:
        once = F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))
        return F.transform(once, lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), i.alias("pos")))

    def behind(found: Column, sign: str, names: list[str]) -> Column:
        own = F.filter(found, lambda x: (x["sign"] == sign) & F.substring_index(x["name"], "-", -1).isin(names))
        return F.transform(own, lambda x: x["value"])

    def named(found: Column) -> Column:
        return F.flatten(F.array(*[listed(k, behind(found, sign, names)) for k, (sign, names) in QUOTED.items()]))

    matched = F.flatten(F.array(*[listed(k, F.regexp_extract_all(content, F.lit(by_table(p)), 1)) for k, p in PATTERNS.items()]))
    return F.concat(matched, let(quoted(content), named))
