"""Module statements of source texts: which names a file takes from other modules, and which it hands on.

Texts are cut into statements by expressions alone: comments go first (strings are kept, so that ``//`` within one
stands), then each import and each export that names a module is found where a statement can begin, and its clause is
taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import by_table, let

NAME = by_table("[A-Za-z_$][A-Za-z0-9_$]*")
_PLAIN = "\"[^\"\\n]*\"|'[^'\\n]*'"
_STRINGS = _PLAIN + "|`[^`]*`"
_COMMENTS = r"//[^\n]*|/\*[\s\S]*?\*/"
_STARTS = r"(?:^|[;{}\n])\s*"
_QUOTED = "[\"'][^\"'\\n]+[\"']"
#: An import with a clause, one for its side effects, and an export of another module's names.
STATEMENT = (
    _STARTS + r"(import(?:\s+type\s+|\s+|(?=[{*]))[^;\"'`]*?[\s}]from\s*" + _QUOTED
    + r"|import\s*" + _QUOTED + r"|export\s*(?:type\s*)?\{[^{}]*\}\s*from\s*" + _QUOTED + ")"
)
#: Modules that are asked for by a call or from a style sheet.
CALLS = by_table(r"(?:^|[^A-Za-z0-9_$.])(?:require|import)\s*\(\s*[\"'`]([^\"'`\n]+)[\"'`]\s*\)")
STYLES = r"@import\s+(?:url\()?[\"'`]([^\"'`\n]+)[\"'`]"

BINDING = "struct<imported:string,local:string,kind:string,type_only:boolean>"


def without_comments(content: Column) -> Column:
    return F.regexp_replace(content, f"({_STRINGS})|{_COMMENTS}", "$1")


def statements(content: Column) -> Column:
    """The import statements, and the exports from other modules, of a text, in order; none from template strings."""
    return F.regexp_extract_all(F.regexp_replace(content, f"({_PLAIN})|`[^`]*`|{_COMMENTS}", "$1"), F.lit(STATEMENT), 1)


def module_of(statement: Column) -> Column:
    return F.regexp_extract(statement, "[\"']([^\"'\\n]+)[\"']$", 1)


def is_name(text: Column) -> Column:
    return F.rlike(text, F.lit(f"^{NAME}$"))


def _binding(imported: Column, local: Column, kind: str, type_only: Column) -> Column:
    return F.struct(imported.alias("imported"), local.alias("local"), F.lit(kind).alias("kind"), type_only.alias("type_only"))


def _named(body: Column, kind: str, type_only: Column) -> Column:
    """The bindings between braces: ``a``, ``a as b``, ``type a``; what is no name is left out."""

    def one(part: Column) -> Column:
        typed = F.rlike(part, F.lit(r"^type\s"))
        ends = F.split(F.trim(F.when(typed, F.regexp_replace(part, r"^type\s+", "")).otherwise(part)), r"\s+[aA][sS]\s+")
        return _binding(ends[0], F.coalesce(F.get(ends, 1), ends[0]), kind, typed | type_only)

    parts = F.filter(F.transform(F.split(body, ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return F.filter(F.transform(parts, one), lambda b: is_name(b["imported"]) & is_name(b["local"]))


def bindings_of(statement: Column) -> Column:
    """The names that a statement binds, as an array of (imported, local, kind, type_only).

    kind: named, namespace (imported ``*``), default (imported ``default``) or reexport (``local`` is the exported
    name). A side-effect import binds nothing.
    """
    none = F.array().cast(f"array<{BINDING}>")
    head = F.regexp_replace(statement, "\\s*from\\s*" + _QUOTED + "$", "")
    is_export = F.startswith(statement, F.lit("export"))
    bare = F.rlike(statement, F.lit("^import\\s*[\"']"))

    def bound(whole: Column) -> Column:
        typed = F.rlike(whole, F.lit(r"^type(?:\s+[^\s,]|\s*\{)"))
        return let(F.when(typed, F.regexp_replace(whole, r"^type\s*", "")).otherwise(whole), lambda clause: taken(clause, typed))

    def taken(clause: Column, typed: Column) -> Column:
        body = F.regexp_extract(clause, r"\{([^{}]*)\}", 1)
        space = F.regexp_extract(clause, rf"\*\s+as\s+({NAME})", 1)
        rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(clause, r"\{[^{}]*\}", ""), rf"\*\s+as\s+{NAME}", ""), r"^\s+|[\s,]+$", "")
        imported = F.concat(
            _named(body, "named", typed),
            let(space, lambda x: F.when(x != "", F.array(_binding(F.lit("*"), x, "namespace", typed))).otherwise(none)),
            let(rest, lambda x: F.when(is_name(x), F.array(_binding(F.lit("default"), x, "default", typed))).otherwise(none)),
        )
        return F.when(bare, none).when(is_export, _named(body, "reexport", typed)).otherwise(imported)

    return let(F.regexp_replace(F.regexp_replace(head, "^(?:import|export)\\s*", ""), r"\s+$", ""), bound)


def identifiers(content: Column) -> Column:
    """The distinct identifiers of a text without its comments and strings, in order."""
    plain = F.regexp_replace(content, f"{_STRINGS}|{_COMMENTS}", " ")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(f"({NAME})"), 1))
