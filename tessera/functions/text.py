"""Text functions as column expressions: tokenizers, extraction, redaction, previews, snippets and scores."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups as L

LETTER = r"[^\p{L}\p{N}]+"
#: Prefixes of task words and what they stand for besides themselves. Fixed values.
ALIASES = {
    "главн": ["home", "landing"], "документ": ["docs", "documentation"], "настро": ["settings"],
    "хранилищ": ["storage", "database", "db"], "баз": ["storage", "database", "db"], "навигац": ["navigation", "nav", "header", "menu"],
    "мобил": ["mobile", "responsive", "breakpoint"], "адаптив": ["mobile", "responsive", "breakpoint"], "форм": ["form"],
    "вход": ["login", "auth", "authentication"], "авторизац": ["auth", "authentication"], "аутентификац": ["auth", "authentication"],
    "подключ": ["connection", "integration"], "репозитор": ["repository"], "сопостав": ["mapping"], "мапп": ["mapping"],
    "словар": ["dictionary", "dictionaries"], "сводн": ["summary", "status"], "библиотек": ["library"], "сортир": ["sort", "sorting"],
    "карточ": ["card", "cards"], "заказ": ["order", "orders"], "сохран": ["save", "persist", "persistence", "storage"],
    "расчет": ["calculation", "calculate", "calculator"], "расчёт": ["calculation", "calculate", "calculator"],
    "нулев": ["zero", "invalid"], "отриц": ["negative", "invalid"], "брейкпоинт": ["breakpoint", "responsive"],
    "формул": ["formula", "calculation"], "фильтр": ["filter", "filtering"], "зависим": ["dependency", "dependencies"],
    "очеред": ["queue", "queues"], "каталог": ["catalog"], "валидац": ["validation", "validate"],
    "оформлен": ["appearance", "style", "theme"], "внешн": ["appearance", "style", "theme"], "глобальн": ["global"], "анализ": ["analysis"],
}
#: Whole words and what they stand for besides themselves. Fixed values.
SYNONYMS = {
    "navigation": ["nav", "header", "menu"], "authentication": ["auth"], "calculation": ["calculate"], "calculator": ["calculate"],
    "responsive": ["breakpoint", "mobile"], "appearance": ["theme", "style"], "pull": ["pr"],
}


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def by_table(pattern: str) -> str:
    """``pattern`` with the ranges of its classes of ASCII letters and digits written out, for Java's expressions.

    The same classes, but Java looks such a one up in a table, where it tries a union of ranges one by one.
    """
    return pattern.replace("A-Za-z", string.ascii_letters).replace("0-9", string.digits)


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def camel_split(text: Column, left: str = "a-z") -> Column:
    return F.regexp_replace(text, f"([{left}])([A-Z])", "$1 $2")


def tokenize_hints(text: Column) -> Column:
    """Hint tokens in order, repeats kept: camel case split, 3 to 32 letters or digits, no stop words, no numbers."""
    words = F.split(F.lower(camel_split(text)), "[^a-zа-яё0-9]+")
    return F.filter(words, lambda w: F.length(w).between(3, 32) & ~w.isin(L.HINT_STOP_WORDS) & ~F.rlike(w, F.lit("^[0-9]+$")))


def expand_tokens(token: Column) -> Column:
    """A task token and its variants: aliases of its prefix, singular, gerund and synonyms."""
    more = [F.array(token)]
    for prefix, names in ALIASES.items():
        more.append(F.when(F.startswith(token, F.lit(prefix)), strings(*names)).otherwise(strings()))
    ascii_word = F.rlike(token, F.lit("^[a-z0-9]+$"))
    n = F.length(token)

    def cut(test: Column, value: Column) -> Column:
        return F.when(ascii_word & test, F.array(value)).otherwise(strings())

    more.append(cut(F.endswith(token, F.lit("ies")) & (n > 4), F.concat(F.left(token, n - 3), F.lit("y"))))
    more.append(cut(F.endswith(token, F.lit("s")) & ~F.endswith(token, F.lit("ss")) & (n > 4), F.left(token, n - 1)))
    more.append(cut(F.endswith(token, F.lit("ing")) & (n > 6), F.left(token, n - 3)))
    for word, names in SYNONYMS.items():
        more.append(F.when(token == word, strings(*names)).otherwise(strings()))
    return F.array_distinct(F.flatten(F.array(*more)))


def task_words(text: Column) -> Column:
    """Distinct task tokens before expansion: camel case and ``_-`` split, 3 letters or more, no stop words."""
    plain = F.lower(F.trim(F.regexp_replace(camel_split(text, "a-z0-9"), "[_-]+", " ")))
    return F.array_distinct(F.filter(F.split(plain, r"[^\p{L}\p{N}_-]+"), lambda w: (F.length(w) >= 3) & ~w.isin(L.TASK_STOP_WORDS)))


def tokenize_task(text: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(task_words(text), expand_tokens)))


def canonical_symbol(name: Column) -> Column:
    """The parts of an identifier of two letters or more that are no stop words, in lower case, joined."""
    parts = F.split(F.lower(camel_split(name, "a-z0-9")), LETTER)
    return F.array_join(F.filter(parts, lambda w: (F.length(w) >= 2) & ~w.isin(L.IDENTIFIER_STOP_WORDS)), "")


def tokenize_identifier(name: Column) -> Column:
    """Parts of an identifier: ``fooBar`` and ``ABCDef`` split too, two characters or more."""
    spaced = F.regexp_replace(camel_split(name, "a-z0-9"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), LETTER), lambda w: F.length(w) >= 2)


def search_tokens(text: Column, most: int = 12) -> Column:
    return F.slice(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)), 1, most)


def plural_key(token: Column) -> Column:
    return F.when((F.length(token) > 4) & F.endswith(token, F.lit("s")), F.left(token, F.length(token) - 1)).otherwise(token)


def prefix_key(token: Column) -> Column:
    """The first six characters of long tokens, four of middling ones; null for short ones."""
    return F.when(F.length(token) >= 8, F.left(token, F.lit(6))).when(F.length(token) >= 5, F.left(token, F.lit(4)))


def sampled(values: Column, limit: int, head: float = 0.5, tail: float = 0.3) -> Column:
    """All values, or of more than ``limit`` the head, a middle and the tail by those shares."""
    h, t = -int(-limit * head // 1), int(limit * tail)
    m = max(0, limit - h - t)

    def cut(v: Column) -> Column:
        n = F.size(v)
        middle = F.greatest(F.lit(h), F.floor((n - m) / 2).cast("int"))
        some = F.concat(F.slice(v, 1, h), F.slice(v, middle + 1, m), F.slice(v, n - t + 1, t))
        return F.when(n <= limit, v).otherwise(F.slice(F.array_distinct(some), 1, limit))

    return let(values, cut)


def extract_distinct(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), group), lambda x: F.trim(x))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def bounded_text(text: Column, limit: int = 90_000) -> Column:
    """Head, middle and tail of a text beyond ``limit`` characters: 45, 25 and 30 percent of the limit."""
    head, middle = int(limit * 0.45), int(limit * 0.25)
    tail = limit - head - middle
    n = F.length(text)
    at = F.greatest(F.lit(head), F.floor((n - middle) / 2).cast("int"))
    mark = F.lit("\n...\n")
    return F.when(n <= limit, text).otherwise(F.concat(F.left(text, F.lit(head)), mark, F.substring(text, at + 1, F.lit(middle)), mark, F.right(text, F.lit(tail))))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_preview(text: Column, n: int = 360) -> Column:
    """The first characters without comments, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"(?m)//.*$", " ")
    return F.left(squeeze(bare), F.lit(n))


def quoted(text: Column) -> Column:
    """(name, sign, value) of every value between two quotes that a name and one of ``: = (`` stand before.

    Found by splitting at quotes, so that no value hides another one; name and sign count within 120 characters.
    """
    pieces = F.split(text, "[\"'`]")

    def one(p: Column) -> Column:
        before = lambda i: F.right(F.regexp_replace(F.get(p, i - 1), r"\s+$", ""), F.lit(120))
        rows = F.transform(p, lambda v, i: let(before(i), lambda b: F.struct(
            F.regexp_extract(b, r"([\w.$-]+)\s*[:=(]$", 1).alias("name"), F.right(b, F.lit(1)).alias("sign"), v.alias("value"),
        )))
        return F.filter(rows, lambda x, i: (i >= 1) & (i < F.size(p) - 1) & (x["name"] != ""))

    return let(pieces, one)


#: Names whose quoted values tell what a page is about, by the sign behind them, with the most characters. Fixed values.
HINT_NAMES = [
    (":", "title", 220), (":", "description", 260), (":", "label", 180), (":", "heading", 180), (":", "subtitle", 180), ("=", "aria-label", 160),
]
#: Headings that do so, and the most characters. Fixed values.
HINT_HEADINGS = ["h1", "h2", "h3"]
HEADING_LIMIT = 260


def headings(html: Column) -> Column:
    """What stands between the end of a heading and the last opening of one before it."""
    names = "|".join(HINT_HEADINGS)
    ended = F.split(html, f"(?i)</(?:{names})>")
    inner = F.transform(ended, lambda x: F.split(x, rf"(?i)<(?:{names})(?:\s[^>]*)?>"))
    opened = F.filter(inner, lambda x, i: (i < F.size(ended) - 1) & (F.size(x) > 1))
    return F.filter(F.transform(opened, lambda x: F.element_at(x, -1)), lambda x: F.length(x) <= HEADING_LIMIT)


def page_hints(html: Column, most: int = 24) -> Column:
    """Texts of the hint names, by name and then in order, and of headings: tags stripped, 3 to 260 characters, each once."""

    def one(q: Column, sign: str, name: str, longest: int) -> Column:
        own = lambda x: (F.lower(x["name"]) == name) | any_end(F.lower(x["name"]), [c + name for c in ".-$"])
        return F.filter(q, lambda x: (x["sign"] == sign) & own(x) & F.length(x["value"]).between(3, longest))

    def values(q: Column) -> Column:
        return F.transform(F.flatten(F.array(*[one(q, *hint) for hint in HINT_NAMES])), lambda x: x["value"])

    found = F.concat(let(quoted(html), values), headings(html))
    bare = F.transform(found, lambda x: squeeze(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"[{}()\[\]`$]", " ")))
    return F.slice(F.array_distinct(F.filter(bare, lambda x: F.length(x).between(3, 260))), 1, most)


def any_end(text: Column, ends: list[str]) -> Column:
    out = F.lit(False)
    for end in ends:
        out = out | F.endswith(text, F.lit(end))
    return out


#: Parts of names whose values are secrets, schemes of connection strings, and what replaces a value. Fixed values.
SECRET_KEYS = ["SECRET", "TOKEN", "PASSWORD", "PASS", "API_KEY", "PRIVATE_KEY", "DATABASE_URL", "CLIENT_SECRET", "ACCESS_KEY"]
SECRET_SCHEMES = ["postgres", "postgresql"]
REDACTED = "<redacted>"
#: Any name with what is set or given to it, through up to 51 signs (then another chain begins, so that matches need
#: little stack), and any address with credentials.
_VALUE = "[\"'`]?[^\\s\"',`}:=]+"
ASSIGNED = rf"\b\w+\s*[:=]+\s*{_VALUE}(?:\s*(?::=|[:=])\s*{_VALUE}|[:=]+{_VALUE}){{0,50}}[:=]*"
ADDRESS = "\\b[A-Za-z][A-Za-z0-9+.-]*://[^\\s@]+@[^\\s\"',`})]+"


def _each(text: Column, pattern: str, change) -> Column:
    """A text with each match of a pattern changed."""
    rest, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.array_join(F.zip_with(rest, F.transform(found, change), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def redact_secrets(text: Column) -> Column:
    """What is set or given to a secret-like name, and credentials and hosts of connection strings, give way to a mark.

    A name holds one of the keys in any case. In a chain of names and signs all behind the first such name goes.
    """

    def assigned(m: Column) -> Column:
        def cut(parts: Column) -> Column:
            last = lambda p: F.upper(F.regexp_extract(F.right(p, F.lit(200)), r"(\w+)\s*$", 1))
            at = F.array_position(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.exists(strings(*SECRET_KEYS), lambda k: F.contains(last(p), k))), True).cast("int")
            kept = F.left(m, F.length(F.array_join(F.slice(parts, 1, at), ":")))
            return F.when(at > 0, F.concat(F.regexp_replace(kept, r"\s+$", ""), F.lit("=" + REDACTED))).otherwise(m)

        return let(F.split(m, "[:=]"), cut)

    def address(m: Column) -> Column:
        out = m
        for scheme in SECRET_SCHEMES:
            at = F.locate(scheme + "://", F.lower(m))
            out = F.when(at > 0, F.concat(F.left(m, at + len(scheme) + 2), F.lit(REDACTED + "@<host>"))).otherwise(out)
        return out

    return _each(_each(text, ASSIGNED, assigned), ADDRESS, address)


def snippet(text: Column, query: Column) -> Column:
    """(snippet, line) around the first hit: 90 characters before, 140 after, ellipses where cut; null without a hit."""
    at = F.instr(F.lower(text), F.lower(query))
    begin = F.greatest(F.lit(1), at - 90)
    end = F.least(F.length(text), at - 1 + F.length(query) + 140)
    body = squeeze(F.substring(text, begin, end - begin + 1))
    shown = F.concat(F.when(begin > 1, "...").otherwise(""), body, F.when(end < F.length(text), "...").otherwise(""))
    line = F.length(F.left(text, at - 1)) - F.length(F.replace(F.left(text, at - 1), F.lit("\n"), F.lit(""))) + 1
    return F.when(at > 0, F.struct(shown.alias("snippet"), line.alias("line")))


def truncated(text: Column, n: int) -> Column:
    return F.struct(F.left(text, F.lit(n)).alias("text"), (F.length(text) > n).alias("truncated"), F.length(text).alias("length"))


def markdown_sections(text: Column) -> Column:
    """(key, value) of each ``## title`` and its body, in order; equal titles all stay."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), "\n## "), 2, 1_000_000)
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "\n", 1)).alias("key"), F.trim(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + F.lit(2), F.length(p))).alias("value")))
    return pairs


def stable_id(text: Column, prefix: str = "candidate_", n: int = 14) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(text, 256), F.lit(n)))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), round_half_up(x)))


def ratio(a: Column, b: Column, default: float) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(default))


def shared_prefix_depth(a: Column, b: Column) -> Column:
    """How many leading parts two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are equal; three decimals."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.round(F.size(F.array_intersect(a, b)) / union, 3))


def exact_value(text: Column) -> Column:
    """The first quoted value of a text."""
    return F.nullif(F.regexp_extract(text, r"""["'`«]([^"'`«»\n]{1,200})["'`»]""", 1), F.lit(""))


def value_kind(value: Column) -> Column:
    return (
        F.when(F.rlike(value, F.lit(r"^https?://\S+$")), "url")
        .when(F.rlike(value, F.lit(r"^#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")), "color")
        .when(F.rlike(value, F.lit(r"^-?[0-9]+(?:\.[0-9]+)?(?:px|rem|em|%|vh|vw|ms|s)$")), "measure")
        .when(F.rlike(value, F.lit(r"^-?[0-9]+(?:\.[0-9]+)?$")), "number")
        .when(F.rlike(value, F.lit(r"^(?:true|false)$")), "boolean")
        .when(F.rlike(value, F.lit(r"^[A-Za-z_$][A-Za-z0-9_$]*$")), "identifier")
        .otherwise("text")
    )


def file_mentions(text: Column) -> Column:
    """Paths with a slash and bare file names that a text names, each once, in order of kind and appearance."""
    ext = r"(?:tsx?|jsx?|mjs|cjs|css|scss|html|json|md|ya?ml|sql|py|go|rs|java)"
    strict = F.regexp_extract_all(text, F.lit(rf"((?:[A-Za-z0-9_.@()\[\]-]+/)+[A-Za-z0-9_.()\[\]-]+\.{ext})(?:[^A-Za-z0-9]|$)"), 1)
    bare = F.regexp_extract_all(text, F.lit(rf"(?:^|[\s\"'`(,])([A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.{ext})(?:[^A-Za-z0-9]|$)"), 1)
    return F.array_distinct(F.concat(strict, bare))
