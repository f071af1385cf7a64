"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are broadcast (some 100 bytes each); more meet the expressions by shuffle.
BROADCAST_RULES = 200_000
#: Hexadecimal digits of a digest that are joined on; the whole digest is compared afterwards.
PREFIX = 8


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z lower-cased.

    A null URL, or one without ``://``, has the empty host.
    """
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty where there is no host."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def prepare(rules: DataFrame) -> DataFrame:
    """(rule, verdict, labels, size, folder, rank, digest, prefix): one row for each host and path that can fit a URL.

    Left out are rules that can fit none: without host or verdict, or with a path that is neither empty nor begins
    with ``/``. A null path counts as empty. Of rules with equal host and path a block goes before anything else. ``rank`` orders
    rules that fit one URL: the longer text goes first, then the longer host. Two fitting rules with equal texts'
    lengths and hosts' lengths are the same rule, so there are no ties.
    """
    path = F.coalesce("path", F.lit(""))
    host = F.translate("host", UPPER, LOWER)
    kept = rules.select(host.alias("host"), path.alias("path"), "verdict").filter("host <> '' AND verdict IS NOT NULL AND (path = '' OR path LIKE '/%')")
    one = kept.groupBy("host", "path").agg(F.when(F.max(F.col("verdict") == "block"), "block").otherwise(F.min("verdict")).alias("verdict"))
    key = digest(F.col("host"), F.col("path"))
    return one.select(
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("size"),
        F.endswith("path", F.lit("/")).alias("folder"),
        F.struct((F.length("host") + F.length("path")).alias("whole"), F.length("host").alias("host")).alias("rank"),
        key.alias("digest"),
        F.left(key, F.lit(PREFIX)).alias("prefix"),
    )


def expressions(host: Column, path: Column, shapes: list[tuple[int, int, bool]]) -> Column:
    """Digests of a URL's host suffixes with its path prefixes, as an array.

    ``shapes``: (labels, length of the path, whether it ends in ``/``) of rules. Only what has the shape of a rule
    is made, so a URL of thousands of labels or folders costs no more than the rules are varied; nothing is lost.
    """
    labels = F.split(host, r"\.")
    by_labels: dict[int, list[tuple[int, bool]]] = {}
    for n, size, folder in shapes:
        by_labels.setdefault(n, []).append((size, folder))
    none = F.array().cast("array<string>")

    def of_suffix(n: int, ends: list[tuple[int, bool]]) -> Column:
        suffix = F.array_join(F.slice(labels, -n, n), ".")
        known = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(f).alias("folder")) for s, f in sorted(set(ends))])
        fits = F.filter(known, lambda e: (F.length(path) >= e["size"]) & (~e["folder"] | (F.substr(path, e["size"], F.lit(1)) == "/")))
        return F.when(F.size(labels) >= n, F.transform(fits, lambda e: digest(suffix, F.left(path, e["size"])))).otherwise(none)

    return F.flatten(F.array(*[of_suffix(n, ends) for n, ends in sorted(by_labels.items())])) if by_labels else none


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``pages`` with (host, path, rule, verdict): the rule that fits each URL best, or ``otherwise`` where none does.

    A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with the rule's; the
    longest text of host and path wins. Each URL is expanded into the digests of its host suffixes and path prefixes
    that have a rule's shape; expressions and rules meet by the first eight hexadecimal digits, then the whole digest
    decides. Up to ``broadcast_rules`` rules are broadcast. Beyond that both sides are shuffled by the short prefix,
    but for prefixes that hold more than 1/1,024 of all expressions, whose rules are broadcast: a host that a third of
    all pages share is met in place. Both ways give the same rows.

    One row for each input row: null URLs, null ids and repeated rows stay. Input columns named host, path, rule or
    verdict are replaced; other columns stay. Without rules every row gets ``otherwise``. Rows are numbered within the
    input's partitions, so the input should be a table or checkpoint, whose rows keep their order when read again.
    """
    ready = prepare(rules)
    shapes = [tuple(r) for r in ready.groupBy("labels", "size", "folder").agg(F.count("*").alias("n")).collect()]
    n_rules = sum(s[3] for s in shapes)
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    base = pages.select(F.struct(*own).alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.monotonically_increasing_id().alias("rid"))
    made = expressions(F.col("host"), F.col("path"), [s[:3] for s in shapes])
    # the null at the front stands for the page itself, so that a page without any fitting rule keeps a row
    rows = base.select("*", F.explode(F.concat(F.array(F.lit(None).cast("string")), made)).alias("key"))
    rows = rows.withColumn("prefix", F.left("key", F.lit(PREFIX)))
    side = ready.select("prefix", "digest", "rule", "verdict", "rank")
    if n_rules <= broadcast_rules:
        met = rows.join(F.broadcast(side), (rows["prefix"] == side["prefix"]) & (rows["key"] == side["digest"]), "left")
        met = met.filter("key IS NULL OR digest IS NOT NULL")
    else:
        met = _by_shuffle(materialize(rows, "url-expressions"), side)
    best = F.max(F.struct("rank", "rule", "verdict"))
    found = met.groupBy("rid").agg(F.first("page").alias("page"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    return found.select("page.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


def _by_shuffle(rows: DataFrame, side: DataFrame) -> DataFrame:
    """Expressions and rules by shuffle, the prefixes that many URLs share apart; pages themselves come along."""
    pages, asked = rows.filter("key IS NULL"), rows.filter("key IS NOT NULL")
    bound = math.ceil(asked.count() / HOT)
    hot = asked.groupBy("prefix").agg(F.count("*").alias("n")).filter(F.col("n") > bound).select("prefix")
    hot = F.broadcast(materialize(hot, "url-hot"))  # fewer than 1,024 prefixes, and hardly more rules
    near = asked.join(F.broadcast(side.join(hot, "prefix", "left_semi")), "prefix")
    far = asked.join(hot, "prefix", "left_anti").join(side, "prefix")
    met = near.unionByName(far).filter("key = digest")
    return pages.unionByName(met, allowMissingColumns=True)
