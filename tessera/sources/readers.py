"""Readers of inventories, manifests, status logs, diffs, commits, issues, catalogs and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lookups as L
from ..functions import paths as P

#: What a status letter means. Fixed values.
STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "U": "unmerged", "?": "untracked"}
MANIFEST = T.StructType([T.StructField("name", T.StringType()), *[T.StructField(c, T.MapType(T.StringType(), T.StringType())) for c in ("scripts", "dependencies", "devDependencies", "peerDependencies", "optionalDependencies")]])


def status_name(code: Column) -> Column:
    out = F
    for letter, name in STATUS.items():
        out = out.when(code == letter, name)
    return out.otherwise("unknown")


def scan_inventory(spark: SparkSession, root_glob: str, max_depth: int = 7, max_files: int | None = None) -> DataFrame:
    """(path, size_bytes, modified_at, depth) below a root: ignored folders and mirrored repositories left out.

    Contents are not read: only what the listing gives. ``max_files`` caps a project's files by path, off by default.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root_glob).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    parts = F.transform(P.segments(F.col("path")), lambda s: F.lower(s))
    ignored = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in L.IGNORED_DIRECTORIES]))
    mirrored = F.rlike(F.lower("path"), F.lit("(^|/)storage/repositories/[a-z0-9_-]{12,}(/|$)"))
    kept = listed.filter(~ignored & ~mirrored).withColumn("depth", P.depth(F.col("path"))).filter(F.col("depth") <= max_depth)
    if max_files is None:
        return kept
    return kept.withColumn("__at", F.row_number().over(Window.orderBy("path"))).filter(F.col("__at") <= max_files).drop("__at")


def tree(files: DataFrame, max_depth: int = 5) -> DataFrame:
    """(project_id, path, is_dir) of files and of every folder above them, to a depth."""
    parts = F.split("path", "/")
    folders = files.select("project_id", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("n"), parts.alias("s")) if files else files
    folders = folders.filter("n >= 1 and n < size(s)").select("project_id", F.array_join(F.slice("s", 1, F.col("n")), "/").alias("path"), F.lit(True).alias("is_dir")).distinct()
    own = files.select("project_id", "path", F.lit(False).alias("is_dir"))
    return own.unionByName(folders).filter(F.size(F.split("path", "/")) <= max_depth)


def read_manifests(files: DataFrame, most: int = 512 * 1024) -> DataFrame:
    """(project_id, path, manifest) of package manifests that are valid JSON, up to a size."""
    own = files.filter((P.base_name(F.col("path")) == "package.json") & (F.octet_length("content") <= most))
    parsed = own.withColumn("ok", F.try_parse_json("content").isNotNull()).withColumn("manifest", F.from_json("content", MANIFEST))
    return parsed.filter("ok and manifest is not null").select("project_id", "path", "manifest")


def parse_status(logs: DataFrame) -> DataFrame:
    """(project_id, scope, path, original_path, status) of NUL-separated status logs ``(project_id, raw)``.

    A rename or copy takes the entry behind it as its original path. A file may be staged and unstaged at once.
    """
    entry = logs.select("project_id", F.posexplode(F.filter(F.split("raw", "\0"), lambda e: e != "")).alias("pos", "entry"))
    order = Window.partitionBy("project_id").orderBy("pos")
    x = F.substring("entry", 1, 1)
    moves = x.isin("R", "C") & (F.substring("entry", 3, 1) == " ")
    entry = entry.withColumn("moves", moves).withColumn("second", F.coalesce(F.lag("moves").over(order), F.lit(False))).withColumn("nxt", F.lead("entry").over(order))
    entry = entry.filter(~F.col("second") & (F.length("entry") >= 4))
    y, path = F.substring("entry", 2, 1), F.substring("entry", 4, 1 << 20)
    one = lambda test, scope, code: F.when(test, F.struct(F.lit(scope).alias("scope"), status_name(code).alias("status")))
    unknown = (x == "?") & (y == "?")
    scopes = F.array_compact(F.array(one(unknown, "untracked", F.lit("?")), one(~unknown & ~x.isin(" ", "?"), "staged", x), one(~unknown & ~y.isin(" ", "?"), "unstaged", y)))
    rows = entry.select("project_id", path.alias("path"), F.when(F.col("moves"), F.col("nxt")).alias("original_path"), F.explode(scopes).alias("s"))
    return rows.select("project_id", "s.scope", "path", "original_path", "s.status")


def parse_numstat(logs: DataFrame) -> DataFrame:
    """(project_id, path, additions, deletions, binary) of tab-separated numstat logs; ``-`` is binary without counts."""
    line = logs.select("project_id", F.explode(F.split("raw", "\n")).alias("line")).withColumn("p", F.split(F.rtrim("line"), "\t")).filter("size(p) >= 3")
    binary = (F.col("p")[0] == "-") | (F.col("p")[1] == "-")
    count = lambda k: F.when(~binary, F.col("p")[k].try_cast("long"))
    return line.select("project_id", F.array_join(F.slice("p", 3, F.size("p") - 2), "\t").alias("path"), count(0).alias("additions"), count(1).alias("deletions"), binary.alias("binary"))


def parse_name_status(logs: DataFrame, scope: str) -> DataFrame:
    """(project_id, scope, path, original_path, status) of name-status logs; a move takes the third field as its path."""
    line = logs.select("project_id", F.explode(F.split("raw", "\n")).alias("line")).withColumn("p", F.split(F.rtrim("line"), "\t"))
    code = F.substring(F.col("p")[0], 1, 1)
    moves = code.isin("R", "C")
    at = lambda k: F.get("p", F.lit(k))
    path = F.when(moves, F.coalesce(at(2), at(1))).otherwise(at(1))
    rows = line.select("project_id", F.lit(scope).alias("scope"), path.alias("path"), F.when(moves, at(1)).alias("original_path"), status_name(code).alias("status"))
    return rows.filter("path is not null and path <> ''")


def parse_commits(logs: DataFrame) -> DataFrame:
    """(project_id, hash, short_hash, subject, author, date) of records separated by the unit separator."""
    p = F.split("raw", "\x1f")
    return logs.select("project_id", *[F.get(p, F.lit(k)).alias(n) for k, n in enumerate(("hash", "short_hash", "subject", "author", "date"))])


def normalize_issues(issues: DataFrame, state: str = "open", search: str = "") -> DataFrame:
    """Issues of a state that are no pull requests and whose number, title, body, labels or author hold the search text."""
    text = F.lower(F.concat_ws(" ", F.concat(F.lit("#"), F.col("number").cast("string")), "title", "body", F.array_join("labels", " "), "author"))
    kept = issues.filter(~F.col("is_pull_request"))
    if state != "all":
        kept = kept.filter(F.col("state") == state)
    return kept.filter(F.contains(text, F.lit(search.lower())))


def trace_metadata(column: str, keys: int = 24, chars: int = 240) -> Column:
    """At most ``keys`` entries of a metadata map, by key, with values cut to ``chars`` characters."""
    entries = F.slice(F.array_sort(F.map_entries(column)), 1, keys)
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], F.left(e["value"], F.lit(chars)).alias("value"))))
