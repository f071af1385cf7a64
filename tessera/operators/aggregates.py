"""Aggregations over inventories, projects, task packs and traces; each is one or two grouped passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import paths as P
from ..functions.text import let, round_half_up, tokenize_hints


HEADING = r"(?:^|\n)#{1,6}[ \t]+([^\n]+)"


def top_hints(files: DataFrame, k: int = 18, chars: int | None = None) -> DataFrame:
    """(project_id, path, hints): the k most frequent hint tokens of each file, ties in binary order.

    Counted are the tokens of the path and of the content, those of Markdown headings three times in all; ``chars``
    may bound the content that is read. A file is one row, so tokens are counted within it, by sorting, and nothing is shuffled.
    """
    content = F.coalesce("content", F.lit(""))
    content = content if chars is None else F.left(content, F.lit(chars))
    heads = F.array_join(F.regexp_extract_all(content, F.lit(HEADING), 1), " ")
    tokens = F.sort_array(tokenize_hints(F.concat_ws(" ", F.coalesce("path", F.lit("")), content, heads, heads)))

    def counted(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: ~F.get(t, i).eqNullSafe(F.get(t, i - 1)))
        return F.when(F.size(t) > 0, let(starts, lambda s: F.transform(s, lambda p, i: F.struct((p - F.coalesce(F.get(s, i + 1), F.size(t))).alias("n"), F.get(t, p).alias("token")))))

    best = let(tokens, lambda t: F.slice(F.array_sort(counted(t)), 1, k))
    hints = F.coalesce(F.transform(best, lambda x: x["token"]), F.array().cast("array<string>"))
    return files.select("project_id", "path", hints.alias("hints"))


def count_by(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, counts map): how many rows of each value of ``column``."""
    counts = rows.groupBy(key, column).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("counts"))


def inventory_summary(inventory: DataFrame) -> DataFrame:
    """For each project: files, bytes, and whether it has assets, sources, styles, docs, tests and pages."""
    notes = [F.bool_or(F.col("kind") == k).alias(f"has_{k}") for k in ("asset", "source", "style", "docs", "test")]
    return inventory.groupBy("project_id").agg(
        F.count("*").alias("n_files"), F.sum("size_bytes").alias("n_bytes"), *notes, F.bool_or(F.col("role") == "page").alias("has_page")
    )


def readiness(files: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ten readiness checks of each project and the score that is the sum of the points of those passed.

    ``files``: (project_id, path); ``commands``: (project_id, build, dev, test), booleans. Returns checks (project_id,
    key, label, points, passed) and scores (project_id, score, n_issues); the CI check raises no issue.
    """
    flags = P.readiness_flags(F.col("path"))
    seen = files.groupBy("project_id").agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])
    wide = seen.join(commands, "project_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    passed = {
        "readme": F.col("is_readme"), "agents": F.col("is_agents"), "build-script": yes("build"), "dev-script": yes("dev"),
        "test-script": yes("test"), "env-example": F.col("is_env_example"), "typescript-config": F.col("is_tsconfig"),
        "tests": F.col("is_test_file") | F.col("is_test_config"), "docs": F.col("is_docs"), "ci": F.col("is_ci"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), F.lit(p).alias("points"), passed[k].alias("passed")) for k, label, p in L.READINESS_CHECKS])
    checks = wide.select("project_id", F.explode(rows).alias("c")).select("project_id", "c.*")
    scores = checks.groupBy("project_id").agg(
        F.sum(F.when(F.col("passed"), F.col("points")).otherwise(0)).alias("score"), F.count_if(~F.col("passed") & (F.col("key") != "ci")).alias("n_issues")
    )
    return checks, scores


def signals(files: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """For each project the sorted distinct paths of each flag."""
    lists = [F.array_sort(F.collect_set(F.when(c, F.col("path")))).alias(n) for n, c in flags.items()]
    return files.groupBy("project_id").agg(*lists)


def package_manager(files: DataFrame) -> DataFrame:
    """(project_id, package_manager): by the lock file that comes first in priority; null without one."""
    name = P.base_name(F.col("path"))
    found = files.groupBy("project_id").agg(
        *[F.bool_or(name.isin(*n)).alias(m) for m, n in (("pnpm", ["pnpm-lock.yaml"]), ("yarn", ["yarn.lock"]), ("npm", ["package-lock.json"]), ("bun", ["bun.lockb", "bun.lock"]))]
    )
    pick = F.when(F.col("pnpm"), "pnpm").when(F.col("yarn"), "yarn").when(F.col("npm"), "npm").when(F.col("bun"), "bun")
    return found.select("project_id", pick.alias("package_manager"))


def merge_scripts(manifests: DataFrame) -> DataFrame:
    """(project_id, script, command) of all packages of a project.

    ``manifests``: (project_id, pos, prefix, script, command) in package order, prefix ``root`` for the top one. A plain
    name keeps its first command; ``prefix:name`` its last. Blank commands do not count.
    """
    sound = manifests.filter(F.trim("command") != "")
    first = sound.groupBy("project_id", "script").agg(F.min_by("command", "pos").alias("command"), F.min("pos").alias("pos"))
    taken = first.select("project_id", "script", F.col("pos").alias("__first"))
    rest = sound.join(taken, ["project_id", "script"]).filter((F.col("prefix") != "root") | (F.col("pos") != F.col("__first")))
    long = rest.groupBy("project_id", F.concat_ws(":", "prefix", "script").alias("script")).agg(F.max_by("command", "pos").alias("command"))
    return first.select("project_id", "script", "command").unionByName(long)


def merge_dependencies(dependencies: DataFrame) -> DataFrame:
    """(project_id, name, version): of ``(project_id, pos, name, version)`` the last package's version of each name."""
    return dependencies.groupBy("project_id", "name").agg(F.max_by("version", "pos").alias("version"))


def readiness_summary(projects: DataFrame, group: str) -> DataFrame:
    """Rounded mean score, and how many projects are low (under 50) and ready (80 or more)."""
    return projects.groupBy(group).agg(
        round_half_up(F.avg("score")).cast("long").alias("average"), F.count_if(F.col("score") < 50).alias("low"), F.count_if(F.col("score") >= 80).alias("ready")
    )


#: Score bands: label, lowest, highest. Fixed values.
BANDS = {
    "four": [("0-39", 0, 39), ("40-59", 40, 59), ("60-79", 60, 79), ("80-100", 80, 100)],
    "quarters": [("0-25", 0, 25), ("26-50", 26, 50), ("51-75", 51, 75), ("76-100", 76, 100)],
}


def readiness_histogram(projects: DataFrame, scheme: str) -> DataFrame:
    """(band, n) for every band of the scheme, empty ones too."""
    score = F.col("score")
    counts = projects.agg(*[F.count_if(score.between(lo, hi)).alias(label) for label, lo, hi in BANDS[scheme]])
    rows = F.array(*[F.struct(F.lit(label).alias("band"), F.col(f"`{label}`").alias("n")) for label, _, _ in BANDS[scheme]])
    return counts.select(F.explode(rows).alias("b")).select("b.*")


def top_issues(checks: DataFrame, n: int = 10) -> DataFrame:
    """The failed checks of most projects: (issue, n_projects, first_label), count first, then label."""
    failed = checks.filter(~F.col("passed")).groupBy(F.lower("label").alias("issue"))
    counts = failed.agg(F.countDistinct("project_id").alias("n_projects"), F.min("label").alias("first_label"))
    return counts.orderBy(F.desc("n_projects"), "issue").limit(n)


def count_signals(rows: DataFrame, column: str, n: int = 8) -> DataFrame:
    """The values that most rows have, blank as ``unknown``; count first, then label."""
    label = F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit("unknown"))
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(n)


def activity(packs: DataFrame, now: Column) -> DataFrame:
    """For each project: packs, those of the last seven days, and the latest."""
    age = F.unix_micros(now) - F.unix_micros(F.col("created_at").cast("timestamp"))
    week = 7 * 86_400 * 1_000_000
    return packs.groupBy("project_id").agg(F.count("*").alias("n_packs"), F.count_if(age.between(0, week)).alias("this_week"), F.max("created_at").alias("latest"))


def diff_totals(diff_files: DataFrame) -> DataFrame:
    """For each project: files, additions and deletions (null as 0), binary files and files by scope."""
    zero = F.lit(0)
    return diff_files.groupBy("project_id").agg(
        F.count("*").alias("files"), F.sum(F.coalesce("additions", zero)).alias("additions"), F.sum(F.coalesce("deletions", zero)).alias("deletions"),
        F.count_if("binary").alias("binary_files"), *[F.count_if(F.col("scope") == s).alias(s) for s in ("staged", "unstaged", "untracked")],
    )


def fingerprint(files: DataFrame, column: str | None = None) -> DataFrame:
    """(project_id, fingerprint): SHA-256 over a project's paths, each with its content's digest or with nothing.

    Lines are digested in order within each of 65,536 buckets of the path's own digest, then the buckets' digests in
    order, so that no row gathers a project. The value is the library's own; row order does not matter.
    """
    digest = F.lit("") if column is None else F.concat(F.lit(":"), F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("")), 256))
    lines = files.select("project_id", F.left(F.sha2("path", 256), F.lit(4)).alias("bucket"), F.concat("path", digest, F.lit("\n")).alias("line"))
    whole = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    parts = lines.groupBy("project_id", "bucket").agg(whole("line").alias("part"))
    return parts.groupBy("project_id").agg(whole(F.concat("bucket", F.lit(":"), "part", F.lit("\n"))).alias("fingerprint"))


def request_summary(trace: DataFrame) -> DataFrame:
    """For each request of a trace: stages, model calls and their time, cache hits and misses, whether it was warm."""
    ms = lambda c: F.round(c, 1)
    return trace.groupBy("session_id", "request_id").agg(
        F.count("*").alias("stages"), F.count_if(F.col("kind") == "ai").alias("ai_calls"), ms(F.sum(F.when(F.col("kind") == "ai", F.col("duration")).otherwise(0.0))).alias("ai_ms"),
        F.count_if(F.col("kind") == "hit").alias("hits"), F.count_if(F.col("kind") == "miss").alias("misses"), ms(F.sum("duration")).alias("total_ms"), F.bool_or(F.col("kind") == "hit").alias("warm"),
    )


def session_summary(requests: DataFrame) -> DataFrame:
    """Requests rolled up to sessions, with the models' share of the time and the share of cache hits in percent."""
    total = requests.groupBy("session_id").agg(
        F.count("*").alias("requests"), F.sum("stages").alias("stages"), F.sum("ai_calls").alias("ai_calls"), F.round(F.sum("ai_ms"), 1).alias("ai_ms"),
        F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.round(F.sum("total_ms"), 1).alias("total_ms"),
    )
    share = lambda a, b: round_half_up(F.coalesce(F.col(a) * 100 / F.nullif(b, F.lit(0)), F.lit(0))).cast("long")
    return total.withColumn("ai_share", share("ai_ms", F.col("total_ms"))).withColumn("hit_rate", share("hits", F.col("hits") + F.col("misses")))


def project_overview(projects: DataFrame, packs: DataFrame) -> DataFrame:
    """Projects with how many packs they have and the time of the latest; counted before the join."""
    counts = packs.groupBy("project_id").agg(F.count("*").alias("n_packs"), F.max("created_at").alias("latest_pack"))
    return projects.join(counts, "project_id", "left").withColumn("n_packs", F.coalesce("n_packs", F.lit(0)))


def calibration(outcomes: DataFrame) -> DataFrame:
    """(bucket, n, mean, observed, gap) of ``(confidence 0..100, passed)`` in four buckets of confidence."""
    bucket = F.when(F.col("confidence") < 30, "0-29").when(F.col("confidence") < 60, "30-59").when(F.col("confidence") < 80, "60-79").otherwise("80-100")
    grouped = outcomes.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.avg(F.col("passed").cast("double")).alias("observed"))
    return grouped.select("bucket", "n", F.round("mean", 6).alias("mean"), F.round("observed", 6).alias("observed"), F.round(F.abs(F.col("mean") / 100 - F.col("observed")), 6).alias("gap"))
