"""Lists, searches, defaults, digests and checks over projects, task packs, catalogs and validation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round_half_up
from .lineage import cut


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, within: list[str] | None = None) -> DataFrame:
    """A page of ``rows``, of each group of ``within`` if given: with position (from 1), total and next_offset.

    The limit is clamped to 1 to 100; next_offset is null on the last page.
    """
    limit, offset = max(1, min(100, limit)), max(0, offset)
    by = within or ["__all"]
    grouped = rows if within else rows.withColumn("__all", F.lit(0))
    # the row number alone, so that each task keeps no more than the page's end of a group; the total apart
    spot = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    top = grouped.withColumn("position", spot).filter(F.col("position") <= offset + limit).filter(F.col("position") > offset)
    totals = grouped.groupBy(*by).agg(F.count("*").alias("total"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]
    shown = top.alias("r").join(totals.alias("t"), same).select("r.*", "t.total").drop("__all")
    return shown.withColumn("next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit)))


def counts_of_kinds(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, n) of every one of ``kinds``, those without rows with 0; other kinds are left out."""
    wanted = rows.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return F.broadcast(wanted).join(rows.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").na.fill(0, ["n"])


def default_by_key(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """(request_id, template_id, level): the default template of each request.

    Of its tool and type, else of its tool and the type general, else of the tool generic and its type, else of both;
    ties to the smaller template_id. Requests without any have none, nor have those without an id; what is asked under
    one id counts together. ``templates``: (template_id, tool, type). Each tool and type asked for is looked up once.
    """
    levels = [(F.col("tool"), F.col("type")), (F.col("tool"), F.lit("general")), (F.lit("generic"), F.col("type")), (F.lit("generic"), F.lit("general"))]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), a.alias("tool"), b.alias("type")) for n, (a, b) in enumerate(levels)]))
    asked = requests.select("tool", "type").distinct().select(F.col("tool").alias("t"), F.col("type").alias("y"))
    wanted = asked.withColumns({"tool": F.col("t"), "type": F.col("y")}).select("t", "y", each.alias("k")).select("t", "y", "k.level", "k.tool", "k.type")
    first = templates.groupBy("tool", "type").agg(F.min("template_id").alias("template_id"))
    best = cut(wanted.join(first, ["tool", "type"]).groupBy("t", "y").agg(F.min(F.struct("level", "template_id")).alias("m")))
    found = requests.join(best, F.col("tool").eqNullSafe(F.col("t")) & F.col("type").eqNullSafe(F.col("y")), "left")
    least = found.groupBy("request_id").agg(F.min("m").alias("m"), F.count("*").alias("n"))
    each_one = least.select("request_id", F.when(F.col("request_id").isNotNull(), F.col("m")).alias("m"), F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return each_one.select("request_id", "m.template_id", "m.level")


def merge_diff_stats(name_status: DataFrame, numstat: DataFrame) -> DataFrame:
    """``name_status(project_id, path, status)`` with additions, deletions and binary of ``numstat``; unmatched keep zeros."""
    stats = numstat.groupBy("project_id", "path").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.bool_or("binary").alias("binary"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return name_status.join(stats, ["project_id", "path"], "left").select("project_id", "path", "status", zero("additions"), zero("deletions"), F.coalesce("binary", F.lit(False)).alias("binary"))


def primary_project(projects: DataFrame, packs: DataFrame, low: int = 60) -> DataFrame:
    """(owner, project_id, reason): the project to show first for each owner.

    The first that needs attention (score below ``low``, lowest first), else that of the latest pack, else the one
    scanned last. ``projects``: (owner, project_id, score, scanned_at); ``packs``: (project_id, pack_id, created_at).
    """
    attention = projects.filter(F.col("score") < low).select("owner", "project_id", F.lit("attention").alias("reason"), F.struct(F.lit(0), F.col("score").cast("double"), F.col("project_id")).alias("k"))
    packed = projects.join(packs, "project_id").select("owner", "project_id", F.lit("latest-pack").alias("reason"), F.struct(F.lit(1), -F.unix_timestamp("created_at").cast("double"), F.col("project_id")).alias("k"))
    scanned = projects.select("owner", "project_id", F.lit("latest-scan").alias("reason"), F.struct(F.lit(2), -F.unix_timestamp("scanned_at").cast("double"), F.col("project_id")).alias("k"))
    every = attention.unionByName(packed).unionByName(scanned)
    return every.groupBy("owner").agg(F.min_by(F.struct("project_id", "reason"), "k").alias("b")).select("owner", "b.project_id", "b.reason")


def case_digest(cases: DataFrame, columns: list[str]) -> DataFrame:
    """(split, n_cases, digest): SHA-256 over a split's cases in order of case_id, each by its columns in order of name.

    Cases are digested one by one and by 4,096 buckets of their ids, so that no row gathers a split.
    """
    named = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sorted(columns)]
    one = cases.select("split", "case_id", F.left(F.sha2(F.col("case_id").cast("string"), 256), F.lit(3)).alias("bucket"), F.sha2(F.concat_ws("\n", *named), 256).alias("d"))
    ordered = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["d"]), "\n"), 256)
    parts = one.groupBy("split", "bucket").agg(F.count("*").alias("n"), ordered(F.struct("case_id", "d")).alias("d"))
    return parts.groupBy("split").agg(F.sum("n").alias("n_cases"), ordered(F.struct("bucket", "d")).alias("digest"))


def validation_coverage(cases: DataFrame) -> DataFrame:
    """One row: distinct families, projects and areas of ``cases``, and how many have a severity, targets and exclusions."""
    return cases.agg(
        F.count("*").alias("n_cases"), F.count_distinct("family").alias("families"), F.count_distinct("project").alias("projects"), F.count_distinct("area").alias("areas"),
        F.array_join(F.sort_array(F.collect_set("severity")), ",").alias("severities"), F.count_if(F.col("n_targets") > 0).alias("with_targets"), F.count_if(F.col("n_excluded") > 0).alias("with_exclusions"),
    )


def expectations(cases: DataFrame, actual: DataFrame) -> DataFrame:
    """(case_id, failures, status): what each case expects and did not get.

    ``cases``: (case_id, expected array, excluded array, least_score, most_ms), null for no expectation; ``actual``:
    (case_id, paths array, score, ms). Failures: missing-path, excluded-path, low-score, slow; without any the case is
    passed, without an actual row it is observed.
    """
    rows = cases.join(actual.withColumn("there", F.lit(True)), "case_id", "left")
    # an expectation that is absent fails nothing
    holds = lambda c: F.coalesce(c, F.lit(False))
    found = F.array_compact(F.array(
        F.when(holds(F.size(F.array_except("expected", "paths")) > 0), "missing-path"), F.when(holds(F.arrays_overlap("excluded", "paths")), "excluded-path"),
        F.when(holds(F.col("score") < F.col("least_score")), "low-score"), F.when(holds(F.col("ms") > F.col("most_ms")), "slow"),
    ))
    status = F.when(F.col("there").isNull(), "observed").when(F.size(found) > 0, "failed").otherwise("passed")
    return rows.select("case_id", F.array_join(found, ",").alias("failures"), status.alias("status"))


def verify_records(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows(id, columns, digest)`` with ``intact``: whether the digest is the SHA-256 of the columns; bodies that are
    not intact are blanked."""
    own = F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    intact = F.coalesce(own == F.col("digest"), F.lit(False))
    return rows.withColumn("intact", intact).withColumns({c: F.when(F.col("intact"), F.col(c)) for c in columns})


def dedupe_pairs(rows: DataFrame, n: int = 8) -> DataFrame:
    """(task_id, question, answer, rank): the first ``n`` different questions with answers of each task, white space
    collapsed, compared without case. ``rows``: (task_id, pos, question, answer)."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    plain = rows.select("task_id", "pos", flat("question").alias("question"), flat("answer").alias("answer")).filter("question <> '' and answer <> ''")
    first = plain.groupBy("task_id", F.lower("question").alias("q"), F.lower("answer").alias("a")).agg(F.min(F.struct("pos", "question", "answer")).alias("m"))
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("m.pos"))
    return first.withColumn("rank", place).filter(F.col("rank") <= n).select("task_id", "m.question", "m.answer", "rank")


def staleness(ts: Column, now: Column, days: int = 7) -> Column:
    """Whether a time is absent or more than ``days`` before ``now``."""
    return ts.isNull() | (ts < now - F.make_interval(days=F.lit(days)))


def json_stage(text: Column) -> Column:
    """How a JSON object can be had from a model's answer: direct, fenced, fragment (first brace to last), or why not:
    empty, truncated (more braces open than close), invalid."""
    bare = F.trim(text)
    fenced = F.regexp_extract(text, r"```(?:json)?\s*(\{[\s\S]*?\})\s*```", 1)
    from_first = F.regexp_extract(text, r"(\{[\s\S]*\})", 1)
    good = lambda x: (x != "") & F.try_parse_json(x).isNotNull() & F.startswith(x, F.lit("{"))
    opened, closed = (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in "{}")
    return (
        F.when(F.coalesce(bare, F.lit("")) == "", "empty").when(good(bare), "direct").when(good(fenced), "fenced").when(good(from_first), "fragment")
        .when(opened > closed, "truncated").otherwise("invalid")
    )


def rename_intent(task: Column) -> Column:
    """(old, new) of a task that asks to rename one name to another; null if it does not."""
    pattern = r"(?i)\brename\s+[`'\"]?([A-Za-z_$][A-Za-z0-9_$]*)[`'\"]?\s+(?:to|into|as)\s+[`'\"]?([A-Za-z_$][A-Za-z0-9_$]*)"
    old, new = (F.regexp_extract(task, pattern, k) for k in (1, 2))
    return F.when((old != "") & (old != new), F.struct(old.alias("old"), new.alias("new")))


def route_mentions(task: Column) -> Column:
    """The routes that a task names, in lower case, each once in order: with a leading slash, without a query or a
    closing slash, and no file's path."""
    found = F.regexp_extract_all(task, F.lit(r"(?:^|[\s\"'`(])(/[A-Za-z0-9_\[\]:-]+(?:/[A-Za-z0-9_\[\]:-]+)*)/?(?:[\s\"'`),;?!]|\.(?:\s|$)|$)"), 1)
    return F.array_distinct(F.transform(found, lambda r: F.lower(r)))


def selection_confidence(rows: DataFrame) -> DataFrame:
    """(task_id, confidence): the mean of a task's confidences as a percentage from 0 to 100; values over 1 are taken
    as percentages already."""
    value = F.when(F.col("confidence") <= 1, F.col("confidence") * 100).otherwise(F.col("confidence"))
    return rows.groupBy("task_id").agg(F.greatest(F.lit(0), F.least(F.lit(100), round_half_up(F.avg(value)))).cast("long").alias("confidence"))
