"""Queries of the aggregations, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import paths as P
from ..operators import aggregates as A
from ..operators import windows as W
from .bindings import CONTENT_SQL, FILES_SQL, PACKS_SQL, PROJECTS_SQL, content_files, files, packs, projects, read
from .scalars import FLAGS_SQL, INVENTORY_SQL, inventory

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "1998-12-01 00:00:00"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def commands(spark, sf_dir):
    """Which projects have build, dev and test commands, by the inventory's sizes."""
    size = F.sum("size_bytes")
    return files(spark, sf_dir).groupBy("project_id").agg((size % 2 == 0).alias("build"), (size % 3 == 0).alias("dev"), (size % 5 == 0).alias("test"))


CHECKS_SQL = f"""{FLAGS_SQL}, cmd AS (SELECT project_id, sum(size_bytes) % 2 = 0 AS build, sum(size_bytes) % 3 = 0 AS dev, sum(size_bytes) % 5 = 0 AS test FROM files GROUP BY 1),
f AS (SELECT project_id, bool_or(is_docs) AS docs, bool_or(is_env_example) AS env, bool_or(is_test_file OR is_test_config) AS tests, bool_or(is_ci) AS ci,
    bool_or(is_readme) AS readme, bool_or(is_agents) AS agents, bool_or(is_tsconfig) AS ts FROM flags GROUP BY 1),
checks AS (""" + " UNION ALL ".join(
    f"SELECT project_id, '{k}' AS key, '{label}' AS label, {p} AS points, {c} AS passed FROM f JOIN cmd USING (project_id)"
    for (k, label, p), c in zip(L.READINESS_CHECKS, ["readme", "agents", "build", "dev", "test", "env", "ts", "tests", "docs", "ci"])
) + ")"


@query("agg_readiness_score", f"WITH {CHECKS_SQL} SELECT project_id, sum(CASE WHEN passed THEN points ELSE 0 END)::BIGINT AS score, count(*) FILTER (NOT passed AND key <> 'ci') AS n_issues FROM checks GROUP BY 1")
def readiness_score(spark, sf_dir):
    return A.readiness(files(spark, sf_dir), commands(spark, sf_dir))[1]


@query("agg_readiness_checks", f"WITH {CHECKS_SQL} SELECT * FROM checks")
def readiness_checks(spark, sf_dir):
    return A.readiness(files(spark, sf_dir), commands(spark, sf_dir))[0]


@query("agg_top_issues", f"WITH {CHECKS_SQL} SELECT lower(label) AS issue, count(DISTINCT project_id) AS n_projects, min(label) AS first_label FROM checks WHERE NOT passed GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_issues(spark, sf_dir):
    return A.top_issues(readiness_checks(spark, sf_dir))


@query("agg_count_by_kind", f"WITH {INVENTORY_SQL} SELECT project_id, string_agg(kind || '=' || n, ',' ORDER BY kind) AS counts FROM (SELECT project_id, kind, count(*) AS n FROM inventory GROUP BY ALL) GROUP BY 1")
def count_by_kind(spark, sf_dir):
    counts = A.count_by(inventory(spark, sf_dir), "project_id", "kind")
    return counts.select("project_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("agg_inventory_summary", f"""WITH {INVENTORY_SQL} SELECT project_id, count(*) AS n_files, sum(size_bytes)::BIGINT AS n_bytes, bool_or(kind = 'asset') AS has_asset, bool_or(kind = 'source') AS has_source,
    bool_or(kind = 'style') AS has_style, bool_or(kind = 'docs') AS has_docs, bool_or(kind = 'test') AS has_test, bool_or(role = 'page') AS has_page FROM inventory GROUP BY 1""")  # fmt: skip
def inventory_summary(spark, sf_dir):
    return A.inventory_summary(inventory(spark, sf_dir))


@query("agg_signals", f"""WITH {FLAGS_SQL} SELECT project_id, coalesce(array_to_string(list_sort(list_distinct(list(path) FILTER (is_docs))), ','), '') AS docs,
    coalesce(array_to_string(list_sort(list_distinct(list(path) FILTER (is_lock))), ','), '') AS locks, coalesce(array_to_string(list_sort(list_distinct(list(path) FILTER (is_config))), ','), '') AS configs FROM flags GROUP BY 1""")  # fmt: skip
def signals(spark, sf_dir):
    flags = P.readiness_flags(F.col("path"))
    found = A.signals(files(spark, sf_dir), {"docs": flags["is_docs"], "locks": flags["is_lock"], "configs": flags["is_config"]})
    return found.select("project_id", *[F.array_join(c, ",").alias(c) for c in ("docs", "locks", "configs")])


@query("agg_package_manager", f"""WITH {FILES_SQL}, n AS (SELECT project_id, string_split(path, '/')[-1] AS name FROM files)
SELECT project_id, CASE WHEN bool_or(name = 'pnpm-lock.yaml') THEN 'pnpm' WHEN bool_or(name = 'yarn.lock') THEN 'yarn' WHEN bool_or(name = 'package-lock.json') THEN 'npm' WHEN bool_or(name IN ('bun.lockb', 'bun.lock')) THEN 'bun' END AS package_manager FROM n GROUP BY 1""")  # fmt: skip
def package_manager(spark, sf_dir):
    return A.package_manager(files(spark, sf_dir))


def _manifests(spark, sf_dir):
    item = read(spark, sf_dir, "lineitem")
    prefix = F.when(F.col("l_linenumber") == 1, "root").otherwise(F.concat(F.lit("pkg"), F.col("l_linenumber").cast("string")))
    command = F.when(F.col("l_quantity") % 7 == 0, " ").otherwise(F.concat(F.lit("run "), F.col("l_partkey").cast("string")))
    pos = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    rows = item.select((F.col("l_suppkey")).alias("project_id"), (pos * 100_000 + F.col("l_partkey")).alias("pos"), prefix.alias("prefix"), F.col("l_returnflag").alias("script"), command.alias("command"))
    return rows.distinct()


_MANIFESTS = """m AS (SELECT DISTINCT l_suppkey AS project_id, (l_orderkey * 100 + l_linenumber) * 100000 + l_partkey AS pos, CASE WHEN l_linenumber = 1 THEN 'root' ELSE 'pkg' || l_linenumber END AS prefix,
    l_returnflag AS script, CASE WHEN l_quantity % 7 = 0 THEN ' ' ELSE 'run ' || l_partkey END AS command FROM lineitem),
s AS (SELECT * FROM m WHERE trim(command) <> ''), f AS (SELECT project_id, script, arg_min(command, pos) AS command, min(pos) AS pos FROM s GROUP BY ALL)"""


@query("agg_merge_scripts", f"""WITH {_MANIFESTS} SELECT project_id, script, command FROM f UNION ALL
SELECT s.project_id, s.prefix || ':' || s.script AS script, arg_max(s.command, s.pos) AS command FROM s JOIN f ON s.project_id = f.project_id AND s.script = f.script WHERE s.prefix <> 'root' OR s.pos <> f.pos GROUP BY 1, 2""")  # fmt: skip
def merge_scripts(spark, sf_dir):
    return A.merge_scripts(_manifests(spark, sf_dir))


@query("agg_merge_dependencies", f"WITH {_MANIFESTS} SELECT project_id, script AS name, arg_max(command, pos) AS version FROM m GROUP BY ALL")
def merge_dependencies(spark, sf_dir):
    return A.merge_dependencies(_manifests(spark, sf_dir).withColumnsRenamed({"script": "name", "command": "version"}))


@query("agg_readiness_summary", f"WITH {PROJECTS_SQL} SELECT nation, floor(avg(score) + 0.5)::BIGINT AS average, count(*) FILTER (score < 50) AS low, count(*) FILTER (score >= 80) AS ready FROM projects GROUP BY 1")
def readiness_summary(spark, sf_dir):
    return A.readiness_summary(projects(spark, sf_dir), "nation")


for _scheme, _bands in A.BANDS.items():
    query(f"agg_readiness_histogram_{_scheme}", f"WITH {PROJECTS_SQL} " + " UNION ALL ".join(f"SELECT '{b}' AS band, count(*) FILTER (score BETWEEN {lo} AND {hi}) AS n FROM projects" for b, lo, hi in _bands))(
        lambda spark, sf_dir, scheme=_scheme: A.readiness_histogram(projects(spark, sf_dir), scheme)
    )


@query("agg_count_signals", f"WITH {PACKS_SQL} SELECT coalesce(nullif(trim(target_tool), ''), 'unknown') AS label, count(*) AS n FROM packs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def count_signals(spark, sf_dir):
    return A.count_signals(packs(spark, sf_dir), "target_tool")


@query("agg_activity", f"""WITH {PACKS_SQL} SELECT project_id, count(*) AS n_packs, count(*) FILTER (created_at <= TIMESTAMP '{NOW}' AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS this_week, max(created_at) AS latest FROM packs GROUP BY 1""")
def activity(spark, sf_dir):
    return A.activity(packs(spark, sf_dir), F.expr(f"timestamp '{NOW}'"))


@query("agg_project_overview", f"""WITH {PROJECTS_SQL}, {PACKS_SQL}, c AS (SELECT project_id, count(*) AS n, max(created_at) AS t FROM packs GROUP BY 1)
SELECT project_id, name, score, coalesce(n, 0) AS n_packs, t AS latest_pack FROM projects LEFT JOIN c USING (project_id)""")  # fmt: skip
def project_overview(spark, sf_dir):
    return A.project_overview(projects(spark, sf_dir).select("project_id", "name", "score"), packs(spark, sf_dir))


def _diff(spark, sf_dir):
    item = read(spark, sf_dir, "lineitem")
    scope = F.when(F.col("l_returnflag") == "A", "staged").when(F.col("l_returnflag") == "N", "unstaged").otherwise("untracked")
    binary = F.col("l_quantity") % 11 == 0
    count = lambda c: F.when(~binary, F.col(c).cast("long"))
    return item.select(F.col("l_suppkey").alias("project_id"), scope.alias("scope"), binary.alias("binary"), count("l_quantity").alias("additions"), count("l_linenumber").alias("deletions"))


@query("agg_diff_totals", """SELECT l_suppkey AS project_id, count(*) AS files, sum(CASE WHEN l_quantity % 11 = 0 THEN 0 ELSE l_quantity END)::BIGINT AS additions, sum(CASE WHEN l_quantity % 11 = 0 THEN 0 ELSE l_linenumber END)::BIGINT AS deletions,
    count(*) FILTER (l_quantity % 11 = 0) AS binary_files, count(*) FILTER (l_returnflag = 'A') AS staged, count(*) FILTER (l_returnflag = 'N') AS unstaged, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS untracked FROM lineitem GROUP BY 1""")  # fmt: skip
def diff_totals(spark, sf_dir):
    return A.diff_totals(_diff(spark, sf_dir))


def _fingerprint_sql(line: str) -> str:
    return f"""WITH {CONTENT_SQL}, l AS (SELECT project_id, left(sha256(path), 4) AS bucket, {line} || chr(10) AS line FROM content_files),
b AS (SELECT project_id, bucket || ':' || sha256(string_agg(line, '' ORDER BY line)) || chr(10) AS part FROM l GROUP BY project_id, bucket)
SELECT project_id, sha256(string_agg(part, '' ORDER BY part)) AS fingerprint FROM b GROUP BY project_id"""


@query("agg_fingerprint", _fingerprint_sql("path || ':' || sha256(content)"))
def fingerprint(spark, sf_dir):
    return A.fingerprint(content_files(spark, sf_dir), "content")


@query("agg_fingerprint_paths", _fingerprint_sql("path"))
def fingerprint_paths(spark, sf_dir):
    return A.fingerprint(content_files(spark, sf_dir))


def trace(spark, sf_dir):
    """Events as trace records: a user's day is a session, an hour a request."""
    kind = F.when(F.col("event_type") == "error", "miss").when(F.col("event_type") == "view", "hit").when(F.col("event_type") == "click", "ai").otherwise("stage")
    return read(spark, sf_dir, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"), F.hour("ts").alias("request_id"), kind.alias("kind"), F.col("value").alias("duration")
    )


_TRACE = """t AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, hour(ts)::INT AS request_id, CASE event_type WHEN 'error' THEN 'miss' WHEN 'view' THEN 'hit' WHEN 'click' THEN 'ai' ELSE 'stage' END AS kind, value AS duration FROM events),
r AS (SELECT session_id, request_id, count(*) AS stages, count(*) FILTER (kind = 'ai') AS ai_calls, round(sum(CASE WHEN kind = 'ai' THEN duration ELSE 0 END), 1) AS ai_ms, count(*) FILTER (kind = 'hit') AS hits,
    count(*) FILTER (kind = 'miss') AS misses, round(sum(duration), 1) AS total_ms, bool_or(kind = 'hit') AS warm FROM t GROUP BY ALL)"""


@query("agg_request_summary")
def request_summary(spark, sf_dir):
    return A.request_summary(trace(spark, sf_dir))


@query("agg_request_counts", f"WITH {_TRACE} SELECT session_id, request_id, stages, ai_calls, hits, misses, warm FROM r")
def request_counts(spark, sf_dir):
    return A.request_summary(trace(spark, sf_dir)).drop("ai_ms", "total_ms")


@query("agg_session_summary", f"WITH {_TRACE} SELECT session_id, count(*) AS requests, sum(stages)::BIGINT AS stages, sum(ai_calls)::BIGINT AS ai_calls, sum(hits)::BIGINT AS hits, sum(misses)::BIGINT AS misses, floor(coalesce(sum(hits) * 100 / nullif(sum(hits) + sum(misses), 0), 0) + 0.5)::BIGINT AS hit_rate FROM r GROUP BY 1")
def session_summary(spark, sf_dir):
    return A.session_summary(A.request_summary(trace(spark, sf_dir))).drop("ai_ms", "total_ms", "ai_share")


@query("agg_calibration", """WITH o AS (SELECT (doc_id * 37) % 101 AS confidence, quality = 1 AS passed FROM labels),
g AS (SELECT CASE WHEN confidence < 30 THEN '0-29' WHEN confidence < 60 THEN '30-59' WHEN confidence < 80 THEN '60-79' ELSE '80-100' END AS bucket, count(*) AS n, avg(confidence) AS mean, avg(passed::INT) AS observed FROM o GROUP BY 1)
SELECT bucket, n, round(mean, 6) AS mean, round(observed, 6) AS observed, round(abs(mean / 100 - observed), 6) AS gap FROM g""")  # fmt: skip
def calibration(spark, sf_dir):
    return A.calibration(read(spark, sf_dir, "labels").select(((F.col("doc_id") * 37) % 101).alias("confidence"), (F.col("quality") == 1).alias("passed")))


@query("win_latest_pack", f"WITH {PACKS_SQL} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, pack_id DESC) AS rn FROM packs) WHERE rn = 1")
def latest_pack(spark, sf_dir):
    return W.latest_per_key(packs(spark, sf_dir), "project_id", "created_at", "pack_id")


@query("win_top_k", f"WITH {PACKS_SQL} SELECT project_id, pack_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY duration_ms DESC, pack_id)::INT AS rank FROM packs) WHERE rank <= 8")
def top_k(spark, sf_dir):
    return W.top_k_per_key(packs(spark, sf_dir), ["project_id"], [F.desc("duration_ms"), F.col("pack_id")], 8).select("project_id", "pack_id", "rank")


@query("win_best_with_margin", """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS spot, lead(o_totalprice) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))
SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE spot = 1 AND (nxt IS NULL OR o_totalprice - nxt >= 40000)""")
def margin(spark, sf_dir):
    return W.best_with_margin(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey", 40000)


@query("win_relative_threshold", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders) WHERE o_totalprice >= greatest(32000, top * 0.62)""")
def threshold(spark, sf_dir):
    return W.relative_threshold(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", 0.62, 32000)


@query("win_first_by_key", "SELECT l_suppkey, l_partkey, l_orderkey FROM (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey) AS rn FROM lineitem) WHERE rn = 1")
def first_by_key(spark, sf_dir):
    return W.first_by_key(read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey"), ["l_suppkey", "l_partkey"], "l_orderkey")


@query("win_stratified", """WITH b AS (SELECT *, o_custkey % 50 AS task, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_totalprice DESC, o_orderkey) AS best FROM orders),
u AS (SELECT *, o_orderpriority = '1-URGENT' AND sum((o_orderpriority = '1-URGENT')::INT) OVER (PARTITION BY task ORDER BY best) <= 3 AS in_u FROM b),
o AS (SELECT *, NOT in_u AND o_orderstatus = 'O' AND sum((NOT in_u AND o_orderstatus = 'O')::INT) OVER (PARTITION BY task ORDER BY best) <= 2 AS in_o FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY CASE WHEN in_u THEN 0 WHEN in_o THEN 1 ELSE 2 END, best)::INT AS rank FROM o)
SELECT task, o_orderkey, CASE WHEN in_u THEN 'urgent' WHEN in_o THEN 'open' ELSE 'fill' END AS stratum, rank FROM r WHERE rank <= 12""")
def stratified(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("task", F.col("o_custkey") % 50)
    strata = {"urgent": (F.col("o_orderpriority") == "1-URGENT", 3), "open": (F.col("o_orderstatus") == "O", 2)}
    return W.stratified_window(rows, "task", strata, [F.desc("o_totalprice"), F.col("o_orderkey")], 12).select("task", "o_orderkey", "stratum", "rank")


@query("srt_slowest_stages", "SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 4")
def slowest(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "event_type", "value").orderBy(F.desc("value"), "event_id").limit(4)


@query("srt_merge_top", """SELECT source, id, score FROM (SELECT 'part' AS source, p_partkey AS id, p_retailprice AS score, 0 AS pos FROM part UNION ALL SELECT 'customer', c_custkey, c_acctbal, 1 FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, 2 FROM supplier)
ORDER BY score DESC, pos, id LIMIT 48""")
def merge_top(spark, sf_dir):
    one = lambda t, k, v, n: read(spark, sf_dir, t).select(F.lit(t).alias("source"), F.col(k).alias("id"), F.col(v).alias("score"), F.lit(n).alias("pos"))
    rows = one("part", "p_partkey", "p_retailprice", 0).unionByName(one("customer", "c_custkey", "c_acctbal", 1)).unionByName(one("supplier", "s_suppkey", "s_acctbal", 2))
    return rows.orderBy(F.desc("score"), "pos", "id").limit(48).drop("pos")


@query("prj_attention", f"""WITH {PROJECTS_SQL} SELECT project_id, score, scanned_at, CASE WHEN score < 60 THEN 'raise' ELSE 'rescan' END AS action FROM projects WHERE score < 60 OR scanned_at < TIMESTAMP '1999-01-15 00:00:00' - INTERVAL 7 DAY""")
def attention(spark, sf_dir):
    low = F.col("score") < 60
    stale = F.col("scanned_at") < F.expr("timestamp '1999-01-15 00:00:00' - interval 7 days")
    return projects(spark, sf_dir).filter(low | stale).select("project_id", "score", "scanned_at", F.when(low, "raise").otherwise("rescan").alias("action"))


@query("prj_readiness_band", f"WITH {PROJECTS_SQL} SELECT project_id, CASE WHEN score >= 80 THEN 'ready' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'low' END AS band FROM projects")
def band(spark, sf_dir):
    s = F.col("score")
    return projects(spark, sf_dir).select("project_id", F.when(s >= 80, "ready").when(s >= 60, "good").when(s >= 40, "fair").otherwise("low").alias("band"))
