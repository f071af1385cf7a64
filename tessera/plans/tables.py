"""Queries of the readers, sinks and streaming jobs' batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers as R
from ..sources import sinks as K
from ..streaming import jobs as S
from .bindings import FILES_SQL, files, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


@query("src_tree", f"""WITH {FILES_SQL}, s AS (SELECT project_id, string_split(path, '/') AS s FROM files), d AS (SELECT project_id, s, unnest(range(1, len(s))) AS n FROM s),
t AS (SELECT project_id, array_to_string(s, '/') AS path, false AS is_dir FROM s UNION ALL SELECT DISTINCT project_id, array_to_string(s[1:n], '/'), true FROM d) SELECT * FROM t WHERE len(string_split(path, '/')) <= 5""")  # fmt: skip
def tree(spark, sf_dir):
    return R.tree(files(spark, sf_dir))


def _log(spark, sf_dir, *parts, sep="\t"):
    """One log for each supplier, made of its order lines."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("project_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("o"), F.concat_ws(sep, *parts).alias("line"))
    return rows.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n").alias("raw"))


@query("src_numstat", """SELECT l_suppkey AS project_id, 'src/f' || l_partkey || '.ts' AS path, CASE WHEN l_quantity % 11 = 0 THEN NULL ELSE l_quantity::BIGINT END AS additions, CASE WHEN l_quantity % 11 = 0 THEN NULL ELSE l_linenumber::BIGINT END AS deletions, l_quantity % 11 = 0 AS binary FROM lineitem""")
def numstat(spark, sf_dir):
    dash = F.col("l_quantity") % 11 == 0
    count = lambda c: F.when(dash, "-").otherwise(F.col(c).cast("long").cast("string"))
    return R.parse_numstat(_log(spark, sf_dir, count("l_quantity"), count("l_linenumber"), F.concat(F.lit("src/f"), F.col("l_partkey").cast("string"), F.lit(".ts"))))


@query("src_name_status", """SELECT l_suppkey AS project_id, 'staged' AS scope, CASE WHEN l_returnflag = 'R' THEN 'new/' ELSE 'src/' END || l_partkey AS path, CASE WHEN l_returnflag = 'R' THEN 'src/' || l_partkey END AS original_path,
    CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'renamed' ELSE 'unknown' END AS status FROM lineitem""")
def name_status(spark, sf_dir):
    part = F.col("l_partkey").cast("string")
    moved = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("new/"), part))
    code = F.when(F.col("l_returnflag") == "R", "R100").otherwise(F.col("l_returnflag"))
    return R.parse_name_status(_log(spark, sf_dir, code, F.concat(F.lit("src/"), part), moved), "staged")


@query("src_status", """WITH l AS (SELECT o_custkey AS project_id, o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '??' WHEN 1 THEN 'M ' WHEN 2 THEN ' M' WHEN 3 THEN 'MD' ELSE 'R ' END AS xy FROM orders)
SELECT project_id, 'untracked' AS scope, 'f' || k AS path, NULL AS original_path, 'untracked' AS status FROM l WHERE xy = '??' UNION ALL SELECT project_id, 'staged', 'f' || k, CASE WHEN xy = 'R ' THEN 'old' || k END, CASE WHEN xy = 'R ' THEN 'renamed' ELSE 'modified' END FROM l WHERE xy IN ('M ', 'MD', 'R ')
UNION ALL SELECT project_id, 'unstaged', 'f' || k, NULL, CASE WHEN xy = 'MD' THEN 'deleted' ELSE 'modified' END FROM l WHERE xy IN (' M', 'MD')""")
def status(spark, sf_dir):
    k = F.col("o_orderkey")
    xy = F.element_at(F.array(*[F.lit(x) for x in ("??", "M ", " M", "MD", "R ")]), (k % 5 + 1).cast("int"))
    entry = F.concat(xy, F.lit(" f"), k.cast("string"), F.when(k % 5 == 4, F.concat(F.lit("\0old"), k.cast("string"))).otherwise(""))
    logs = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "\0").alias("raw"))
    return R.parse_status(logs)


@query("src_commits", "SELECT o_custkey AS project_id, md5(o_orderkey::VARCHAR) AS hash, left(md5(o_orderkey::VARCHAR), 7) AS short_hash, 'order ' || o_orderkey AS subject, o_orderpriority AS author, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def commits(spark, sf_dir):
    h = F.md5(F.col("o_orderkey").cast("string"))
    raw = F.concat_ws("\x1f", h, F.left(h, F.lit(7)), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return R.parse_commits(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), raw.alias("raw")))


@query("src_issues", """SELECT o_orderkey AS number, o_orderpriority AS title, o_orderstatus AS state FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 <> 0 AND contains(lower('#' || o_orderkey || ' ' || o_orderpriority), 'urgent')""")
def issues(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("title"), F.lit("").alias("body"), F.array(F.lit("x")).alias("labels"), F.lit("me").alias("author"), F.col("o_orderstatus").alias("state"), (F.col("o_orderkey") % 3 == 0).alias("is_pull_request")
    )
    return R.normalize_issues(rows, "O", "Urgent").select("number", "title", "state")


@query("src_manifests", """SELECT p_partkey AS project_id, 'package.json' AS path, p_name AS name, p_brand AS dev FROM part WHERE p_partkey % 4 <> 0""")
def manifests(spark, sf_dir):
    good = F.to_json(F.struct(F.col("p_name").alias("name"), F.create_map(F.lit("dev"), F.col("p_brand")).alias("scripts")))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("project_id"), F.lit("package.json").alias("path"), F.when(F.col("p_partkey") % 4 == 0, "{broken").otherwise(good).alias("content"))
    return R.read_manifests(rows).select("project_id", "path", "manifest.name", F.try_element_at("manifest.scripts", F.lit("dev")).alias("dev"))


def _people(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("/p/"), F.col("c_custkey").cast("string")).alias("local_path"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"), F.lit("old").alias("updated_at"))


@query("snk_upsert", """WITH c AS (SELECT c_custkey AS id, '/p/' || c_custkey AS local_path, c_name AS name, c_acctbal AS score, 'old' AS updated_at FROM customer WHERE c_custkey % 3 <> 0),
f AS (SELECT c_custkey + 1000000 AS id, '/p/' || c_custkey AS local_path, 'new' AS name, 0.0 AS score, 'scan' AS updated_at FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(c.id, f.id) AS id, coalesce(c.local_path, f.local_path) AS local_path, coalesce(f.name, c.name) AS name, coalesce(f.score, c.score) AS score, CASE WHEN f.id IS NOT NULL THEN 'now' ELSE c.updated_at END AS updated_at FROM c FULL JOIN f ON c.local_path = f.local_path""")  # fmt: skip
def upsert(spark, sf_dir):
    people = _people(spark, sf_dir)
    fresh = people.filter("id % 2 = 0").select((F.col("id") + 1_000_000).alias("id"), "local_path", F.lit("new").alias("name"), F.lit(0.0).alias("score"), F.lit("scan").alias("updated_at"))
    return K.upsert(people.filter("id % 3 <> 0"), fresh, "local_path", ["id"], F.lit("now"))


@query("snk_patch", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN 'patched' ELSE c_name END AS name, c_acctbal AS score FROM customer")
def patch(spark, sf_dir):
    people = _people(spark, sf_dir).select("id", "name", "score")
    patches = people.filter("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, "patched").alias("name"))
    return K.patch(people, patches, "id")


@query("snk_upsert_kv", "SELECT user_id AS key, arg_max(event_type, (ts, event_type)) AS value, max(ts) AS updated_at FROM events GROUP BY 1")
def upsert_kv(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("ts").alias("updated_at"), "event_id")
    return K.upsert_kv(rows.filter("event_id % 2 = 0").drop("event_id"), rows.filter("event_id % 2 = 1").drop("event_id"))


@query("snk_delete", "SELECT n_nationkey AS id, n_nationkey IN (SELECT c_nationkey FROM customer) AS existed FROM nation")
def delete(spark, sf_dir):
    return K.delete_rows(read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "id"), read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), ["id"])[1]


@query("snk_keep_last", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50")
def keep_last(spark, sf_dir):
    return K.keep_last(read(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("str_sessions", """WITH e AS (SELECT user_id AS session_id, ts, event_type, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT session_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS records, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'error') AS misses FROM s GROUP BY session_id, n""")  # fmt: skip
def sessions(spark, sf_dir):
    found = S.sessions(S.read_events(spark, sf_dir))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("str_audit_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def audit_counts(spark, sf_dir):
    return S.audit_counts(S.read_events(spark, sf_dir)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str_reuse", """WITH r AS (SELECT event_id AS id, user_id AS key, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT id, key, CASE WHEN before IS NULL THEN 'absent' WHEN ts - before > INTERVAL 20 MINUTE THEN 'expired' ELSE 'fresh' END AS reason, before IS NOT NULL AND ts - before <= INTERVAL 20 MINUTE AS hit FROM r""")
def reuse(spark, sf_dir):
    rows = S.read_events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("session_id").alias("key"), "ts")
    return S.reuse(rows, 20 * 60).select("id", "key", "reason", "hit")
