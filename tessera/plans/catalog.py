"""Queries of lists, searches, defaults, digests and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import locks as K
from .bindings import PACKS_SQL, PROJECTS_SQL, packs, projects, read, tasks_for

QUERIES: dict = {}
SQL: dict[str, str] = {}
KINDS = ["A", "N", "R", "X"]


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


@query("prj_page", f"WITH {PACKS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY created_at DESC, pack_id DESC)::INT AS position, count(*) OVER (PARTITION BY task_type) AS total FROM packs) SELECT task_type, pack_id, position, total, CASE WHEN total > 120 THEN 120 END::INT AS next_offset FROM n WHERE position BETWEEN 21 AND 120")
def page(spark, sf_dir):
    """The second page of each type's packs, newest first; a limit of 500 is clamped to 100."""
    return C.page(packs(spark, sf_dir), [F.desc("created_at"), F.desc("pack_id")], 500, 20, ["task_type"]).select("task_type", "pack_id", "position", "total", "next_offset")


@query("agg_catalog_stats", "WITH k AS (SELECT unnest(['A', 'N', 'R', 'X']) AS kind) SELECT kind, count(l_returnflag) AS n FROM k LEFT JOIN lineitem ON l_returnflag = kind GROUP BY 1")
def catalog_stats(spark, sf_dir):
    return C.counts_of_kinds(read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind")), KINDS)


@query("jon_default_by_key", """WITH t AS MATERIALIZED (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'generic' ELSE p_brand END AS tool, CASE WHEN p_partkey % 2 = 0 THEN 'general' ELSE p_type END AS type, min(p_partkey) AS template_id FROM part GROUP BY ALL),
r AS MATERIALIZED (SELECT DISTINCT l_orderkey * 10000000 + l_partkey AS request_id, p_brand AS tool, p_type AS type FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT request_id, 0 AS level, tool, type FROM r UNION ALL SELECT request_id, 1, tool, 'general' FROM r UNION ALL SELECT request_id, 2, 'generic', type FROM r UNION ALL SELECT request_id, 3, 'generic', 'general' FROM r),
b AS (SELECT request_id, arg_min(template_id, level) AS template_id, min(level)::INT AS level FROM w JOIN t USING (tool, type) GROUP BY 1) SELECT request_id, template_id, level FROM r LEFT JOIN b USING (request_id)""")
def default_by_key(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    templates = part.select(k.alias("template_id"), F.when(k % 3 == 0, "generic").otherwise(F.col("p_brand")).alias("tool"), F.when(k % 2 == 0, "general").otherwise(F.col("p_type")).alias("type"))
    asked = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == k)
    requests = asked.select((F.col("l_orderkey") * 10_000_000 + F.col("l_partkey")).alias("request_id"), F.col("p_brand").alias("tool"), F.col("p_type").alias("type"))
    return C.default_by_key(requests.repartition(tasks_for(read(spark, sf_dir, "lineitem")), "request_id").distinct(), templates)


@query("jon_merge_diff_stats", """WITH s AS (SELECT l_suppkey AS project_id, 'f' || l_partkey AS path, sum(l_quantity)::BIGINT AS additions, sum(l_linenumber)::BIGINT AS deletions, bool_or(l_quantity % 11 = 0) AS "binary" FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
n AS (SELECT DISTINCT l_suppkey AS project_id, 'f' || l_partkey AS path, l_linestatus AS status FROM lineitem) SELECT project_id, path, status, coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions, coalesce("binary", false) AS "binary" FROM n LEFT JOIN s USING (project_id, path)""")
def merge_diff_stats(spark, sf_dir):
    item = read(spark, sf_dir, "lineitem").withColumns({"project_id": F.col("l_suppkey"), "path": F.concat(F.lit("f"), F.col("l_partkey").cast("string"))})
    stats = item.filter("l_returnflag = 'A'").select("project_id", "path", F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").cast("long").alias("deletions"), (F.col("l_quantity") % 11 == 0).alias("binary"))
    return C.merge_diff_stats(item.select("project_id", "path", F.col("l_linestatus").alias("status")).distinct(), stats)


@query("agg_primary_project", f"""WITH {PROJECTS_SQL}, {PACKS_SQL}, e AS (SELECT nation AS owner, project_id, 'attention' AS reason, 0 AS a, score::DOUBLE AS b FROM projects WHERE score < 60 UNION ALL SELECT nation, project_id, 'latest-pack', 1, -epoch(created_at) FROM projects JOIN packs USING (project_id)
UNION ALL SELECT nation, project_id, 'latest-scan', 2, -epoch(scanned_at) FROM projects) SELECT owner, arg_min(project_id, (a, b, project_id)) AS project_id, arg_min(reason, (a, b, project_id)) AS reason FROM e GROUP BY 1""")
def primary_project(spark, sf_dir):
    return C.primary_project(projects(spark, sf_dir).withColumnRenamed("nation", "owner"), packs(spark, sf_dir).select("project_id", "pack_id", "created_at"))


@query("agg_case_digest", """WITH c AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS split, doc_id AS case_id, left(sha256(doc_id::VARCHAR), 3) AS bucket, sha256('quality=' || coalesce(quality::VARCHAR, '') || chr(10) || 'toxic=' || coalesce(toxic::VARCHAR, '')) AS d FROM labels),
p AS (SELECT split, bucket, count(*) AS n, sha256(string_agg(d, chr(10) ORDER BY case_id)) AS d FROM c GROUP BY ALL) SELECT split, sum(n)::BIGINT AS n_cases, sha256(string_agg(d, chr(10) ORDER BY bucket)) AS digest FROM p GROUP BY 1""")
def case_digest(spark, sf_dir):
    cases = read(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("poor").alias("split"), F.col("doc_id").alias("case_id"), "quality", "toxic")
    return C.case_digest(cases, ["toxic", "quality"])


@query("agg_validation_coverage", """SELECT count(*) AS n_cases, count(DISTINCT o_custkey % 30) AS families, count(DISTINCT o_custkey) AS projects, count(DISTINCT o_orderstatus) AS areas, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS severities,
    count(*) FILTER (o_orderkey % 5 > 0) AS with_targets, count(*) FILTER (o_orderkey % 3 > 0) AS with_exclusions FROM orders""")
def validation_coverage(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return C.validation_coverage(o.select((F.col("o_custkey") % 30).alias("family"), F.col("o_custkey").alias("project"), F.col("o_orderstatus").alias("area"), F.col("o_orderpriority").alias("severity"), (F.col("o_orderkey") % 5).alias("n_targets"), (F.col("o_orderkey") % 3).alias("n_excluded")))


@query("agg_expectations", """WITH l AS (SELECT l_orderkey AS case_id, list_distinct(list(l_suppkey)) AS paths, sum(l_quantity) AS score, max(l_linenumber) AS ms FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 4 > 0 THEN [o_custkey % 10, (o_custkey + 1) % 10] END AS expected, CASE WHEN o_orderkey % 3 > 0 THEN [o_orderkey % 10] END AS excluded, CASE WHEN o_orderkey % 2 = 0 THEN 60 END AS least_score, CASE WHEN o_orderkey % 5 = 0 THEN 4 END AS most_ms FROM orders),
f AS (SELECT c.case_id, l.case_id IS NULL AS gone, concat_ws(',', CASE WHEN len(list_filter(expected, lambda x: NOT list_contains(paths, x))) > 0 THEN 'missing-path' END, CASE WHEN list_has_any(excluded, paths) THEN 'excluded-path' END, CASE WHEN score < least_score THEN 'low-score' END, CASE WHEN ms > most_ms THEN 'slow' END) AS failures FROM c LEFT JOIN l ON c.case_id = l.case_id)
SELECT case_id, failures, CASE WHEN gone THEN 'observed' WHEN failures <> '' THEN 'failed' ELSE 'passed' END AS status FROM f""")
def expectations(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cases = read(spark, sf_dir, "orders").select(k.alias("case_id"), F.when(k % 4 > 0, F.array(c % 10, (c + 1) % 10)).alias("expected"), F.when(k % 3 > 0, F.array(k % 10)).alias("excluded"), F.when(k % 2 == 0, 60).alias("least_score"), F.when(k % 5 == 0, 4).alias("most_ms"))
    actual = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_set("l_suppkey").alias("paths"), F.sum("l_quantity").alias("score"), F.max("l_linenumber").alias("ms"))
    return C.expectations(cases, actual)


@query("agg_verify_records", "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 > 0 THEN c_name END AS name, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS body, c_custkey % 7 > 0 AS intact FROM customer")
def verify_records(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("body"))
    digest = F.sha2(F.concat_ws("\n", "name", F.when(F.col("id") % 7 == 0, "other").otherwise(F.col("body"))), 256)
    return C.verify_records(rows.withColumn("digest", digest), ["name", "body"]).select("id", "name", "body", "intact")


@query("set_dedupe_pairs", """WITH p AS (SELECT conv_id, turn, trim(regexp_replace(role, '\\s+', ' ', 'g')) AS question, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS answer FROM conversations),
f AS (SELECT conv_id, min(turn) AS pos, arg_min(question, turn) AS question, arg_min(answer, turn) AS answer FROM p WHERE question <> '' AND answer <> '' GROUP BY conv_id, lower(question), lower(answer)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos)::INT AS rank FROM f) SELECT conv_id AS task_id, question, answer, rank FROM r WHERE rank <= 8""")
def dedupe_pairs(spark, sf_dir):
    return C.dedupe_pairs(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("pos"), F.col("role").alias("question"), F.col("text").alias("answer")))


@query("fn_staleness", f"WITH {PROJECTS_SQL} SELECT project_id, scanned_at < TIMESTAMP '1999-01-15 00:00:00' - INTERVAL 7 DAY AS stale FROM projects")
def stale(spark, sf_dir):
    return projects(spark, sf_dir).select("project_id", C.staleness(F.col("scanned_at"), F.expr("timestamp '1999-01-15 00:00:00'")).alias("stale"))


@query("fn_json_stage", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'direct' WHEN 1 THEN 'fenced' WHEN 2 THEN 'fragment' WHEN 3 THEN 'truncated' WHEN 4 THEN 'empty' ELSE 'invalid' END AS stage FROM part""")
def json_stage(spark, sf_dir):
    good = F.to_json(F.struct("p_name", "p_brand"))
    made = [good, F.concat(F.lit("Here:\n```json\n"), good, F.lit("\n```")), F.concat(F.lit("Sure "), good, F.lit(" done")), F.concat(F.lit("{"), good), F.lit("  "), F.col("p_name")]
    text = F.element_at(F.array(*made), (F.col("p_partkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", C.json_stage(text).alias("stage"))


@query("fn_rename_intent", "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'old' || p_partkey END AS old, CASE WHEN p_partkey % 3 > 0 THEN 'new' || p_size END AS new FROM part")
def rename_intent(spark, sf_dir):
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Improve "), "p_name")).otherwise(F.concat(F.lit("Please rename `old"), k, F.lit("` to new"), size, F.lit(" everywhere")))
    return read(spark, sf_dir, "part").select("p_partkey", C.rename_intent(text).alias("r")).select("p_partkey", "r.old", "r.new")


@query("jon_route_in_text", "SELECT p_partkey AS task_id, '/items/' || p_partkey AS route, p_partkey AS owner FROM part WHERE p_partkey % 2 = 0")
def route_in_text(spark, sf_dir):
    """Tasks that name a route, and the part that owns it; half of the routes have no owner."""
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    tasks = part.select(F.col("p_partkey").alias("task_id"), F.explode(C.route_mentions(F.concat(F.lit("Fix /Items/"), k, F.lit("/ and see src/a.ts."))) ).alias("route"))
    owners = part.filter("p_partkey % 2 = 0").select(F.concat(F.lit("/items/"), k).alias("route"), F.col("p_partkey").alias("owner"))
    return tasks.join(owners, "route").select("task_id", "route", "owner")


@query("agg_selection_confidence", "SELECT l_orderkey AS task_id, greatest(0, least(100, floor(avg(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber / 8 * 100 ELSE l_quantity + 1 END) + 0.5)))::BIGINT AS confidence FROM lineitem GROUP BY 1")
def selection_confidence(spark, sf_dir):
    value = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") / 8).otherwise(F.col("l_quantity") + 1)
    return C.selection_confidence(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), value.alias("confidence")))


_LOCKS = """sealed AS (SELECT 'cases' AS scope, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS name, doc_id::VARCHAR AS item, coalesce(toxic::VARCHAR, '-') AS v FROM labels UNION ALL SELECT 'project', source, doc_id::VARCHAR, text FROM documents WHERE doc_id % 101 > 0),
present AS (SELECT 'cases' AS scope, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS name, doc_id::VARCHAR AS item, coalesce(toxic::VARCHAR, '-') AS v FROM labels UNION ALL SELECT 'project', source, doc_id::VARCHAR, text || CASE WHEN doc_id % 97 = 0 THEN '!' ELSE '' END FROM documents WHERE doc_id % 103 > 0),
d AS (SELECT scope, name, item, t.v IS NOT NULL AS was, n.v IS NOT NULL AS is_now, t.v IS DISTINCT FROM n.v AS differs, left(sha256(item), 4) AS bucket FROM sealed t FULL JOIN present n USING (scope, name, item))"""


def _locks(spark, sf_dir):
    """Documents and labels sealed, and as they are now: some documents are new, some gone, some changed."""
    labels, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents")
    cases = labels.select(F.when(F.col("quality") == 1, "good").otherwise("poor").alias("split"), F.col("doc_id").alias("case_id"), "toxic")
    files = docs.select(F.col("source").alias("project_id"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "doc_id")
    changed = files.filter("doc_id % 103 > 0").withColumn("content", F.concat("content", F.when(F.col("doc_id") % 97 == 0, "!").otherwise("")))
    return K.items(cases, files.filter("doc_id % 101 > 0"), ["toxic"]), K.items(cases, changed, ["toxic"])


@query("agg_lock_verify", f"WITH {_LOCKS} SELECT scope, name, NOT bool_or(differs) AS verified, count(DISTINCT bucket) FILTER (differs) AS changed_buckets, count(*) FILTER (was) AS n_then, count(*) FILTER (is_now) AS n_now FROM d GROUP BY ALL")
def lock_verify(spark, sf_dir):
    then, now = _locks(spark, sf_dir)
    return K.verify(K.buckets(then), K.buckets(now))


@query("agg_lock_changes", f"WITH {_LOCKS} SELECT scope, name, item, CASE WHEN NOT was THEN 'added' WHEN NOT is_now THEN 'removed' ELSE 'changed' END AS change FROM d WHERE differs")
def lock_changes(spark, sf_dir):
    then, now = _locks(spark, sf_dir)
    return K.changes(then, now, K.buckets(then), K.buckets(now))
