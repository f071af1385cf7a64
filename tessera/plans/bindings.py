"""How the operators' tables are bound to the given tables, for Spark and, as common table expressions, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders, file endings and fixed names that the path inventory is dealt over. Fixed values.
FOLDERS = [
    "", "src", "src/app", "src/app/(shop)/orders/[id]", "src/components", "src/components/ui", "server/src/services",
    "server/src/routes", "apps/web/src/pages", "apps/web/src/hooks", "packages/core/src/lib", "server/db", "docs", "tests",
    "dist/assets", "src/store", "src/types", "server/src/repositories", ".github/workflows", "app/api/items", "electron",
    "client/services", "logs", "src/generated",
]
ENDINGS = [".ts", ".tsx", ".js", ".css", ".md", ".json", ".png", ".test.ts", ".sql", ".py", ".log", ".csv", ".d.ts", ".svg", ".yml", ".vue"]
NAMES = [
    "package.json", "README.md", "page.tsx", "route.ts", "layout.tsx", ".env", ".env.example", "vite.config.ts",
    "schema.prisma", "useItems.ts", "OrderService.ts", "api.ts", "server.ts", "index.tsx", "pnpm-lock.yaml", "AGENTS.md",
    "tsconfig.json", "ci.yml", "config.ts", "auth.ts", "db.ts", "types.ts", "Button.tsx", "main.tsx", "docker-compose.yml",
    "middleware.ts", "data.sqlite", "vitest.config.ts", "formatters.ts",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over three tasks a core, for small rows that texts are made of.

    A reader cuts a file by its bytes, so the one or two tasks of a small file would make and take apart all of these.
    """
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


#: Rows of a query's shuffles that one task takes, about.
TASK_ROWS = 200_000


def tasks_for(df: DataFrame) -> int:
    """How many tasks the rows of a given table are shuffled over, so that a task holds no more of a larger table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def _pick(values: list[str], at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, project_id, path, size_bytes): the path that each part stands for; several may stand for one."""
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("int")
    slug = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), k.cast("string"), _pick(ENDINGS, k % len(ENDINGS)))
    name = F.when(k % 3 == 0, _pick(NAMES, F.floor(k / 3).cast("int") % len(NAMES))).otherwise(slug)
    folder = _pick(FOLDERS, F.floor(k / 2).cast("int") % len(FOLDERS))
    path = F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), name)
    return part.select(k.alias("part"), F.concat(F.lit("p"), (k % 20).cast("string")).alias("project_id"), path.alias("path"), F.col("p_size").cast("long").alias("size_bytes"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, path, size_bytes): a path inventory of 20 projects, dealt out by part key."""
    # The path as an aggregate: filters on it stay above, so that its long expression is computed once.
    once = part_files(spark, sf_dir).groupBy("project_id", "path").agg(F.min("size_bytes").alias("size_bytes"), F.min("path").alias("own"))
    return once.select("project_id", F.col("own").alias("path"), "size_bytes")


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


FILES_SQL = f"""files AS (SELECT 'p' || (p_partkey % 20) AS project_id,
    CASE WHEN folder = '' THEN '' ELSE folder || '/' END || name AS path, min(p_size)::BIGINT AS size_bytes
    FROM (SELECT *, {_sql_list(FOLDERS)}[((p_partkey // 2) % {len(FOLDERS)} + 1)::INT] AS folder,
        CASE WHEN p_partkey % 3 = 0 THEN {_sql_list(NAMES)}[((p_partkey // 3) % {len(NAMES)} + 1)::INT]
        ELSE replace(p_name, ' ', '-') || '-' || p_partkey || {_sql_list(ENDINGS)}[(p_partkey % {len(ENDINGS)} + 1)::INT] END AS name FROM part)
    GROUP BY ALL)"""


def content_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, path, content, size_bytes) of documents: a source is a project, a document a file."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return docs.select(F.col("source").alias("project_id"), path.alias("path"), F.col("text").alias("content"), F.col("n_chars").cast("long").alias("size_bytes"))


CONTENT_SQL = "content_files AS (SELECT source AS project_id, lang || '/' || doc_id || '.md' AS path, text AS content, n_chars::BIGINT AS size_bytes FROM documents)"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, raw_task): what users ask in conversations."""
    talk = read(spark, sf_dir, "conversations").filter("role = 'user'")
    return talk.select((F.col("conv_id") * 1000 + F.col("turn")).alias("task_id"), F.col("text").alias("raw_task"))


TASKS_SQL = "tasks AS (SELECT conv_id * 1000 + turn AS task_id, text AS raw_task FROM conversations WHERE role = 'user')"


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, name, score, scanned_at, nation): suppliers as projects."""
    s = read(spark, sf_dir, "supplier")
    score = (F.abs(F.floor("s_acctbal")) % 101).cast("int")
    scanned = F.expr("timestamp '1999-01-01 00:00:00' + make_interval(0, 0, 0, cast(s_suppkey % 20 as int))")
    return s.select(F.col("s_suppkey").alias("project_id"), F.col("s_name").alias("name"), score.alias("score"), scanned.alias("scanned_at"), F.col("s_nationkey").alias("nation"))


PROJECTS_SQL = """projects AS (SELECT s_suppkey AS project_id, s_name AS name, (abs(floor(s_acctbal)) % 101)::INT AS score,
    TIMESTAMP '1999-01-01 00:00:00' + to_days((s_suppkey % 20)::INT) AS scanned_at, s_nationkey AS nation FROM supplier)"""


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_id, project_id, target_tool, task_type, created_at): orders as task packs of the suppliers' projects."""
    o, s = read(spark, sf_dir, "orders"), read(spark, sf_dir, "supplier").agg(F.count("*").alias("n_projects"))
    return o.crossJoin(F.broadcast(s)).select(  # one row
        F.col("o_orderkey").alias("pack_id"), F.expr("o_custkey % n_projects").alias("project_id"), F.col("o_orderpriority").alias("target_tool"), F.col("o_orderstatus").alias("task_type"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("duration_ms"),
    )


PACKS_SQL = """packs AS (SELECT o_orderkey AS pack_id, o_custkey % (SELECT count(*) FROM supplier) AS project_id, o_orderpriority AS target_tool,
    o_orderstatus AS task_type, o_orderdate AS created_at, o_totalprice AS duration_ms FROM orders)"""
