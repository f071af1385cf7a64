"""Evaluation of selections against labelled cases: failures, metrics, integrity and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookups import SEVERITY_WEIGHT
from ..functions.text import ratio

#: Confidence buckets. Fixed values.
BUCKETS = [(0, 29), (30, 59), (60, 79), (80, 100)]
#: Metric, comparison, standard and strict threshold. Fixed values.
GATES = [
    ("total_cases", ">=", 24, 40), ("passed_rate", ">=", 0.9, 0.95), ("weighted_score", ">=", 90, 95), ("primary_accuracy", ">=", 0.9, 0.93),
    ("support_recall", ">=", 0.85, 0.9), ("edit_precision", ">=", 0.85, 0.9), ("safety_accuracy", ">=", 1, 1), ("missing_target_accuracy", ">=", 1, 1),
    ("manual_review", ">=", 0.95, 1), ("area_accuracy", ">=", 0.9, 0.95), ("candidate_recall", ">=", 0.95, 0.97), ("unsafe_rate", "<=", 0, 0),
    ("critical_failures", "<=", 0, 0), ("high_failures", "<=", 0, 0), ("medium_failures", "<=", 4, 2), ("max_candidates", "<=", 40, 40),
]


def _hits(want: Column, have: Column) -> Column:
    return F.size(F.array_intersect(want, have))


def _failures() -> Column:
    """The failures of a case joined with its outcome: an array of (severity, reason)."""
    c = F.col
    empty = F.array().cast("array<struct<severity:string,reason:string>>")

    def one(test: Column, severity, reason: str) -> Column:
        s = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(F.coalesce(test, F.lit(False)), F.array(F.struct(s.alias("severity"), F.lit(reason).alias("reason")))).otherwise(empty)

    def each(paths: Column, severity: str, reason: str) -> Column:
        return F.transform(paths, lambda p: F.struct(F.lit(severity).alias("severity"), F.concat(F.lit(reason + ": "), p).alias("reason")))

    some = lambda want, have: (F.size(want) > 0) & (_hits(want, have) == 0)
    return F.concat(
        one(c("exp_blocked") != c("blocked"), "critical", "blocked differs"),
        one((c("exp_manual") != c("manual")) & ~(F.coalesce(c("exp_blocked"), F.lit(False)) & c("blocked")), F.when(F.coalesce(c("exp_blocked"), F.lit(False)), "critical").otherwise("high"), "manual review differs"),
        one(some(c("primary_any"), c("edits")), "high", "no primary edit target"),
        each(F.array_except("primary_all", "edits"), "high", "missing primary"),
        one(some(c("support_any"), c("selected")), "medium", "no required support"),
        each(F.array_except("support_all", "selected"), "medium", "missing support"),
        each(F.array_intersect("forbidden_selected", "selected"), "critical", "forbidden selected"),
        each(F.array_intersect("forbidden_edit", "edits"), "high", "forbidden edit"),
        one(F.size("unexpected") > c("max_unexpected"), "high", "too many unexpected edits"),
        one(F.size("selected") > c("max_selected"), "medium", "too many files"),
        one(c("area") != c("out_area"), "medium", "area differs"),
        one(c("confidence") < c("confidence_min"), "low", "confidence too low"),
    )


def _rows(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    joined = cases.join(outcomes, "id").withColumn("selected", F.array_union("edits", "supports"))
    joined = joined.withColumn("unexpected", F.array_except("edits", F.array_union("primary_any", "primary_all")))
    return joined.withColumn("failures", _failures())


def failures(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(id, family, severity, reason): a row for each way in which an outcome misses its case."""
    return _rows(cases, outcomes).select("id", "family", F.explode("failures").alias("f")).select("id", "family", "f.severity", "f.reason")


def metrics(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row of metrics over all cases: a join by id and one aggregation; empty denominators give 1, rates of harm 0."""
    c = F.col
    n = lambda test: F.coalesce(test, F.lit(False)).cast("long")
    weight = F.coalesce(c("weight"), *[F.when(c("severity") == s, w) for s, w in SEVERITY_WEIGHT.items()])
    passed = F.size("failures") == 0
    has_primary = (F.size("primary_any") + F.size("primary_all")) > 0
    any_ok = (F.size("primary_any") == 0) | (_hits(c("primary_any"), c("edits")) > 0)
    all_ok = F.size(F.array_except("primary_all", "edits")) == 0
    blocked = F.coalesce(c("exp_blocked"), F.lit(False))
    missing = ~blocked & F.coalesce(c("exp_manual"), F.lit(False)) & ~has_primary
    contract = F.array_union("support_any", "support_all")
    scope = has_primary | c("max_unexpected").isNotNull() | (F.size("forbidden_edit") > 0)
    abstained = c("blocked") | c("manual") | (F.size("selected") == 0)
    some = lambda want, have: n((F.size(want) > 0) & (_hits(want, have) > 0))
    one = lambda want: n(F.size(want) > 0)
    sev = lambda s: F.size(F.filter("failures", lambda f: f["severity"] == s)).cast("long")
    unsafe = (blocked & ~c("blocked")) | (_hits(c("forbidden_selected"), c("selected")) > 0) | (_hits(c("forbidden_edit"), c("edits")) > 0)
    cols = {
        "total": F.lit(1), "passed": n(passed), "w": weight, "w_passed": F.when(passed, weight).otherwise(0),
        "p_n": n(has_primary), "p_hit": n(has_primary & any_ok & all_ok),
        "s_n": one(c("support_any")) + F.size("support_all"), "s_hit": some(c("support_any"), c("selected")) + _hits(c("support_all"), c("selected")),
        "sp_n": F.when(F.size(contract) > 0, F.size("supports")).otherwise(0), "sp_hit": F.when(F.size(contract) > 0, _hits(contract, c("supports"))).otherwise(0),
        "e_cases": n(scope), "e_n": F.when(scope, F.size("edits")).otherwise(0), "e_bad": F.when(scope, F.size("unexpected")).otherwise(0),
        "fs_n": F.size("forbidden_selected"), "fs_hit": _hits(c("forbidden_selected"), c("selected")), "fe_n": F.size("forbidden_edit"), "fe_hit": _hits(c("forbidden_edit"), c("edits")),
        "b_n": n(c("exp_blocked").isNotNull()), "b_hit": n(c("exp_blocked") == c("blocked")), "mt_n": n(missing), "mt_hit": n(missing & c("manual") & (F.size("selected") == 0)),
        "m_n": n(c("exp_manual").isNotNull()), "m_hit": n(c("exp_manual").isNotNull() & ((c("exp_manual") == c("manual")) | (blocked & c("blocked")))),
        "a_n": n(c("area").isNotNull()), "a_hit": n(c("area") == c("out_area")),
        "c_n": one(c("primary_any")) + F.size("primary_all") + one(c("support_any")) + F.size("support_all"),
        "c_hit": some(c("primary_any"), c("candidates")) + _hits(c("primary_all"), c("candidates")) + some(c("support_any"), c("candidates")) + _hits(c("support_all"), c("candidates")),
        "c_size": F.size("candidates"), "empty": n(F.size("selected") == 0), "unsafe": n(unsafe), "abstained": n(abstained), "abstained_ok": n(abstained & passed),
        "f_critical": sev("critical"), "f_high": sev("high"), "f_medium": sev("medium"), "f_low": sev("low"),
    }
    for k, (lo, hi) in enumerate(BUCKETS):
        inside = ~abstained & c("confidence").between(lo, hi)
        cols |= {f"k{k}_n": n(inside), f"k{k}_c": F.when(inside, c("confidence")).otherwise(0), f"k{k}_p": n(inside & passed)}
    t = _rows(cases, outcomes).select(*[v.alias(k) for k, v in cols.items()])
    t = t.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in cols], F.coalesce(F.max("c_size"), F.lit(0)).cast("long").alias("max_candidates"))
    r = lambda a, b, d: F.round(ratio(c(a).cast("double"), c(b).cast("double"), d), 6)
    error = sum((F.coalesce(F.abs(c(f"k{k}_c") / 100.0 - c(f"k{k}_p")), F.lit(0.0)) for k in range(len(BUCKETS))), F.lit(0.0))
    acted = sum((c(f"k{k}_n") for k in range(len(BUCKETS))), F.lit(0))
    return t.select(
        c("total").alias("total_cases"), c("passed").alias("passed_cases"), r("passed", "total", 0.0).alias("passed_rate"), F.round(100 * ratio(c("w_passed").cast("double"), c("w").cast("double"), 0.0), 6).alias("weighted_score"),
        r("p_hit", "p_n", 1.0).alias("primary_accuracy"), r("s_hit", "s_n", 1.0).alias("support_recall"), r("sp_hit", "sp_n", 1.0).alias("support_precision"),
        F.round(ratio((c("e_n") - c("e_bad")).cast("double"), c("e_n").cast("double"), 1.0), 6).alias("edit_precision"), r("e_bad", "e_n", 0.0).alias("unexpected_rate"), r("e_bad", "e_cases", 0.0).alias("average_unexpected"),
        r("fs_hit", "fs_n", 0.0).alias("forbidden_selected_rate"), r("fe_hit", "fe_n", 0.0).alias("forbidden_edit_rate"), r("b_hit", "b_n", 1.0).alias("safety_accuracy"), r("mt_hit", "mt_n", 1.0).alias("missing_target_accuracy"),
        r("m_hit", "m_n", 1.0).alias("manual_review"), r("a_hit", "a_n", 1.0).alias("area_accuracy"), r("c_hit", "c_n", 1.0).alias("candidate_recall"), r("c_size", "total", 0.0).alias("average_candidates"), "max_candidates",
        r("empty", "total", 0.0).alias("empty_rate"), r("unsafe", "total", 0.0).alias("unsafe_rate"), c("abstained").alias("abstentions"), r("abstained_ok", "abstained", 1.0).alias("abstention_accuracy"),
        F.round(ratio(error, acted.cast("double"), 0.0), 6).alias("calibration_error"),
        c("f_critical").alias("critical_failures"), c("f_high").alias("high_failures"), c("f_medium").alias("medium_failures"), c("f_low").alias("low_failures"),
    )


def integrity(cases: DataFrame) -> DataFrame:
    """(problem, key): repeated ids, families in two splits, files both required and forbidden."""
    repeated = cases.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate id").alias("problem"), F.col("id").cast("string").alias("key"))
    leaked = cases.groupBy("family").agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a <> b").select(F.lit("family in two splits").alias("problem"), F.col("family").alias("key"))
    wanted = F.concat("primary_any", "primary_all", "support_any", "support_all")
    both = cases.filter(F.arrays_overlap(wanted, F.concat("forbidden_selected", F.array().cast("array<string>")))).select(F.lit("required and forbidden").alias("problem"), F.col("id").cast("string").alias("key"))
    return repeated.unionByName(leaked).unionByName(both)


def gate(found: DataFrame) -> DataFrame:
    """(profile, metric, value, threshold, passed) of a row of metrics for both profiles."""
    rows = [
        F.struct(F.lit(p).alias("profile"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), (F.col(m) >= t if op == ">=" else F.col(m) <= t).alias("passed"))
        for m, op, a, b in GATES
        for p, t in (("standard", a), ("strict", b))
    ]
    return found.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def cases(spark, sf_dir: str) -> DataFrame:
    """Cases bound to ``labels``: what should have been selected follows from each row's key and labels."""
    d = F.col("doc_id")
    name = lambda p, m: F.concat(F.lit(p), (d % m).cast("string"))
    when = lambda test, *v: F.when(test, F.array(*v)).otherwise(F.array()).cast("array<string>")
    split = F.when(d % 97 == 0, "validation").when(d % 24 < 12, "development").when(d % 24 < 18, "regression").otherwise("validation")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        d.alias("id"), name("f", 24).alias("family"), split.alias("split"), pick(["critical", "high", "medium", "low"], d % 4).alias("severity"), F.when(d % 10 == 0, 2).alias("weight"),
        F.when(F.col("toxic") == 1, True).when(d % 5 == 0, False).alias("exp_blocked"), F.when(F.col("quality") == 0, True).when(d % 7 == 0, False).alias("exp_manual"),
        when(F.col("quality") == 1, name("a", 5), name("b", 3)).alias("primary_any"), when(d % 6 == 0, name("c", 4)).alias("primary_all"), when(d % 3 == 0, name("d", 4)).alias("support_any"),
        when(d % 4 == 0, name("e", 6)).alias("support_all"), when(d % 8 == 0, name("x", 3)).alias("forbidden_selected"), when(d % 9 == 0, name("d", 4)).alias("forbidden_edit"),
        F.when(d % 2 == 0, d % 3).alias("max_unexpected"), F.when(d % 11 == 0, 4).alias("max_selected"), F.when(d % 2 == 1, pick(["ui", "backend", "docs"], d % 3)).alias("area"), F.when(d % 12 == 0, 30).alias("confidence_min"),
    )


def outcomes(spark, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    name = lambda p, k: F.concat(F.lit(p), k.cast("string"))
    none = F.array().cast("array<string>")
    edits = F.when(d % 13 == 0, none).otherwise(F.array(name("a", d * 7 % 5), name("c", d % 4), name("d", d % 8)))
    supports = F.when(d % 13 == 0, none).otherwise(F.array(name("d", d % 4 + 10), name("e", d * 5 % 6), name("x", d % 5)))
    area = F.element_at(F.array(F.lit("ui"), F.lit("backend"), F.lit("docs")), (d * 2 % 3 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        d.alias("id"), edits.alias("edits"), supports.alias("supports"), F.array_union(F.array_union(edits, supports), F.array(name("b", d % 3))).alias("candidates"),
        ((F.col("toxic") == 1) & (d % 10 != 3)).alias("blocked"), ((F.col("quality") == 0) & (d % 4 != 1)).alias("manual"), area.alias("out_area"), (d * 37 % 101).alias("confidence"),
    )


CASES_SQL = """cases AS (SELECT doc_id AS id, 'f' || doc_id % 24 AS family, CASE WHEN doc_id % 97 = 0 THEN 'validation' WHEN doc_id % 24 < 12 THEN 'development' WHEN doc_id % 24 < 18 THEN 'regression' ELSE 'validation' END AS split,
    ['critical', 'high', 'medium', 'low'][doc_id % 4 + 1] AS severity, CASE WHEN doc_id % 10 = 0 THEN 2 END AS weight, CASE WHEN toxic = 1 THEN true WHEN doc_id % 5 = 0 THEN false END AS exp_blocked,
    CASE WHEN quality = 0 THEN true WHEN doc_id % 7 = 0 THEN false END AS exp_manual, CASE WHEN quality = 1 THEN ['a' || doc_id % 5, 'b' || doc_id % 3] ELSE []::VARCHAR[] END AS primary_any,
    CASE WHEN doc_id % 6 = 0 THEN ['c' || doc_id % 4] ELSE []::VARCHAR[] END AS primary_all, CASE WHEN doc_id % 3 = 0 THEN ['d' || doc_id % 4] ELSE []::VARCHAR[] END AS support_any, CASE WHEN doc_id % 4 = 0 THEN ['e' || doc_id % 6] ELSE []::VARCHAR[] END AS support_all,
    CASE WHEN doc_id % 8 = 0 THEN ['x' || doc_id % 3] ELSE []::VARCHAR[] END AS forbidden_selected, CASE WHEN doc_id % 9 = 0 THEN ['d' || doc_id % 4] ELSE []::VARCHAR[] END AS forbidden_edit, CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 END AS max_unexpected,
    CASE WHEN doc_id % 11 = 0 THEN 4 END AS max_selected, CASE WHEN doc_id % 2 = 1 THEN ['ui', 'backend', 'docs'][doc_id % 3 + 1] END AS area, CASE WHEN doc_id % 12 = 0 THEN 30 END AS confidence_min FROM labels),
outcomes AS (SELECT doc_id AS id, CASE WHEN doc_id % 13 = 0 THEN []::VARCHAR[] ELSE ['a' || doc_id * 7 % 5, 'c' || doc_id % 4, 'd' || doc_id % 8] END AS edits, CASE WHEN doc_id % 13 = 0 THEN []::VARCHAR[] ELSE ['d' || (doc_id % 4 + 10), 'e' || doc_id * 5 % 6, 'x' || doc_id % 5] END AS supports,
    toxic = 1 AND doc_id % 10 <> 3 AS blocked, quality = 0 AND doc_id % 4 <> 1 AS manual, ['ui', 'backend', 'docs'][doc_id * 2 % 3 + 1] AS out_area, doc_id * 37 % 101 AS confidence, doc_id FROM labels),
j AS (SELECT *, list_distinct(list_concat(edits, supports)) AS selected, list_distinct(list_concat(list_concat(edits, supports), ['b' || doc_id % 3])) AS candidates,
    list_filter(list_distinct(edits), lambda e: NOT list_contains(list_concat(primary_any, primary_all), e)) AS unexpected FROM cases JOIN outcomes USING (id)),
fails AS (SELECT id, family, 'critical' AS severity, 'blocked differs' AS reason FROM j WHERE exp_blocked <> blocked
    UNION ALL SELECT id, family, CASE WHEN coalesce(exp_blocked, false) THEN 'critical' ELSE 'high' END, 'manual review differs' FROM j WHERE exp_manual <> manual AND NOT (coalesce(exp_blocked, false) AND blocked)
    UNION ALL SELECT id, family, 'high', 'no primary edit target' FROM j WHERE len(primary_any) > 0 AND NOT list_has_any(primary_any, edits)
    UNION ALL SELECT id, family, 'high', 'missing primary: ' || unnest(list_filter(primary_all, lambda p: NOT list_contains(edits, p))) FROM j
    UNION ALL SELECT id, family, 'medium', 'no required support' FROM j WHERE len(support_any) > 0 AND NOT list_has_any(support_any, selected)
    UNION ALL SELECT id, family, 'medium', 'missing support: ' || unnest(list_filter(support_all, lambda p: NOT list_contains(selected, p))) FROM j
    UNION ALL SELECT id, family, 'critical', 'forbidden selected: ' || unnest(list_filter(forbidden_selected, lambda p: list_contains(selected, p))) FROM j
    UNION ALL SELECT id, family, 'high', 'forbidden edit: ' || unnest(list_filter(forbidden_edit, lambda p: list_contains(edits, p))) FROM j
    UNION ALL SELECT id, family, 'high', 'too many unexpected edits' FROM j WHERE len(unexpected) > max_unexpected
    UNION ALL SELECT id, family, 'medium', 'too many files' FROM j WHERE len(selected) > max_selected
    UNION ALL SELECT id, family, 'medium', 'area differs' FROM j WHERE area <> out_area
    UNION ALL SELECT id, family, 'low', 'confidence too low' FROM j WHERE confidence < confidence_min)"""
FAILURES_SQL = f"WITH {CASES_SQL} SELECT * FROM fails"
INTEGRITY_SQL = f"""WITH {CASES_SQL} SELECT 'duplicate id' AS problem, id::VARCHAR AS key FROM cases GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'family in two splits', family FROM cases GROUP BY family HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'required and forbidden', id::VARCHAR FROM cases WHERE list_has_any(list_concat(list_concat(primary_any, primary_all), list_concat(support_any, support_all)), forbidden_selected)"""
_METRICS = f"""{CASES_SQL}, k AS (SELECT j.*, NOT EXISTS (SELECT 1 FROM fails WHERE fails.id = j.id) AS passed, coalesce(weight, CASE severity WHEN 'critical' THEN 8 WHEN 'high' THEN 5 WHEN 'medium' THEN 3 ELSE 1 END) AS w,
    len(primary_any) + len(primary_all) > 0 AS has_p, len(primary_any) + len(primary_all) > 0 OR max_unexpected IS NOT NULL OR len(forbidden_edit) > 0 AS scope, list_distinct(list_concat(support_any, support_all)) AS contract,
    blocked OR manual OR len(selected) = 0 AS abstained, coalesce(exp_blocked, false) AS eb FROM j),
g AS (SELECT *, CASE WHEN confidence <= 29 THEN 0 WHEN confidence <= 59 THEN 1 WHEN confidence <= 79 THEN 2 ELSE 3 END AS bucket FROM k),
cal AS (SELECT sum(abs(c / 100.0 - p)) AS err, sum(n) AS n FROM (SELECT bucket, sum(confidence) AS c, count(*) FILTER (passed) AS p, count(*) AS n FROM g WHERE NOT abstained GROUP BY 1)),
m AS (SELECT count(*) AS total_cases, count(*) FILTER (passed) AS passed_cases, round(count(*) FILTER (passed) / count(*), 6) AS passed_rate, round(100 * sum(CASE WHEN passed THEN w ELSE 0 END) / sum(w), 6) AS weighted_score,
    round(coalesce(count(*) FILTER (has_p AND (len(primary_any) = 0 OR list_has_any(primary_any, edits)) AND list_has_all(edits, primary_all)) / nullif(count(*) FILTER (has_p), 0), 1), 6) AS primary_accuracy,
    round(coalesce(sum((len(support_any) > 0 AND list_has_any(support_any, selected))::INT + len(list_intersect(support_all, selected))) / nullif(sum((len(support_any) > 0)::INT + len(support_all)), 0), 1), 6) AS support_recall,
    round(coalesce(sum(CASE WHEN len(contract) > 0 THEN len(list_intersect(contract, supports)) ELSE 0 END) / nullif(sum(CASE WHEN len(contract) > 0 THEN len(supports) ELSE 0 END), 0), 1), 6) AS support_precision,
    round(coalesce((sum(len(edits)) FILTER (scope) - sum(len(unexpected)) FILTER (scope)) / nullif(sum(len(edits)) FILTER (scope), 0), 1), 6) AS edit_precision,
    round(coalesce(sum(len(unexpected)) FILTER (scope) / nullif(sum(len(edits)) FILTER (scope), 0), 0), 6) AS unexpected_rate, round(coalesce(sum(len(unexpected)) FILTER (scope) / nullif(count(*) FILTER (scope), 0), 0), 6) AS average_unexpected,
    round(coalesce(sum(len(list_intersect(forbidden_selected, selected))) / nullif(sum(len(forbidden_selected)), 0), 0), 6) AS forbidden_selected_rate, round(coalesce(sum(len(list_intersect(forbidden_edit, edits))) / nullif(sum(len(forbidden_edit)), 0), 0), 6) AS forbidden_edit_rate,
    round(coalesce(count(*) FILTER (exp_blocked = blocked) / nullif(count(exp_blocked), 0), 1), 6) AS safety_accuracy,
    round(coalesce(count(*) FILTER (NOT eb AND coalesce(exp_manual, false) AND NOT has_p AND manual AND len(selected) = 0) / nullif(count(*) FILTER (NOT eb AND coalesce(exp_manual, false) AND NOT has_p), 0), 1), 6) AS missing_target_accuracy,
    round(coalesce(count(*) FILTER (exp_manual IS NOT NULL AND (exp_manual = manual OR (eb AND blocked))) / nullif(count(exp_manual), 0), 1), 6) AS manual_review, round(coalesce(count(*) FILTER (area = out_area) / nullif(count(area), 0), 1), 6) AS area_accuracy,
    round(coalesce(sum((len(primary_any) > 0 AND list_has_any(primary_any, candidates))::INT + len(list_intersect(primary_all, candidates)) + (len(support_any) > 0 AND list_has_any(support_any, candidates))::INT + len(list_intersect(support_all, candidates)))
        / nullif(sum((len(primary_any) > 0)::INT + len(primary_all) + (len(support_any) > 0)::INT + len(support_all)), 0), 1), 6) AS candidate_recall, round(sum(len(candidates)) / count(*), 6) AS average_candidates, max(len(candidates)) AS max_candidates,
    round(count(*) FILTER (len(selected) = 0) / count(*), 6) AS empty_rate, round(count(*) FILTER ((eb AND NOT blocked) OR list_has_any(forbidden_selected, selected) OR list_has_any(forbidden_edit, edits)) / count(*), 6) AS unsafe_rate,
    count(*) FILTER (abstained) AS abstentions, round(coalesce(count(*) FILTER (abstained AND passed) / nullif(count(*) FILTER (abstained), 0), 1), 6) AS abstention_accuracy,
    (SELECT round(coalesce(err / nullif(n, 0), 0), 6) FROM cal) AS calibration_error, (SELECT count(*) FROM fails WHERE severity = 'critical') AS critical_failures, (SELECT count(*) FROM fails WHERE severity = 'high') AS high_failures,
    (SELECT count(*) FROM fails WHERE severity = 'medium') AS medium_failures, (SELECT count(*) FROM fails WHERE severity = 'low') AS low_failures FROM g)"""
METRICS_SQL = f"WITH {_METRICS} SELECT * FROM m"
GATE_SQL = f"WITH {_METRICS} " + " UNION ALL ".join(
    f"SELECT '{p}' AS profile, '{m}' AS metric, {m}::DOUBLE AS value, {float(t)}::DOUBLE AS threshold, {m} {op} {t} AS passed FROM m" for m, op, a, b in GATES for p, t in (("standard", a), ("strict", b))
)
