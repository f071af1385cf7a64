"""Quoted values, headings, secrets and roles by neutral scans, against the values that they must give."""

from pyspark.sql import functions as F

from tessera.functions import facts as C
from tessera.functions import paths as P
from tessera.functions import text as X

TEXTS = {
    "API_KEY=abc": "API_KEY=<redacted>",
    "my_token : 'abc def'": "my_token=<redacted> def'",
    "foo=API_KEY=abc, x": "foo=API_KEY=<redacted>, x",
    "a=TOKEN= \"s3cret\" end": "a=TOKEN=<redacted>\" end",
    "TOKEN=abc== rest": "TOKEN=<redacted> rest",
    "a=TOKEN==x; SECRET := y z": "a=TOKEN=<redacted> SECRET=<redacted> z",
    "go https://x/y?token=abc&z now": "go https://x/y?token=<redacted> now",
    "see postgres://u:p@host/db, ok": "see postgres://<redacted>@<host>, ok",
    "see POSTGRESQL://u:p@host/db) http://u:p@h": "see POSTGRESQL://<redacted>@<host>) http://u:p@h",
    "no secrets: here = fine": "no secrets: here = fine",
    "plain: 1, Password: hunter2\nnext": "plain: 1, Password=<redacted>\nnext",
    "mention of a password only": "mention of a password only",
    "": "",
    "t" * 5000: "t" * 5000,
    "a=b:" * 50_000: "a=b:" * 50_000,
}


def test_secrets_give_way_to_a_mark(spark):
    # a secret-like name may hold a key anywhere: "secrets" does, so its value goes as well
    want = dict(TEXTS) | {"no secrets: here = fine": "no secrets=<redacted>"}
    rows = spark.createDataFrame([*((t,) for t in want), (None,)], "t string").select("t", X.redact_secrets(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == want | {None: None}


def test_hints_come_from_names_and_headings(spark):
    html = """<x y='1' aria-label="Close it"> {other: "title", title: 'My <b>page</b>', "a": 'xx', data.label: `Tag`, subtitle: 'no'}
    untitle: 'never' heading :  "Head" <h1 class=a>One</h1><h2>Two <i>b</i></h2><header>x</header><h3>%s</h3><h1>never closed""" % ("z" * 261)
    rows = spark.createDataFrame([(html,), ("",), (None,)], "t string").select(X.page_hints(F.col("t")).alias("r")).collect()
    assert [r.r for r in rows] == [["My page", "Tag", "Head", "Close it", "One", "Two b"], [], None]


def test_quoted_facts_keep_to_whole_names(spark):
    code = """app.get('/a', x); myapp.get('/no'); router.delete ( "/b" ); i18n.t('k1'); t(`k2`); cut('k3'); path: '/c', xpath: '/no', labelKey: "l", say('it''s')"""
    found = spark.createDataFrame([(code,)], "t string").select(F.explode(C.facts(F.col("t"))).alias("f")).select("f.*").collect()
    got = {}
    for r in found:
        got.setdefault(r.kind, []).append(r.value)
    assert {k: got.get(k) for k in C.QUOTED} == {"route": ["/a", "/b"], "route_key": ["/c"], "translation": ["k1", "k2"], "translation_key": ["l"]}


def test_roles_by_the_first_word_of_a_name(spark):
    paths = {
        "src/formatters.ts": "utility", "src/formatter.money.ts": "utility", "src/risk-score.ts": "utility", "src/risky.ts": "unknown", "server/src/auth.ts": "service", "src/auth.ts": "unknown",
        "server/session-x.js": "service", "src/middleware.mts": "config", "src/middleware.tsx": "unknown", "server/x/settings.ts": "config", "src/settings.ts": "unknown",
    }
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", P.role(F.col("p"), F.lit("source")).alias("r")).collect()
    assert {r.p: r.r for r in rows} == paths


def test_parts_are_dealt_over_tasks_before_texts_are_made_of_them(spark, small):
    from tessera.functions import facts
    from tessera.functions.text import by_table
    from tessera.plans import code

    # one small file was one task, however many texts its rows make
    sizes = [n for n in code.sources(spark, small).rdd.glom().map(len).collect() if n]
    assert len(sizes) > 4 and max(sizes) < 2 * min(sizes) + 20
    assert by_table("[^A-Za-z0-9_$.]x[A-Za-z_$]").startswith("[^abc") and "A-Z" not in "".join(map(by_table, facts.PATTERNS.values()))


def test_specifiers_try_no_candidates_of_their_own(spark):
    from tessera.operators.joins import resolve_imports

    files = spark.createDataFrame([("p", x) for x in ("a", "a.ts", "a/index.ts", "b.ts/index.js", "b.ts.ts", "é.tsx", "/index.ts")], "project_id string, path string")
    imports = spark.createDataFrame([("p", "z.ts", s) for s in ("./a", "./b.ts", "./é", "./c", "./", "x")], "project_id string, src string, specifier string")
    found = resolve_imports(files, imports)
    assert {(r.specifier, r.dst) for r in found.collect()} == {("./a", "a"), ("./b.ts", "b.ts.ts"), ("./é", "é.tsx"), ("./", "/index.ts")}
    left = found._jdf.queryExecution().optimizedPlan().toString()
    assert left.count("Generate explode") == 1 and "posexplode" not in left
