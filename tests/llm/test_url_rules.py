import random

import duckdb
import pytest
from tessera.llm import queries, url_rules


def split(url):
    """(host, path) by plain string search."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def brute(url, rules):
    host, path = split(url)
    fits = [(len(h + (p or "")), len(h), h + (p or ""), v) for h, p, v in rules if h and v and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, key=lambda f: (f[0], f[1], f[3] == "block"), default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


ODD = [
    None, "", "no scheme", "http://", "http://NET", "HTTP://A.NET/", "https://x.example.net/en/a?b#c", "https://example.net/en", "https://notexample.net/en/", "ftp://u@h.net:80/x",
    "http://a.net?x=/en/", "http://example.com/de/1", "http://a.b.c.example.com/de/", "http://q.org/fr/", "http://q.org/fr", "x://É.NET/é", "a://b://c.net/", "http://net./", "http://.net/", "http://" + "a." * 3000 + "net" + "/d" * 3000,
    "http://x.org/fr/\nline?q", "http://b.net/" + "y" * 100_000,
]
RULE_SCHEMA = "host string, path string, verdict string, rank string"


@pytest.mark.parametrize("bound", [url_rules.BROADCAST_RULES, 0])
def test_verdicts_against_plain_search(spark, bound):
    pick = random.Random(7)
    names = ["net", "com", "example.net", "a.example.net", "b.com", "x.y.z.com", "org"]
    paths = ["", "/", "/e", "/en", "/en/", "/en/x", "/é/", "/en/x/y/", None]
    rules = [(pick.choice(names), pick.choice(paths), pick.choice(["allow", "block"]), "clash") for _ in range(40)]
    rules += [(None, "/", "block", ""), ("net", "en/", "block", ""), ("", "/", "block", ""), ("net", "/q", None, "")]
    ours = queries.RULES
    urls = ODD + [f"https://{pick.choice(['', 'a.', 'm.b.', 'A.'])}{pick.choice(names)}{pick.choice(['', '/', '/en/x/y/z', '/en', '/e', '/é/1', '/En/'])}{pick.choice(['', '?a', '#b'])}" for _ in range(300)]
    urls += ["https://hot.example.net/en/1"] * 200
    pages = spark.createDataFrame([(None if i % 9 == 0 else i % 50, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    usable = [r[:3] for r in rules if r[1] is None or r[1] == "" or r[1].startswith("/")]
    for given, plain in ((rules, usable), ([(*r, "") for r in ours], ours), ([], [])):
        got = url_rules.judge(pages.repartition(5), spark.createDataFrame(given, RULE_SCHEMA), broadcast_rules=bound)
        assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        want = [(None if i % 9 == 0 else i % 50, u, *brute(u, plain)) for i, u in enumerate(urls)]
        key = lambda r: tuple((x is not None, x or "") if not isinstance(x, int) else (True, str(x)) for x in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(pages, spark.createDataFrame(queries.RULES, "host string, path string, verdict string")).collect() == []


def test_registered_query_against_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{small}/pages.parquet'")
    want = con.sql(queries.oracle_sql()["op11_url_rules"])
    got = queries.op11(spark, small).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
    assert {r.verdict for r in got} == {"allow", "block"} and any(r.rule is None for r in got)
