import gzip
import hashlib
import base64

import duckdb
import pytest

from tessera.llm import queries, warc


def test_ranges_own_the_records_that_begin_in_them():
    raw, want = b"", []
    for k in range(200):
        body = (f"page {k} " * (k % 90)).encode() + warc.MAGIC * (k % 3)
        want.append(len(raw))
        raw += warc.member(warc.record_id(k), f"http://x/{k}", body, None, warc.digest32(body))
    raw += warc.MAGIC + b"no member at all"
    read = lambda at, n: raw[at : at + n]
    for step in (1000, 777, 50, len(raw)):
        got = [r["offset"] for lo in range(0, len(raw), step) for r in warc.members(read, lo, min(lo + step, len(raw)))]
        assert got == want
    for r in warc.members(read, 0, len(raw)):
        assert r["warc-type"] == "response"


def test_magic_inside_a_stored_payload_is_no_record():
    inner = gzip.compress(b"WARC/1.1\r\nnot a record")
    import zlib

    raw = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so the inner magic stands in the file
    body = warc.VERSION + b"WARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n"
    data = raw.compress(body) + raw.flush()
    assert data.count(warc.MAGIC) == 2
    got = [r["offset"] for lo in range(0, len(data), 40) for r in warc.members(lambda at, n: data[at : at + n], lo, min(lo + 40, len(data)))]
    assert got == [0]


def digest(x):
    return base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_of_edge_cases(spark, least):
    rows = [(1, "http://a", "same text"), (2, None, "same text"), (3, "u\r\nv", None), (4, "u", ""), (5, "u", "é漢😀"), (6, "u", "x" * 3_000_000), (7, "u", "abc"), (8, "u", "abc")]
    rows += [(9, "u", "r\r\n\r\nWARC/1.1"), (9, "u", "r\r\n\r\nWARC/1.1"), (9, "u", "another payload"), (None, "u", "only without an id"), (None, "u", "only without an id"), (None, "u", "same text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS size", "'x' AS sha", "2 AS refers_to", "3 AS owner")
    got = warc.round_trip(df, least).collect()
    assert len(got) == len({r.record_id for r in got}) == len(rows)
    ids = lambda r: r.record_id.removeprefix("<urn:page:").removesuffix(">").split(":")
    assert sorted("null" if i is None else str(i) for i, _, _ in rows) == sorted(ids(r)[0] for r in got)
    by = {}
    for r in got:
        by.setdefault((r.payload_digest, r.http_length), []).append(r)
    assert sorted(by) == sorted({(digest(h or ""), len((h or "").encode())) for _, _, h in rows})
    for i, _, html in rows:
        text = html or ""
        group = by[digest(text), len(text.encode())]
        whole = [r for r in group if r.record_type == "response"]
        assert all(bytes(r.payload).decode() == text and r.refers_to is None for r in whole)
        assert len(group) == sum((h or "") == text for _, _, h in rows)
        if len(text.encode()) < least:
            assert len(whole) == len(group)
        else:
            numbers = [j for j, _, h in rows if j is not None and (h or "") == text]
            assert len(whole) == 1 and ids(whole[0])[0] == (str(min(numbers)) if numbers else "null")
            assert all(r.payload is None and r.refers_to == whole[0].record_id for r in group if r.record_type == "revisit")
    assert warc.round_trip(df.filter("false")).collect() == []


def test_damaged_members_are_not_passed_over(spark, tmp_path):
    """A broken member and one that the file's end cuts off fail the reader, or are reported; the others are read."""
    made = [warc.member(warc.record_id(k), "http://x", f"page {k} ".encode() * 400, None, warc.digest32(f"page {k} ".encode() * 400)) for k in range(5)]
    broken = bytearray(made[1])
    broken[-40] ^= 0xFF
    wrong = warc.member(warc.record_id(9), "http://x", b"a payload", None, warc.digest32(b"another"))
    raw = made[0] + bytes(broken) + made[2] + wrong + made[3] + made[4][:-20]
    path = tmp_path / "own.warc.gz"
    path.write_bytes(raw)
    files = spark.createDataFrame([(str(path), len(raw))], "path string, size long")
    for split in (97, 32 << 20):
        got = sorted((r.offset, r.record_type) for r in warc.read_archives(spark, files, str(tmp_path), split, report=True).collect())
        sizes = [0, len(made[0]), len(broken), len(made[2]), len(wrong), len(made[3])]
        at = [sum(sizes[: k + 1]) for k in range(6)]
        assert got == list(zip(at, ["response", "damaged", "response", "damaged", "response", "damaged"]))
    with pytest.raises(Exception, match="damaged member"):
        warc.read_archives(spark, files, str(tmp_path)).collect()


def test_registered_query_against_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{small}/pages.parquet'")
    want = con.sql(queries.oracle_sql()["op10_warc"])
    got = queries.op10(spark, small).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
