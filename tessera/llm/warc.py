"""Web archives: a writer of gzip members and a splittable reader that finds them in byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize, scratch

#: First bytes of a gzip member: magic number, deflate, no flags. Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
READ = 1 << 20
#: Bytes that are unpacked at a time.
STEP = 1 << 14


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha: str = "", repeat: int = 0) -> str:
    """The id of a page's record: of rows that repeat a page_id the later ones are numbered; pages without one go by
    their payload's hash."""
    return f"<urn:page:{f'null:{sha}' if page_id is None else page_id}{f':{repeat}' if repeat else ''}>"


def member(record: str, url: str | None, payload: bytes, refers_to: str | None, digest: str) -> bytes:
    """One gzip member with one record: a response, or a revisit that leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    raw = VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; a bare path is a local or mounted one."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record for every row of ``pages(page_id long, url, html)`` to archives in ``folder``; returns (path, size).

    Of rows whose payloads (html as UTF-8, null as empty) are equal and ``least`` bytes or longer, the one with the
    smallest page_id, nulls last, is a response and the others revisit it. Rows that repeat a page_id are ordered by
    payload hash and url; each is a record, the later ones with a number behind the id. Rows without a page_id are
    records named by their payload's hash. Extra columns are ignored; an empty table gives no archive.

    A task writes one archive under a name of its own attempt and renames it at the end, so a task that runs again
    replaces the file as a whole.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumns({"size": F.octet_length("html").cast("long"), "sha": F.sha1(F.col("html").cast("binary"))})
    # what a record's id is made of: rows of one owner are told apart by their number
    base = base.withColumn("owner", F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("null:"), "sha")))
    number = (F.row_number().over(Window.partitionBy("owner").orderBy("sha", "size", "url")) - 1).alias("repeat")
    keys = base.select("page_id", "owner", "sha", "size", "url", F.concat_ws("-", "sha", "size").alias("payload"), number)
    keys = materialize(keys.drop("url"), "warc-keys")
    ident = F.concat(F.lit("<urn:page:"), "owner", F.when(F.col("repeat") > 0, F.concat(F.lit(":"), F.col("repeat").cast("string"))).otherwise(""), F.lit(">"))
    place = F.struct(F.col("page_id").isNull(), "page_id", "owner", "repeat")
    first = keys.groupBy("payload").agg(F.min_by(ident, place).alias("response"), F.count("*").alias("n"))
    revisits = join_hot(keys, materialize(first, "warc-first"), "payload", "n").filter((ident != F.col("response")) & (F.col("size") >= least))
    refers = revisits.groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct("repeat", "response"))).alias("refers"))
    # Both sides of the join, and the numbers, are dealt by owner, so payloads are moved once.
    once = base.join(refers, "owner", "left").select("owner", "url", "html", "refers", number)
    once = once.select(ident.alias("record"), "url", "html", F.try_element_at("refers", F.col("repeat")).alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        where, top = store(folder)
        name = f"{top}/pages-{context.partitionId():06d}.warc.gz"
        own = f"{top}/.attempt-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        size = 0
        out = None
        for batch in batches:
            if out is None and len(batch):
                where.create_dir(top, recursive=True)
                out = where.open_output_stream(own, compression=None)
            for record, url, html, refers_to in zip(batch["record"], batch["url"], batch["html"], batch["refers_to"]):
                raw = html.encode("utf-8", "surrogatepass")
                made = member(record, url, raw, refers_to, digest32(raw))
                out.write(made)
                size += len(made)
        if out is not None:
            out.close()
            where.move(own, name)
            yield pd.DataFrame({"path": [name], "size": [size]})

    return once.mapInPandas(run, "path string, size long")


def parse(raw: bytes) -> dict | None:
    """A record from an unpacked member; None if it is not one."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isdigit() or "warc-type" not in fields or len(rest) < int(length):
        return None
    return fields | {"block": rest[: int(length)]}


def members(read, start: int, end: int) -> Iterator[dict]:
    """The records that begin in bytes ``start`` to ``end`` of a file; ``read(at, n)`` gives up to n of its bytes.

    Every gzip magic in the range is a candidate. Its first unpacked bytes must be a record's version line, else the
    search goes on behind the magic, as it does where what unpacks without fault is no record. A record belongs to the
    range that it begins in, and may end beyond it. A candidate with a version line that does not unpack to its
    checked end is given as {"offset", "damaged": why}.
    """
    at, buffer, base = start, b"", start
    ahead, front = b"", 0  # what was read beyond the buffer, and where it begins
    while at < end:
        if at - base + len(MAGIC) > len(buffer):
            base, buffer = at, read(at, READ)
            if len(buffer) < len(MAGIC):
                return
        spot = buffer.find(MAGIC, at - base)
        if spot < 0:
            at = base + len(buffer) - len(MAGIC) + 1
            if len(buffer) < READ:
                return
            continue
        at = base + spot
        if at >= end:
            return
        if at - base + STEP > len(buffer):
            base, buffer = at, read(at, READ)
        try:
            known = zlib.decompressobj(31).decompress(buffer[at - base : at - base + STEP], len(VERSION)).startswith(b"WARC/1.")
        except zlib.error:
            known = False
        if not known:
            at += 1
            continue
        unpack, out, pos, wrong = zlib.decompressobj(31), [], at, None
        try:
            while not unpack.eof:
                if pos - base < len(buffer):
                    piece = buffer[pos - base : pos - base + STEP]
                else:
                    if not front <= pos < front + len(ahead):
                        front, ahead = pos, read(pos, READ)
                    piece = ahead[pos - front : pos - front + STEP]
                if not piece:
                    wrong = "the file ends within it"
                    break
                out.append(unpack.decompress(piece))
                pos += len(piece)
        except zlib.error as error:
            wrong = str(error)
        record = parse(b"".join(out)) if wrong is None else None
        if record is None:
            if wrong:
                yield {"offset": at, "damaged": wrong}
            at += 1
            continue
        pos -= len(unpack.unused_data)
        yield record | {"offset": at}
        at = pos


def read_archives(spark: SparkSession, files: DataFrame, folder: str, split: int = 32 << 20, report: bool = False) -> DataFrame:
    """Records of archives, from ``files(path, size)``: each file is cut into ranges of ``split`` bytes, a row for each.

    Columns: path, offset, record_id, record_type, refers_to, url, http_length long (the HTTP header's), payload binary
    (null for a revisit), payload_digest (the record's). The digest of a response's payload is checked. A damaged or
    truncated member, and a payload that does not match its digest, fail the task; with ``report`` they are rows of
    record_type "damaged" whose record_id says why, and the members behind them are read.
    """
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.filter("size > 0")
    ranges = ranges.repartition(max(1, ranges.count()))  # a task for each range, which adaptive execution would merge

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, _ = store(folder)
        for batch in batches:
            for path, start, size in zip(batch["path"], batch["start"], batch["size"]):
                rows = []
                held = 0
                with where.open_input_file(path) as f:

                    def read(at: int, n: int, f=f) -> bytes:
                        f.seek(at)
                        return f.read(n)

                    for r in members(read, int(start), min(int(start) + split, int(size))):
                        if "damaged" in r:
                            if not report:
                                raise ValueError(f"damaged member at byte {r['offset']} of {path}: {r['damaged']}")
                            rows.append((path, r["offset"], r["damaged"], "damaged", None, None, None, None, None))
                            continue
                        head, _, body = r["block"].partition(b"\r\n\r\n")
                        length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                        stated = r.get("warc-payload-digest", "").removeprefix("sha1:")
                        whole = r["warc-type"] == "response"
                        if whole and digest32(body) != stated:
                            why = f"payload of {r.get('warc-record-id')} does not match its digest"
                            if not report:
                                raise ValueError(f"{why}, in {path}")
                            rows.append((path, r["offset"], why, "damaged", None, None, None, None, None))
                            continue
                        rows.append((path, r["offset"], r.get("warc-record-id"), r["warc-type"], r.get("warc-refers-to"), r.get("warc-target-uri"), length, body if whole else None, stated))
                        held += len(r["block"])
                        if held > 16 << 20:
                            yield pd.DataFrame(rows, columns=_NAMES)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=_NAMES)

    return ranges.mapInPandas(run, "path string, offset long, record_id string, record_type string, refers_to string, url string, http_length long, payload binary, payload_digest string")


_NAMES = ["path", "offset", "record_id", "record_type", "refers_to", "url", "http_length", "payload", "payload_digest"]


def archive_folder(spark: SparkSession) -> str:
    return scratch(spark, "warc")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read the records back from them."""
    spark = pages.sparkSession
    folder = archive_folder(spark)
    files = materialize(write_archives(pages, folder, least), "warc-files")
    return read_archives(spark, files, folder)
