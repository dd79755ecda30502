"""WARC records and their assembly into captures.

A crawler writes a request, a response and often metadata as separate records
that name each other in ``WARC-Concurrent-To``, possibly in different files.
:func:`assemble` follows these links and gives one nested row a capture.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngram_join import groups
from .scratch import bound_batches, stored

RECORD_SCHEMA = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>,"
    " headers map<string, string>, block binary, truncated boolean"
)
_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("type", pa.string()),
        ("target_uri", pa.string()),
        ("date", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("block", pa.binary()),
        ("truncated", pa.bool_()),
    ]
)
#: Bytes of blocks in one Arrow batch.
BATCH_BYTES = 16 << 20
#: Bytes that are inflated at once.
PORTION = 1 << 16


def inflated(data: bytes) -> Iterator[bytes | int]:
    """The contents of a gzip file's members, in portions; for what is damaged its offset.

    After a damaged or cut off member, and after bytes that belong to none, it goes on with
    the next member that can be found.  Zeros between members are padding.
    """
    at, n = 0, len(data)
    while at < n:
        start = data.find(b"\x1f\x8b\x08", at)
        if data[at : start if start >= 0 else n].strip(b"\0"):
            yield at
        if start < 0:
            return
        d, pos = zlib.decompressobj(31), start
        try:
            while not d.eof and pos < n:
                piece = data[pos : pos + PORTION]
                pos += len(piece)
                while piece and not d.eof:
                    out = d.decompress(piece, PORTION)
                    piece = d.unconsumed_tail
                    if out:
                        yield out
            if not d.eof:
                yield start
            at = pos - len(d.unused_data) if d.eof else start + 3
        except zlib.error:
            yield start
            at = start + 3


def _bare(value: str) -> str:
    return value[1:-1] if value[:1] == "<" and value[-1:] == ">" else value


def parse_headers(head: bytes) -> list[tuple[str, str]]:
    """Names in lower case, and values; folded lines are joined."""
    found: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            found.append((name.strip().lower(), value.strip()))
    return found


class _Portions:
    """A window on portions of data.  Damage ends what can be read until :meth:`go_on`."""

    def __init__(self, portions: Iterable[bytes | int]):
        self.portions, self.buffer, self.line_start = iter(portions), bytearray(), True
        self.damaged: int | None = None
        self.over = False

    def more(self) -> bool:
        if self.over or self.damaged is not None:
            return False
        new = next(self.portions, None)
        if new is None:
            self.over = True
        elif isinstance(new, int):
            self.damaged = new
        else:
            self.buffer += new
            return True
        return False

    def find(self, what: bytes, at: int = 0) -> int:
        while (k := self.buffer.find(what, at)) < 0:
            at = max(at, len(self.buffer) - len(what) + 1)
            if not self.more():
                return -1
        return k

    def pass_over(self, n: int) -> None:
        if n:
            self.line_start = self.buffer[n - 1] == 10
            del self.buffer[:n]

    def go_on(self) -> None:
        self.buffer, self.line_start, self.damaged = bytearray(), True, None


def _of_record(headers: list[tuple[str, str]], block: bytes, size: int) -> dict:
    first = dict(reversed(headers))
    return {
        "record_id": _bare(first["warc-record-id"]) if "warc-record-id" in first else None,
        "type": first.get("warc-type"),
        "target_uri": _bare(first["warc-target-uri"]) if "warc-target-uri" in first else None,
        "date": first.get("warc-date"),
        "concurrent_to": [_bare(v) for k, v in headers if k == "warc-concurrent-to"],
        "headers": list(first.items()),
        "block": block,
        "truncated": len(block) < size,
    }


def _intact(data: _Portions) -> Iterator[dict]:
    """The records up to the next damage."""
    while (at := data.find(b"WARC/")) >= 0:
        if not (data.buffer[at - 1] == 10 if at else data.line_start):
            data.pass_over(at + 5)
            continue
        data.pass_over(at)
        end = data.find(b"\r\n\r\n")
        if end < 0:
            return
        headers = parse_headers(bytes(data.buffer[data.buffer.find(b"\r\n") + 2 : end]))
        data.pass_over(end + 4)
        size = dict(reversed(headers)).get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            continue
        while len(data.buffer) < int(size) and data.more():
            pass
        block = bytes(data.buffer[: int(size)])
        data.pass_over(len(block))
        yield _of_record(headers, block, int(size))


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of an uncompressed or gzipped WARC file, one at a time.

    A block has the length that ``Content-Length`` says, whatever it holds.  Records
    without a valid length are skipped; one that is cut off by the end of the data or by
    damage is marked as truncated.  Each damaged place of a gzip file gives a record of
    type ``damage`` without an id, with the place in ``lost-from``, and records behind it
    are read as usual.  What is held besides ``data`` is one record.
    """
    zipped = data[:2] == b"\x1f\x8b"
    portions = _Portions(inflated(data) if zipped else (data[lo : lo + PORTION] for lo in range(0, len(data), PORTION)))
    while True:
        yield from _intact(portions)
        if portions.damaged is None:
            return
        yield _of_record([("warc-type", "damage"), ("lost-from", str(portions.damaged))], b"", 1)
        portions.go_on()


def records(files: DataFrame) -> DataFrame:
    """The records in the ``content`` (binary) of each row; null contents have none."""
    bound_batches(files.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for content in batch.column(0):
                for r in parse_records(content.as_py() or b""):
                    rows.append(r)
                    size += len(r["block"])
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.select("content").mapInArrow(run, RECORD_SCHEMA)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files (.warc or .warc.gz), a task for each file of up to 2 GB.

    A task holds the file as it is stored and one inflated record.
    """
    return records(spark.read.format("binaryFile").load(path).select("content"))


def _http(block: Column) -> Column:
    """Start line, headers and payload of an HTTP message."""
    text = F.decode(block, "ISO-8859-1")  # one character a byte
    head = F.substring_index(text, "\r\n\r\n", 1)
    lines = F.split(head, "\r\n")
    pairs = F.transform(
        F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.contains(":")),
        lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")),
    )
    return F.struct(
        F.get(lines, F.lit(0)).alias("start_line"),
        pairs.alias("headers"),
        F.expr("substring(block, length(substring_index(decode(block, 'ISO-8859-1'), '\\r\\n\\r\\n', 1)) + 5)").alias("payload"),
    )


def _captures_of(ids: DataFrame, one_way: DataFrame) -> DataFrame:
    """``(record_id, capture_id)`` of all records but responses, from (record_id, rank) and links (record_id, other).

    The nearest response wins, of several at one distance that of the smallest id.  Links
    are followed in rounds, a round a hop, and each takes up only records that have none
    yet.  Responses pass nothing on.
    """
    links = one_way.unionByName(one_way.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct()
    near, far = ids.where("rank > 0"), ids.select(F.col("record_id").alias("other"), F.col("rank").alias("of_other"))
    linked = stored(links.join(near.select("record_id"), "record_id").join(far, "other"), "links")
    latest = stored(linked.where("of_other = 0").groupBy("record_id").agg(F.min("other").alias("capture_id")), "anchored")
    found, rest = latest, linked.where("of_other > 0").select("record_id", "other")
    while True:
        rest = stored(rest.join(latest, "record_id", "left_anti"), "rest")
        if rest.isEmpty():
            break
        hop = latest.withColumnRenamed("record_id", "other")
        latest = stored(rest.join(hop, "other").groupBy("record_id").agg(F.min("capture_id").alias("capture_id")), "anchored")
        if latest.isEmpty():
            break
        found = found.unionByName(latest)
    # those left have no response in reach
    part = groups(rest.where("record_id < other").select(F.col("record_id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "record_id")
    member = stored(near.join(part, "record_id"), "members")
    first = member.groupBy("group_id").agg(F.min(F.struct("rank", "record_id")).alias("first"))
    lone = member.join(first, "group_id").select("record_id", F.col("first.record_id").alias("own"))
    known = near.join(found, "record_id", "left").join(lone, "record_id", "left")
    return known.select("record_id", F.coalesce("capture_id", "own", "record_id").alias("capture_id"))


def assemble(found: DataFrame) -> DataFrame:
    """One row a capture: ``(capture_id, target_uri, date, response, requests, metadata, truncated)``.

    ``found`` has the columns of :data:`RECORD_SCHEMA`; others are ignored.  Records
    are linked if either names the other in ``concurrent_to``.  A response makes a
    capture; any other record belongs to the response that is the fewest links away, over
    records that are no response (of several as near to that of the smallest id).  Links
    between responses have no effect.
    Where no response is in reach, requests make captures, then other records; their
    ``response`` is null.  Records without an id are left out, links to absent
    records have no effect, repeated records count once (of several with one id and
    type the first by date and content).  ``requests`` and ``metadata`` (all other
    types) are ordered by date and id; ``truncated`` tells whether any of the records is.
    Only ids are shuffled to follow links; blocks are shuffled once.
    """
    columns = ["record_id", "type", "target_uri", "date", "headers", "block", "truncated"]
    kept = found.select(*columns, "concurrent_to").where("record_id is not null")
    # all but the large part, so that records are parsed twice in all: for this table, and for the responses' blocks
    light = stored(kept.withColumn("block", F.when(F.coalesce(F.col("type"), F.lit("")) != "response", F.col("block"))), "records")
    rank = F.when(F.col("type") == "response", 0).when(F.col("type") == "request", 1).otherwise(2)
    ids = stored(light.groupBy("record_id").agg(F.min(rank).alias("rank")), "ids")
    one_way = light.select("record_id", F.explode("concurrent_to").alias("other")).where("other is not null")
    capture = _captures_of(ids, one_way)
    responses = kept.where("type = 'response'").select(F.col("record_id").alias("capture_id"), *columns)
    of_record = capture.unionByName(ids.where("rank = 0").select("record_id", F.col("record_id").alias("capture_id")))
    others = light.where("type is null or type <> 'response'").select(*columns).join(of_record, "record_id").select("capture_id", *columns)
    http = _http(F.col("block"))
    whole = responses.unionByName(others).withColumn("http", http)
    status = F.regexp_extract("http.start_line", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    response = F.struct("date", "record_id", "target_uri", status.try_cast("int").alias("status"), F.col("http.headers").alias("headers"), F.col("http.payload").alias("payload"))
    request = F.struct("date", "record_id", "target_uri", F.col("http.start_line").alias("request_line"), F.col("http.headers").alias("headers"), F.col("http.payload").alias("payload"))
    other = F.struct("date", "record_id", "target_uri", "type", F.col("block").alias("content"))
    captures = whole.groupBy("capture_id").agg(
        F.min(F.when(F.col("type") == "response", response)).alias("response"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "request", request))).alias("requests"),
        F.array_sort(F.collect_set(F.when(F.coalesce(F.col("type"), F.lit("")).isin("response", "request"), None).otherwise(other))).alias("metadata"),
        F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"),
    )
    first = F.coalesce(F.col("response.date"), F.get("requests", F.lit(0))["date"], F.get("metadata", F.lit(0))["date"])
    uri = F.coalesce(F.col("response.target_uri"), F.get("requests", F.lit(0))["target_uri"], F.get("metadata", F.lit(0))["target_uri"])
    return captures.select("capture_id", uri.alias("target_uri"), first.alias("date"), "response", "requests", "metadata", "truncated")


def _uuid(kind: str, page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind), page_id.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def _record(kind: str, record_id: Column, url: Column, links: list[Column], content_type: str, block: Column) -> Column:
    """The bytes of one record."""
    lines = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Record-ID: <"),
        record_id,
        F.lit(">\r\n"),
        *[x for link in links for x in (F.lit("WARC-Concurrent-To: <"), link, F.lit(">\r\n"))],
        F.lit("WARC-Target-URI: "),
        url,
        F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
        F.lit("\r\n\r\n"),
    ]
    return F.concat(*lines).cast("binary")


def pages_as_warc(pages: DataFrame) -> DataFrame:
    """``content``: a request, a response and a metadata record for each page, each as WARC bytes of its own.

    The request names the response, the metadata of even pages the response and of
    odd pages the request.  Null ids, addresses and bodies are written as empty.
    """
    page_id, url, html = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("page_id", "url", "html"))
    host = F.coalesce(F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1), F.lit(""))
    path = F.regexp_replace(F.regexp_replace(url, "^[a-z]+://[^/?#]*", ""), "#.*$", "")
    ids = {k: _uuid(k, page_id) for k in ("request", "response", "metadata")}
    request = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    response = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), html)
    metadata = F.concat(F.lit("pageId: "), page_id, F.lit("\r\n"))
    to = F.when(F.coalesce(F.col("page_id"), F.lit(0)) % 2 == 0, ids["response"]).otherwise(ids["request"])
    return pages.select(
        F.explode(
            F.array(
                _record("request", ids["request"], url, [ids["response"]], "application/http;msgtype=request", request),
                _record("response", ids["response"], url, [], "application/http;msgtype=response", response),
                _record("metadata", ids["metadata"], url, [to], "application/warc-fields", metadata),
            )
        ).alias("content")
    )
