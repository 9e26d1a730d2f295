"""Legacy archive converter: ARC records become WARC records.

ARC files begin with a version block that names the header fields of all
further records; a record is a header line, as many bytes as the line
declares, and a line feed.  Version 1 lines have five fields, version 2
lines ten, and the declared length comes last in both.  The converter parses
them, synthesises record identifiers, timestamps, types and digests, and
writes WARC 1.1 in which a payload that recurs is stored once and revisited.

Archives are gzip files below the session's shared folder, written and read
by Spark: the text writer puts the separator between records, the binary
reader hands a file to a task, which inflates it piece by piece and cuts it
by declared lengths.  Files hold at most ``RECORDS_PER_FILE`` records and
``FILE_BYTES`` of payloads, or a single payload.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatlens.llm.common import flat_map, table
from repeatlens.session import shared_path, write_shared

RECORDS_PER_FILE = 2000
#: ... and fewer where the largest payload makes so many exceed this size.
FILE_BYTES = 256 << 20
#: Archives are written once and read once here; the fastest level suits.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
#: Shorter payloads are always stored.
REVISIT_BYTES = 1000
#: Up to this many payloads that recur are broadcast (some 200 bytes each).
BROADCAST_PAYLOADS = 50_000

#: The field names of the two ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
       "Archive-length",
}


def version_block(version: int) -> str:
    """The first record of an ARC file, without its closing line feed."""
    body = f"{version} 0 repeatlens\n{FIELDS[version]}\n"
    line = {1: "0.0.0.0 19960923142103 text/plain",
            2: "0.0.0.0 19960923142103 text/plain 200 - - 0 archive.arc"}[version]
    return f"filedesc://archive.arc {line} {len(body)}\n{body}"


def arc_line(version: int, url: str, date: str, mime: str, length: int) -> str:
    """A header line; blanks in the URL are percent-encoded."""
    url = quote(url, safe="".join(map(chr, range(0x21, 0x7F)))) or "-"
    extra = " 200 - - 0 archive.arc" if version == 2 else ""
    return f"{url} 127.0.0.1 {date} {mime}{extra} {length}"


def write_arc(pages: DataFrame, path: str, records: int = RECORDS_PER_FILE) -> None:
    """Writes (url, date, html) rows as ARC files, of both versions in turn.

    Null parts are empty.  No rows, no records.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version, n = 1 + TaskContext.get().partitionId() % 2, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out = []
                for url, date, html in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns)):
                    if n % records == 0:  # a new file begins with this row
                        version = 3 - version
                        out.append(version_block(version))
                        n += 1
                    html = html or ""
                    out.append(arc_line(version, url or "", date or "", "text/html",
                                        len(html.encode())) + "\n" + html)
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    rows = pages.select("url", "date", "html").mapInArrow(run, "value string")
    rows.write.option("maxRecordsPerFile", records).options(**GZIP).text(path)


class _Stream:
    """A gzip file's content, inflated as it is read; members may follow one
    another."""

    def __init__(self, data):
        self.data = memoryview(data)
        self.at = 0
        self.inflate = zlib.decompressobj(31)
        self.buffer = bytearray()

    def _more(self) -> bool:
        if self.inflate.eof:
            if not self.inflate.unused_data and self.at >= len(self.data):
                return False
            left, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            self.buffer += self.inflate.decompress(left)
            return True
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at:self.at + (1 << 18)]
        self.at += len(piece)
        self.buffer += self.inflate.decompress(piece)
        return True

    def line(self, end: bytes) -> bytes | None:
        """Up to the next ``end``, which is taken too; None at the end."""
        start = 0
        while (i := self.buffer.find(end, start)) < 0:
            start = max(0, len(self.buffer) - len(end) + 1)
            if not self._more():
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[:i + len(end)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError(f"a record declares {n} bytes, {len(self.buffer)} are left")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parse_arc(data) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(version, header fields, payload) of each record of an ARC file."""
    s = _Stream(data)
    version, names = 0, []
    while (line := s.line(b"\n")) is not None:
        if not line.strip():
            continue  # the line feed that closes a record
        values = line.decode("utf-8", "replace").split(" ")
        body = s.take(int(values[-1]))
        if values[0].startswith("filedesc://"):
            first, second = body.decode().split("\n")[:2]
            version, names = int(first.split(" ")[0]), second.split(" ")
            continue
        if len(values) != len(names):
            raise ValueError(f"{len(values)} fields where version {version} has {len(names)}")
        yield version, dict(zip(names, values)), body


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_arc(spark, path: str) -> DataFrame:
    """(arc_version, url, ip, date, mime, payload) of all records below a path."""
    text = {n: T.StringType() for n in ("url", "ip", "date", "mime")}

    def make():
        def one(content):
            for version, head, body in parse_arc(content):
                yield (version, head["URL"], head["IP-address"], head["Archive-date"],
                       head["Content-type"], body)
        return one

    return flat_map(_files(spark, path), make, T.StructType([
        T.StructField("arc_version", T.LongType()), *(T.StructField(*x) for x in text.items()),
        T.StructField("payload", T.BinaryType())]))


def _record_id(*parts: Column) -> Column:
    """A name-based UUID (version 5 layout) of the parts."""
    h = F.sha1(F.concat_ws(" ", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-5"), cut[2],
                    F.lit("-a"), cut[3], F.lit("-"), cut[4], F.lit(">"))


def _iso(date: Column) -> Column:
    """ARC's 14 digits as an ISO instant; other dates as the epoch."""
    iso = F.regexp_replace(date, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    return F.when(F.length(iso) == 20, iso).otherwise(F.lit("1970-01-01T00:00:00Z"))


def to_warc(records: DataFrame, order: Column, least: int = REVISIT_BYTES) -> DataFrame:
    """(value): WARC records, as binary, of ``read_arc``'s rows.

    Of records with equal payloads of at least ``least`` bytes, that with the
    greatest ``order`` (an expression over the rows; nulls come first, ties
    all count as greatest) is a response and the others revisit it.
    """
    named = records.select(
        "url", "ip", "payload", _iso(F.col("date")).alias("date"), order.alias("ord"),
        F.octet_length("payload").alias("length"), F.sha1("payload").alias("digest"))
    named = named.withColumn("id", _record_id(F.col("url"), F.col("date"), F.col("digest")))
    # digests only; the payloads are read again below rather than shuffled
    keys = write_shared(named.filter(F.col("length") >= least)
                        .select("digest", "length", "ord", "url", "date", "id"), "digests")
    last = (keys.groupBy("digest", "length").agg(
        F.count("*").alias("n"), F.max(F.struct("ord", "url", "date", "id")).alias("last"))
        .filter("n > 1").select("digest", "length", "last"))
    last = write_shared(last, "recurring")
    small = last.count() <= BROADCAST_PAYLOADS
    joined = named.join(F.broadcast(last) if small else last, ["digest", "length"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("ord").eqNullSafe(F.col("last.ord"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.col("id")), line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.col("date")), line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit(
                "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", F.col("last.id")),
            line("WARC-Refers-To-Target-URI", F.col("last.url")),
            line("WARC-Refers-To-Date", F.col("last.date")),
            line("X-Payload-Length", F.col("length").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.when(revisit, F.lit(len(http))).otherwise(
            F.lit(len(http)) + F.col("length")).cast("string")),
        F.lit("\r\n" + http)).cast("binary")
    return joined.select(F.when(revisit, head).otherwise(
        F.concat(head, F.col("payload"))).alias("value"))


def write_warc(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Writes (value) rows as gzip WARC files; two line ends close a record."""
    (records.select(F.col("value").cast("string")).write
     .option("maxRecordsPerFile", per_file).options(**GZIP)
     .option("lineSep", "\r\n\r\n").text(path))


def parse_warc(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a WARC file."""
    s = _Stream(data)
    while (head := s.line(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, s.take(int(fields["Content-Length"]))
        s.take(4)


def read_warc(spark, path: str) -> DataFrame:
    """(type, id, target_uri, date, digest, refers_to_uri, payload_length,
    payload) of all records below a path; a revisit has no payload."""
    def make():
        def one(content):
            for head, block in parse_warc(content):
                revisit = head["WARC-Type"] == "revisit"
                payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                length = int(head["X-Payload-Length"]) if revisit else len(payload)
                yield (head["WARC-Type"], head["WARC-Record-ID"], head["WARC-Target-URI"],
                       head["WARC-Date"], head["WARC-Payload-Digest"].removeprefix("sha1:"),
                       head.get("WARC-Refers-To-Target-URI"), length, payload)
        return one

    names = ["type", "id", "target_uri", "date", "digest", "refers_to_uri"]
    return flat_map(_files(spark, path), make, T.StructType([
        *(T.StructField(n, T.StringType()) for n in names),
        T.StructField("payload_length", T.LongType()), T.StructField("payload", T.BinaryType())]))


#: Pages carry no crawl date; their records get one from their id.
_FIRST_CRAWL = int(datetime(1997, 1, 1, tzinfo=timezone.utc).timestamp())
_KEY = "#page-"


def _page_id(uri: Column) -> Column:
    text = F.regexp_extract(uri, _KEY + r"(-?\d+)$", 1)
    return F.when(text != "", text.cast("long"))


def _records_per_file(pages: DataFrame) -> int:
    """By the largest payload; two at least, an ARC file's first is its version block."""
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 1
    return max(2, min(RECORDS_PER_FILE, FILE_BYTES // largest))


def archive_pages(pages: DataFrame) -> DataFrame:
    """The WARC records of ``pages`` (page_id, url, html), read back from the
    archives that they were written to: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    Null html is an empty payload, a null url an empty address.  A null id
    is below all others and refers to nothing it could be named by; of
    repeated rows with the greatest id each is a response.  Other columns
    are ignored.  Empty input, empty result.
    """
    spark = pages.sparkSession
    seconds = F.lit(_FIRST_CRAWL) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)),
                                           F.lit(100_000_000))
    key = F.concat(F.coalesce("url", F.lit("")), F.lit(_KEY),
                   F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    legacy = pages.select(key.alias("url"), "html", F.date_format(
        F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyyMMddHHmmss")
        .alias("date"))
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    records = _records_per_file(pages)
    write_arc(legacy, arc, records)
    write_warc(to_warc(read_arc(spark, arc), _page_id(F.col("url"))), warc, max(1, records - 1))
    back = read_warc(spark, warc)
    stored = F.col("type") == "response"
    return back.select(
        _page_id(F.col("target_uri")).alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long"))
        .otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), _page_id(F.col("refers_to_uri")).alias("refers_to"))


def op3_warc_archives(spark, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def oracle() -> str:
    """DuckDB SQL for ``op3_warc_archives``."""
    return f"""
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
       sha1(t) AS payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CAST(CASE WHEN revisit THEN last END AS DOUBLE) AS refers_to
FROM (SELECT *, octet_length(encode(t)) >= {REVISIT_BYTES} AND page_id < last AS revisit
      FROM (SELECT page_id, coalesce(html, '') AS t,
                   max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages))"""
