"""Legacy web archives (ARC) turned into WARC, and both read back by declared lengths.

An ARC file begins with a version block that names the fields of its header lines;
a record is a header line, ended by a line feed, and as many bytes as the line declares.
The converter makes of each the WARC record that says the same: a version block
becomes warcinfo, an HTTP answer response (or revisit), anything else resource.
Identifiers come from the archive's name and the record's place, digests from the bytes.

Files are read whole, one at a time (plain, or gzip of one or many members), so they
should be of the size that archives have, some 100 MB; writers here end a file after
``FILE_RECORDS`` records.  Payloads are parsed once for their digests and once
to be written; between the two only digests, ids and places are shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.common import tidy

FILE_RECORDS = 20_000
SLICE_BYTES = 1 << 22
# The fields of the header lines of both versions, as their version blocks name them.
FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_END, WARC_END = "\n", "\r\n\r\n"
#: The HTTP field that carries a page's id through an archive.
PAGE_ID = "X-Page-Id"
#: The day that pages without one are dated.
UNDATED = "20000101000000"


# ---- bytes ------------------------------------------------------------------------------


def unpacked(content: bytes) -> bytes:
    """The content of a file, gzip members opened one after the other; a member that breaks off gives what it holds."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(content))
        except zlib.error:
            break
        content = member.unused_data.lstrip(b"\0")
    return b"".join(out)


@dataclass
class Record:
    """One record: its place in the unpacked file, its fields, its block; short: its file ends before its declared length."""

    offset: int
    fields: dict[str, str]
    block: bytes
    short: bool = False

    def body(self) -> bytes:
        """The payload: of an HTTP answer what follows its head, else the whole block."""
        return self.block[self.head() :]

    def head(self) -> int:
        """Bytes of the HTTP head with its empty line; 0 if the block is no HTTP answer."""
        if not self.block.startswith(b"HTTP/"):
            return 0
        ends = [(at + len(end), at) for end in (b"\r\n\r\n", b"\n\n") if (at := self.block.find(end)) >= 0]
        return min(ends, key=lambda e: e[1])[0] if ends else len(self.block)

    def http(self, name: str) -> str | None:
        """A field of the HTTP head."""
        found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", self.block[: self.head()])
        return found[1].decode("utf-8", "replace").strip() if found else None


def arc_records(data: bytes) -> Iterator[Record]:
    """The records of an ARC file.

    A header line has its version's fields, split from the right so that a URL may
    hold spaces; its length is a whole number.  A file without a version block is read by the fields
    of version 1, then of version 2.  Lines between records that are no header lines are passed over.
    """
    names = None
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        fields = None
        for version in [names] if names and not line.startswith("filedesc:") else [FIELDS["1"].split(), FIELDS["2"].split()]:
            cells = line.rsplit(" ", len(version) - 1)
            of = dict(zip(version, cells))
            if len(cells) == len(version) and re.fullmatch(r"\d{1,15}", cells[-1], re.ASCII) and re.fullmatch(r"\d{12,14}", of["Archive-date"], re.ASCII) and re.match(r"[A-Za-z][\w+.-]*:", cells[0]):
                fields = of
        if fields is None:
            at = end + 1
            continue
        start = end + 1
        size = int(fields["Archive-length"])
        block = data[start : start + size]
        if line.startswith("filedesc:"):
            told = block.decode("utf-8", "replace").splitlines()
            named = told[1].split() if len(told) > 1 else []
            names = named if named and named[-1] == "Archive-length" and {"URL", "Archive-date"} <= {*named} else FIELDS["2" if told and told[0].startswith("2") else "1"].split()
        yield Record(at, fields, block, len(block) < size)
        at = start + size


def warc_records(data: bytes) -> Iterator[Record]:
    """The records of a WARC file, by their Content-Length; names of fields in lower case."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not re.fullmatch(r"\d{1,15}", fields.get("content-length", ""), re.ASCII):
            at += 1
            continue
        start, size = end + 4, int(fields["content-length"])
        yield Record(at, fields, data[start : start + size], len(data) < start + size)
        at = start + size


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(archive: str, offset: int) -> str:
    """The same for the same archive and place, wherever and whenever it is read."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def iso(date: str) -> str:
    """A date of 12 or 14 digits as WARC writes it."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def short_name(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def converted(record: Record, archive: str, refers: dict | None) -> bytes:
    """The WARC record of an ARC record; ``refers`` has id, uri and date of the record that a revisit repeats."""
    f, body = record.fields, record.body()
    kind = "warcinfo" if f["URL"].startswith("filedesc:") else "response" if record.block.startswith(b"HTTP/") else "resource"
    head = [("WARC-Type", "revisit" if refers else kind), ("WARC-Record-ID", record_id(archive, record.offset)), ("WARC-Date", iso(f["Archive-date"]))]
    block = record.block
    if kind == "warcinfo":
        head += [("WARC-Filename", archive), ("Content-Type", "text/plain")]
    else:
        head += [("WARC-Target-URI", f["URL"]), ("WARC-IP-Address", f.get("IP-address", "0.0.0.0")), ("WARC-Payload-Digest", f"sha1:{digest(body)}")]
        head.append(("Content-Type", "application/http;msgtype=response" if kind == "response" else f.get("Content-type", "application/octet-stream")))
    if refers:
        block = block[: record.head()]
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers["id"]), ("WARC-Refers-To-Target-URI", refers["uri"]), ("WARC-Refers-To-Date", iso(refers["date"]))]
    if record.short:
        head.append(("WARC-Truncated", "length"))
    head += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block


# ---- tables -----------------------------------------------------------------------------------


def archived_pages(pages: DataFrame, version: str | None = None) -> DataFrame:
    """record (binary): the pages as ARC records, a version block before those of each task.

    ``version`` 1 or 2; by default tasks take turns.  A page's html, in UTF-8, is the
    payload of an HTTP answer (null: empty); its id, if it has one, is in the answer's head.
    """
    rows = pages.select(F.col("page_id").cast("string").alias("id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"), F.spark_partition_id().alias("task"))

    def write(batches):
        from rollcall.llm import web_archives as own

        of = None
        for part in own.portions(batches, "html"):
            cells = [c.to_pylist() for c in part.columns]
            out = []
            if of is None:
                of = version or str(1 + cells[3][0] % 2)
                told = f"{of} 0 rollcall\n{own.FIELDS[of]}\n".encode()
                out.append(own.arc_line(of, f"filedesc://task-{cells[3][0]}.arc", "text/plain", len(told)) + told)
            for key, url, html in zip(*cells[:3]):
                named = f"{own.PAGE_ID}: {key}\r\n" if key is not None else ""
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{named}\r\n".encode() + html
                out.append(own.arc_line(of, own.plain_url(url), "text/html", len(block)) + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return rows.mapInArrow(tidy(write), "record binary")


def portions(batches, column: str):
    from rollcall.llm.common import slices

    return slices(batches, column, SLICE_BYTES)


def plain_url(url: str | None) -> str:
    """A URL for a header line: white space and controls as percent codes; none, or one without a scheme, as urn:page."""
    coded = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    return coded if re.match(r"[A-Za-z][\w+.-]*:", coded) and not coded.startswith("filedesc:") else f"urn:page:{coded}"


def arc_line(version: str, url: str, kind: str, size: int) -> bytes:
    cells = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": UNDATED, "Content-type": kind, "Result-code": "200", "Archive-length": str(size)}
    return (" ".join(cells.get(name, "-") for name in FIELDS[version].split()) + "\n").encode()


def write_records(records: DataFrame, path: str, end: str) -> None:
    """The column record as files below ``path``, each record followed by ``end``; packed by gzip."""
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file below ``path``, read by Spark."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def as_long(text: str | None) -> int | None:
    """A whole number within the range of long; else None."""
    number = int(text) if text and re.fullmatch(r"-?\d{1,19}", text, re.ASCII) else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


ARC_INDEX = "path string, offset long, id string, uri string, date string, page_id long, payload_digest string, payload_bytes long"


def arc_index(files: DataFrame, order_field: str = PAGE_ID) -> DataFrame:
    """A narrow row for each HTTP answer in the ARC files: its place, id, URI, date, digest and size of its payload.

    ``page_id`` is the whole number in the HTTP field ``order_field``, or null.
    """

    def run(batches):
        from rollcall.llm import web_archives as own

        for path, _, data in own.contents(batches):
            rows = []
            for r in own.arc_records(data):
                if r.block.startswith(b"HTTP/"):
                    body, number = r.body(), own.as_long(r.http(order_field))
                    rows.append((path, r.offset, own.record_id(own.short_name(path), r.offset), r.fields["URL"], r.fields["Archive-date"], number, own.digest(body), len(body)))
            yield as_batch(rows, ARC_INDEX)

    return files.mapInArrow(tidy(run), ARC_INDEX)


def contents(batches):
    """path, the other columns, and the unpacked content of each row (path, content, ...)."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), [c[i].as_py() for c in batch.columns[2:]], unpacked(batch.column(1)[i].as_py())


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(columns)], names=[n for n, _ in columns])


def revisits(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """path, offset of each record that repeats a payload of at least ``least_bytes``, and id, uri, date of the one that it repeats.

    Of equal payloads (digest and size) the one with the largest page_id stays (a null one
    only if there is no other; of equal ids that of the later place).
    """
    long_enough = index.where(F.col("payload_bytes") >= least_bytes)
    best = F.max(F.struct("page_id", "path", "offset", "id", "uri", "date")).alias("kept")
    kept = long_enough.groupBy("payload_digest", "payload_bytes").agg(best, F.count("*").alias("times")).where("times > 1").drop("times")
    rows = long_enough.select("path", "offset", "id", "payload_digest", "payload_bytes").join(kept, ["payload_digest", "payload_bytes"])
    return rows.where(F.col("id") != F.col("kept.id")).select("path", "offset", "kept.id", "kept.uri", "kept.date")


def to_warc(files: DataFrame, repeated: DataFrame) -> DataFrame:
    """record (binary): every ARC record as a WARC record; those of ``repeated`` as revisits.

    What is repeated is gathered by file (no more rows than the file has records) and joined to the packed files.
    """
    by_file = repeated.groupBy("path").agg(F.collect_list(F.struct("offset", "id", "uri", "date")).alias("repeated"))

    def run(batches):
        from rollcall.llm import web_archives as own

        for path, (listed,), data in own.contents(batches):
            refers = {r["offset"]: r for r in listed or ()}
            out, size = [], 0
            for r in own.arc_records(data):
                out.append(own.converted(r, own.short_name(path), refers.get(r.offset)))
                size += len(out[-1])
                if size > own.SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return files.join(by_file, "path", "left").mapInArrow(tidy(run), "record binary")


WARC_INDEX = "type string, id string, refers string, uri string, date string, page_id long, payload_digest string, payload_bytes long"


def warc_index(files: DataFrame, order_field: str = PAGE_ID) -> DataFrame:
    """A narrow row for each response, revisit and resource of the WARC files.

    Digest and size are those of the payload as it is read; a revisit has the digest that it declares and no size.
    """

    def run(batches):
        from rollcall.llm import web_archives as own

        for _, _, data in own.contents(batches):
            rows = []
            for r in own.warc_records(data):
                f, kind = r.fields, r.fields.get("warc-type")
                if kind in ("response", "revisit", "resource"):
                    number, body = own.as_long(r.http(order_field)), r.body()
                    told = f.get("warc-payload-digest", "").removeprefix("sha1:")
                    rows.append((kind, f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), number, told if kind == "revisit" else own.digest(body), None if kind == "revisit" else len(body)))
            yield as_batch(rows, WARC_INDEX)

    return files.mapInArrow(tidy(run), WARC_INDEX)


def resolved(index: DataFrame) -> DataFrame:
    """The records with what their revisits refer to: page_id, payload_bytes, payload_digest, record_type, refers_to, uri, date."""
    first = index.where("type = 'response'").select(F.col("id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("own_bytes"))
    revisit = index.where("type = 'revisit'").join(first, "refers", "left").withColumn("payload_bytes", F.col("own_bytes"))
    others = index.where("type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "uri", "date"]
    return others.select(*columns).unionByName(revisit.select(*columns))


def through_archives(pages: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and uri, date): the pages as their WARC records tell them.

    The pages are written as ARC files of both versions to ``folder``/arc, these
    converted to WARC files in ``folder``/warc, and those read back.  A null html
    is an empty payload; equal payloads, empty ones too, become one response (of the largest
    page_id; a null id is less than any) and revisits.  Rows that repeat a page_id are records each.  A null
    url becomes urn:page:.  An empty table makes empty archives and gives no rows.
    """
    spark = pages.sparkSession
    write_records(archived_pages(pages), f"{folder}/arc", ARC_END)
    arc = files_of(spark, f"{folder}/arc")
    write_records(to_warc(arc, revisits(arc_index(arc))), f"{folder}/warc", WARC_END)
    return resolved(warc_index(files_of(spark, f"{folder}/warc")))


#: The same from the pages alone: digests in base 32, five hexadecimal digits at a time.
PAGES_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)), 'string_agg', '') AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM w"""
