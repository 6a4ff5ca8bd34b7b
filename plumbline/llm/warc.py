"""Legacy web archives (ARC) converted to WARC.

An ARC file begins with a block that names its version and the fields of its record lines;
each record is such a line, the declared number of bytes, and a line's end. The converter
reads the lines by the version's fields, takes payloads by their declared length, and
writes what WARC asks for: record ids (name-based UUIDs of archive and offset), timestamps
(of the 14 digits of ARC), types (`warcinfo` for the first block, `response` for HTTP
messages, `resource` for others, `revisit` for a payload that another record holds) and
SHA-1 digests in base32.

An archive is the unit of work. One pass over the archives lists every record with its
digest; records of equal payload are grouped with partial aggregation, and what revisits
what is joined to these narrow rows and sent to the archives as lists. Payloads are never
shuffled. Files are gzip members, one for each record, written by tasks under a new name
each time and used only once a manifest lists them, so a task can run twice.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.store import ARROW_ROWS, BROADCAST_BYTES, folder, small_batches, written
from plumbline.session import session_setting

# Bytes after which an archive is closed, before compression.
ARCHIVE_BYTES = 16 << 20
LEVEL = 4
# A group of equal payloads is hot if it has this share of the records; so there are fewer hot ones than this.
HOT_SHARE = 1000

# The fields of an ARC record line by version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: [
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length",
    ],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# What our archives say of a page's row, inside the HTTP header and of a revisit.
PAGE, REFERS_TO_PAGE = "X-Page-Id", "X-Refers-To-Page-Id"

_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")
_UNSAFE = re.compile(rb"[\x00-\x20\x7F]")


class ArcRecord(NamedTuple):
    """A record of an ARC file: its place in the file as unpacked, its line and what it holds."""

    offset: int
    fields: dict[str, str]
    content: bytes


def digest(payload: bytes) -> str:
    """SHA-1 in base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(archive: str, offset: int) -> str:
    """The WARC id of what an ARC file holds at an offset; the file goes by its last name."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{archive}#{offset}')}>"


def warc_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss, or a beginning of it, as WARC writes it; what isn't a date becomes the first second of 1970."""
    whole = arc_date + "00000101000000"[len(arc_date) :]
    try:
        return datetime.strptime(whole, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


class Archive:
    """A compressed file of records as it is written."""

    def __init__(self, place: str, name: str) -> None:
        self.name, self.path = name, f"{place}/{uuid.uuid4().hex}-{name}"
        system, path = _located(self.path)
        self.out = system.open_output_stream(path, compression=None)
        self.size, self.n_records = 0, 0

    def add(self, record: bytes) -> None:
        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.out.write(pack.compress(record) + pack.flush())
        self.size += len(record)
        self.n_records += 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        columns = {"archive": [self.name], "path": [self.path], "n_records": [self.n_records], "n_bytes": [self.size]}
        return pa.RecordBatch.from_pydict(columns)


MANIFEST = "archive string, path string, n_records bigint, n_bytes bigint"


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return pafs.FileSystem.from_uri(path)


def _opened(path: str) -> io.BufferedIOBase:
    """A file to read records from, unpacked if it begins as gzip does."""
    system, path = _located(path)
    raw = io.BufferedReader(system.open_input_file(path))
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def _exactly(file: io.BufferedIOBase, size: int, what: str) -> bytes:
    found = file.read(size)
    if len(found) != size:
        raise ValueError(f"{what} declares {size} bytes and has {len(found)}")
    return found


def arc_version_block(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 plumbline\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    return _arc_line(version, f"filedesc://{name}".encode(), "0.0.0.0", date, "text/plain", len(block), name, 0) + block


def _arc_line(version: int, url: bytes, ip: str, date: str, kind: str, size: int, name: str, offset: int) -> bytes:
    more = f" 200 - - {offset} {name}" if version == 2 else ""
    return url + f" {ip} {date} {kind}{more} {size}\n".encode()


def arc_records(file: io.BufferedIOBase, name: str) -> Iterator[ArcRecord]:
    """All records of an ARC file, the version block first.

    The URL is what remains before the other fields, so it may hold blanks.
    """
    fields, offset = ARC_FIELDS[1], 0
    while line := file.readline():
        if not line.strip():
            offset += len(line)
            continue
        what = f"the record at {offset} of {name}"
        values = line.decode("utf-8", "surrogateescape").rstrip("\r\n").rsplit(" ", len(fields) - 1)
        first = line.startswith(b"filedesc://")
        if first:
            # Either version's first line may have its own fields; those that all share stand at both ends.
            parts = line.decode().split()
            values = [*parts[:4], parts[-1]]
        names = ARC_FIELDS[1] if first else fields
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"{what} has no line of {len(names)} fields that ends in a length")
        content = _exactly(file, int(values[-1]), what)
        if first:
            version, listed = (content + b"\n\n").split(b"\n")[:2]
            number = version.split()[0].decode() if version.split() else ""
            if number not in ("1", "2"):
                raise ValueError(f"{name} has ARC version {number!r}")
            fields = listed.decode().split() or ARC_FIELDS[int(number)]
        yield ArcRecord(offset, dict(zip(names, values, strict=True)), content)
        offset += len(line) + len(content)


def http_parts(content: bytes, kind: str) -> tuple[bytes, bytes]:
    """The header of an HTTP message, blank line included, and its payload; no header if it isn't one."""
    if kind == "text/dns" or not content.startswith(b"HTTP/"):
        return b"", content
    ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := content.find(mark)) >= 0]
    at, size = min(ends, default=(len(content), 0))
    return content[: at + size], content[at + size :]


def http_field(header: bytes, name: str) -> str | None:
    for line in header.split(b"\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("latin-1")
    return None


def _number(text: str | None) -> int | None:
    return int(text) if text is not None else None


def write_arc(pages: DataFrame, versions: tuple[int, ...] = (1, 2), date: str = "20000101000000", place: str | None = None) -> DataFrame:
    """`page_id`, `url` and `html` of every row in ARC files, whose `versions` take turns; their manifest, written.

    The HTTP header of a record has the page's id, if there is one. NULL html is an empty
    payload, and a NULL or empty url is `-`; blanks and control characters of a url are
    percent-encoded, since they part the fields of a line. Repeated rows are records of
    their own. An empty table has no files. `place` is a folder that every executor can
    reach; by default one beside the checkpoints.
    """
    spark = pages.sparkSession
    small_batches(spark)
    place = place or folder(spark, "arc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for at in range(batch.num_rows):
                page_id, url, html = (batch.column(k)[at] for k in range(3))
                if out is None:
                    version = versions[(part + number) % len(versions)]
                    out = Archive(place, f"part-{part:05d}-{number:05d}.arc.gz")
                    out.add(arc_version_block(version, out.name, date))
                payload = html.as_py().encode() if html.is_valid else b""
                own = f"{PAGE}: {page_id.as_py()}\r\n" if page_id.is_valid else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n"
                content = head.encode() + payload
                target = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], (url.as_py() or "-").encode() if url.is_valid else b"-")
                line = _arc_line(version, target, "0.0.0.0", date, "text/html", len(content), out.name, out.size)
                out.add(line + content + b"\n")
                if out.size >= ARCHIVE_BYTES:
                    yield out.close()
                    number, out = number + 1, None
        if out is not None:
            yield out.close()

    return written(rows.mapInArrow(write, MANIFEST), "arc-manifest")


def _spread(manifest: DataFrame) -> DataFrame:
    """One archive to a task, as far as that makes sense."""
    return manifest.repartition(max(1, min(manifest.count(), 10_000)))


def archives_in(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of the ARC files under a folder; a file goes by its last name, so two may not share one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    found = files.where(name.rlike("[.]arc([.]gz)?$")).select(
        name.alias("archive"), "path", F.lit(None).cast("bigint").alias("n_records"), F.col("length").alias("n_bytes")
    )
    found = written(found, "arc-manifest")
    twice = found.groupBy("archive").count().where("count > 1").select("archive").first()
    if twice:
        raise ValueError(f"several archives are called {twice.archive}")
    return found


_LISTED = pa.schema(
    [
        ("archive", pa.string()), ("position", pa.int64()), ("url", pa.string()), ("date", pa.string()),
        ("page_id", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.binary()),
    ]
)
# Records that are listed at once.
LISTED_ROWS = 10_000


def listed(manifest: DataFrame) -> DataFrame:
    """Every record of the archives but their version blocks, without its payload."""

    def rows(archive: str, path: str) -> Iterator[tuple]:
        with _opened(path) as file:
            for r in arc_records(file, archive):
                if not r.fields["URL"].startswith("filedesc://"):
                    header, payload = http_parts(r.content, r.fields["Content-type"])
                    page_id, url = _number(http_field(header, PAGE)), _clean(r.fields["URL"])
                    yield archive, r.offset, url, r.fields["Archive-date"], page_id, len(payload), hashlib.sha256(payload).digest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = rows(row["archive"], row["path"])
                while some := list(islice(found, LISTED_ROWS)):
                    columns = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LISTED, strict=True)], schema=_LISTED)

    schema = "archive string, position bigint, url string, date string, page_id bigint, n_bytes bigint, sha256 binary"
    return _spread(manifest).mapInArrow(read, schema)


def _clean(text: str) -> str:
    """Bytes that aren't UTF-8 replaced."""
    return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def revisits(records: DataFrame, min_bytes: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per archive the records whose payload another one holds, with that one: the smallest page, then place.

    Hot groups, of which there are fewer than HOT_SHARE, are joined apart, so that no
    task gets all members of one.
    """
    same = ["sha256", "n_bytes"]
    eligible = records.where(F.col("n_bytes") >= min_bytes)
    rank = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "archive", "position", "url", "date")
    groups = eligible.groupBy(*same).agg(F.min(rank).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    groups = written(groups, "equal-payloads")
    members = eligible.select("archive", "position", *same)
    # At most 500 bytes a group, but for its url.
    size = groups.agg(F.sum(F.octet_length("first.url") + 500)).first()[0] or 0
    if size <= broadcast_bytes:
        met = members.join(F.broadcast(groups), same)
    else:
        limit = max(2, records.count() // HOT_SHARE)
        hot, cold = groups.where(F.col("copies") > limit), groups.where(F.col("copies") <= limit)
        met = members.join(F.broadcast(hot), same, "left").select("archive", "position", *same, "first")
        rest = met.where("first IS NULL").drop("first").join(cold, same)
        met = met.where("first IS NOT NULL").unionByName(rest, allowMissingColumns=True)
    later = met.where("archive != first.archive OR position != first.position")
    return later.groupBy("archive").agg(F.collect_list(F.struct("position", "first")).alias("revisits"))


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n".encode("utf-8", "surrogateescape") for k, v in fields if v is not None]
    return b"".join([b"WARC/1.1\r\n", *lines, f"Content-Length: {len(block)}\r\n\r\n".encode(), block, b"\r\n\r\n"])


def _converted(r: ArcRecord, archive: str, info: str, first: dict | None) -> bytes:
    """A record as WARC; `first` is the one that it revisits."""
    own = [("WARC-Record-ID", record_id(archive, r.offset)), ("WARC-Date", warc_date(r.fields["Archive-date"]))]
    if r.fields["URL"].startswith("filedesc://"):
        block = f"software: plumbline\r\nformat: WARC File Format 1.1\r\nis-part-of: {archive}\r\n".encode()
        block += b"".join(b"arc-header: %s\r\n" % line for line in r.content.split(b"\n") if line.strip())
        name = archive.replace(".arc", ".warc")
        kind = [("WARC-Type", "warcinfo"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
        return warc_record([*kind, *own], block)
    header, payload = http_parts(r.content, r.fields["Content-type"])
    own += [
        ("WARC-Target-URI", r.fields["URL"]), ("WARC-Warcinfo-ID", info),
        ("WARC-IP-Address", None if r.fields["IP-address"] in ("-", "0.0.0.0") else r.fields["IP-address"]),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response" if header else r.fields["Content-type"]),
    ]
    if first is None:
        kind, block = [("WARC-Type", "response" if header else "resource")], r.content
    else:
        page = first["page_id"]
        kind, block = [
            ("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first["archive"], first["position"])),
            ("WARC-Refers-To-Target-URI", first["url"]), ("WARC-Refers-To-Date", warc_date(first["date"])),
            (REFERS_TO_PAGE, None if page is None else str(page)),
        ], header
    return warc_record([*kind, *own, ("WARC-Block-Digest", f"sha1:{digest(block)}")], block)


def convert(manifest: DataFrame, min_bytes: int = 0, place: str | None = None) -> DataFrame:
    """The ARC files of `manifest` as WARC files; their manifest, written.

    Of records with equal payloads of at least `min_bytes` the one with the smallest page
    id is kept whole (without ids, or with equal ones, the first by archive and place) and
    the others revisit it: of repeated rows one is whole. A payload is the same if its
    length and SHA-256 are. A file that doesn't keep to its declared lengths is refused.
    `place` is a folder that every executor can reach; by default one beside the
    checkpoints.
    """
    spark = manifest.sparkSession
    place = place or folder(spark, "warc")
    listing = written(revisits(written(listed(manifest), "arc-records"), min_bytes), "revisits")
    jobs = manifest.select("archive", "path").join(listing, "archive", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                firsts = {x["position"]: x["first"] for x in row["revisits"] or ()}
                out, info = Archive(place, row["archive"].removesuffix(".gz").replace(".arc", ".warc") + ".gz"), None
                with _opened(row["path"]) as file:
                    for r in arc_records(file, row["archive"]):
                        info = info or record_id(row["archive"], r.offset)
                        out.add(_converted(r, row["archive"], info, firsts.get(r.offset)))
                yield out.close()

    # A row may hold as many revisits as its archive holds records.
    with session_setting(spark, ARROW_ROWS, "2"):
        return written(_spread(jobs).mapInArrow(write, MANIFEST), "warc-manifest")


def warc_records(file: io.BufferedIOBase, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of all records of a WARC file."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"{name} has {line[:20]!r} where a record should begin")
        fields = {}
        while (line := file.readline()).strip():
            key, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[key.strip()] = value.strip()
        yield fields, _exactly(file, int(fields["Content-Length"]), f"a record of {name}")


def _row(fields: dict[str, str], block: bytes, name: str) -> tuple:
    header, payload = http_parts(block, fields.get("Content-Type", ""))
    kind, size, sha1 = fields["WARC-Type"], int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = kind != "revisit"
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}" or whole and (size != len(payload) or sha1 != digest(payload)):
        raise ValueError(f"record {fields['WARC-Record-ID']} of {name} is not what its digests say")
    page, refers_to = _number(http_field(header, PAGE)), _number(fields.get(REFERS_TO_PAGE))
    return page, size, sha1, kind, refers_to, fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), payload if whole else None


READ = pa.schema(
    [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("payload", pa.binary()),
    ]
)


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for every record of the WARC files, and on demand its payload (NULL where it revisits).

    `payload_bytes` and `payload_digest` are of the full payload, `refers_to` is the page
    of the record that a revisit refers to; digests and lengths are checked. A record
    written from a NULL page id has none here.
    """
    schema = READ if payloads else pa.schema(list(READ)[:-1])

    def rows(name: str, path: str) -> Iterator[tuple]:
        with _opened(path) as file:
            for fields, block in warc_records(file, name):
                if fields["WARC-Type"] != "warcinfo":
                    yield _row(fields, block, name)[: len(schema)]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = rows(row["archive"], row["path"])
                while some := list(islice(found, 100 if payloads else LISTED_ROWS)):
                    columns = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return _spread(manifest).mapInArrow(parse, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (
  SELECT page_id, html, sha1(html) AS hex,
         row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS place,
         min(page_id) OVER (PARTITION BY html) AS first_id
  FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (5 * (3 - i % 4))::INT) & 31))::INT, 1)), 'string_agg', '')
         AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN first_id END AS refers_to
FROM r
"""
