"""Web archives (WARC) inside ZIP packages, written and read by Spark tasks.

A package holds stored members: `archive/*.warc.gz` (each record a gzip member of its own) and `indexes/index.cdxj`
with place and length of every record. Reading takes three steps, each spread over tasks: list the members from the
central directories, read the indexes, then read the records by ranges straight out of the package.

Of records with equal payloads of at least MIN_REVISIT bytes, the one with the largest page_id is a response and the
others revisit it; a revisit holds the payload's length and digest, not the payload. A null html is an empty payload,
a null url is empty. Rows that repeat a page_id are records of their own; of rows that repeat the largest one,
each is a response. A null page_id is written as an empty one and read back as null; it is smaller than any other.
Other columns are not read. An empty table makes no package and reads back empty.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrank.llm.common import join_hot, map_batches
from facetrank.llm.files import Appender, filesystem, read_range, task_file
from facetrank.llm.zip_archive import Reader, Writer
from facetrank.shared import scratch_path, write_once

MIN_REVISIT = 1000
#: Bytes of compressed records after which a task starts the next archive member, and the next package.
MEMBER = 16 << 20
PACKAGE = 128 << 20
#: Records of one archive member that one task reads, in bytes.
RANGE = 4 << 20

RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "payload binary"
)
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:page:"


def assigned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to (null: a response)."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest")
    )
    told = rows.filter(F.length("payload") >= MIN_REVISIT).select("digest", F.coalesce("page_id", F.lit(-1 << 63)).alias("page_id"))
    last = told.groupBy("digest").agg(F.max("page_id").alias("_last"), F.min("page_id").alias("_first"))
    last = last.filter("_first < _last").select("digest", "_last")
    joined = join_hot(rows, last, ["digest"], F.xxhash64("page_id"), "left")
    older = F.coalesce(F.col("page_id") < F.col("_last"), F.col("_last").isNotNull() & F.col("page_id").isNull())
    refers_to = F.when((F.length("payload") >= MIN_REVISIT) & older, F.col("_last"))
    return joined.select("page_id", "url", "payload", "digest", refers_to.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; the block is an HTTP response, without its body for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = "" if page_id is None else page_id
    target = " ".join((url or "").split())
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_PAGE}{name}>",
        f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_PAGE}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _page(text: str | None) -> int | None:
    number = (text or "").strip("<>").removeprefix(_PAGE)
    return int(number) if number else None


def parse_record(data: bytes) -> dict:
    """A record as a row of RECORD. The payload of a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
        raise ValueError("the payload's digest differs")
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": kind,
        "refers_to": _page(fields.get("warc-refers-to")), "payload_bytes": int(_fields(http)["content-length"]),
        "payload_digest": digest, "payload": body if kind == "response" else None,
    }


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Package:
    """One ZIP package under construction; holds at most one archive member in memory."""

    def __init__(self, uri: str):
        self.out, self.members, self.index = Appender(uri), 0, []
        self.zip = Writer(self.out.write)
        self.parts: list[bytes] = []
        self.held = 0

    def add(self, page_id: int | None, data: bytes) -> None:
        packed = _gzip(data)
        name = f"archive/data-{self.members:05d}.warc.gz"
        self.index.append(json.dumps({"page": page_id, "filename": name, "offset": self.held, "length": len(packed)}))
        self.parts.append(packed)
        self.held += len(packed)
        if self.held >= MEMBER:
            self.flush()

    def flush(self) -> None:
        if self.parts:
            self.zip.add(f"archive/data-{self.members:05d}.warc.gz", self.parts)
            self.members, self.parts, self.held = self.members + 1, [], 0

    def finish(self) -> tuple[str, int]:
        self.flush()
        self.zip.add("indexes/index.cdxj", [("\n".join(self.index) + "\n").encode()])
        self.zip.finish()
        self.out.close()
        return self.out.uri, self.out.size


def write_packages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages; returns (path, size) of the packages of those attempts that count."""
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, package, done = task_file(folder, "zip").removesuffix(".zip"), 0, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if package is None:
                    package = _Package(f"{base}-{number:04d}.zip")
                package.add(row[0], record(*row))
                if package.out.size >= PACKAGE:
                    done.append(package.finish())
                    package, number = None, number + 1
        if package is not None:
            done.append(package.finish())
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], ["path", "size"])

    return write_once(assigned(pages).mapInArrow(run, "path string, size long"), "warc-packages")


def _reader(path: str, size: int | None = None) -> Reader:
    if size is None:
        system, inner = filesystem(path)
        size = system.get_file_info(inner).size
    return Reader(lambda at, n: read_range(path, at, n), size)


def locate(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """path, at, length of every record in the packages (columns path and size), from their directories and indexes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            reader = _reader(path, size)
            members = {m.name: m for m in reader.members()}
            begins = {name: reader.data_at(m) for name, m in members.items() if name.startswith("archive/")}
            for name, member in members.items():
                if name.startswith("indexes/"):
                    text = reader.read(reader.data_at(member), member.size)
                    if zlib.crc32(text) != member.crc:
                        raise ValueError(f"the checksum of {name} in {path} differs")
                    for entry in map(json.loads, text.splitlines()):
                        begin = begins[entry["filename"]]
                        rows.append((path, begin + entry["offset"], entry["length"]))
        columns = zip(*rows) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["path", "at", "length"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = packages.select("path", "size").repartition(tasks, "path")
    return map_batches(dealt, run, "path string, at long, length long")


def read_records(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """All records (see RECORD). Records that lie together are read in ranges of about RANGE bytes."""
    located = locate(spark, packages)
    ranges = located.withColumn("range", F.floor(F.col("at") / RANGE))
    ranges = ranges.groupBy("path", "range").agg(F.sort_array(F.collect_list(F.struct("at", "length"))).alias("records"))
    names = [field.split()[0] for field in RECORD.split(", ")]
    kinds = dict(zip(names, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                places = row["records"]
                begin = places[0]["at"]
                data = read_range(row["path"], begin, places[-1]["at"] + places[-1]["length"] - begin)
                found = [parse_record(zlib.decompress(data[p["at"] - begin : p["at"] - begin + p["length"]], 31)) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], kinds[n]) for n in names], names)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows are small and stand for much to read: by another key than that of the grouping, which would be merged.
    return ranges.repartition(tasks, F.xxhash64("path", "range")).mapInArrow(run, RECORD)
