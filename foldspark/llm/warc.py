"""WARC archives: a writer, and a normaliser of monolithic gzip files.

``write_archives`` writes one record per page, a whole file as one gzip stream (as a careless crawler leaves it): no record can then be reached without
inflating all before it. ``normalise`` inflates each such file once, as a stream, rewrites every record as a gzip member of its own and writes a sidecar
index of (offset, length) by record. ``read_archives`` reads records by that index.

Of pages with equal payloads of at least ``min_bytes``, the one with the largest page_id is a response and the others revisit it. Which is which is decided on rows of
(page_id, url, digest): an aggregate with map-side combine by digest, and a join that deals a digest with more than a thousandth of all pages over several keys. Payloads are
shuffled once, by page and not by digest, so one that a third of all pages share meets in no task; equal rows are merged before that shuffle. Revisits carry no payload from there on.

Every task writes files under names of its own attempt and returns those names; the rows, not the folder's listing, say which files count. So a lost or
repeated task leaves at most unused files.

Defined cases: a null html is an empty payload; a null url is an empty target; pages with a null page_id are written too, revisit the response of their
payload, and are all responses where no page with an id has it. Repeated rows are records of their own: of equal payloads with the same largest page_id
the one with the greatest url is the response, of rows equal in all three one, and the others revisit it. Other columns are ignored. An empty table gives no archives and an empty
result. A payload of any length is one record; the memory of a task is a few times its largest page. A stream is inflated in steps of bounded size, whatever its ratio; one that
ends early, within a record or between two, is an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm import files
from foldspark.llm.shared import Scratch, hot_join, lean

_DATE = "2000-01-01T00:00:00Z"
_READ = 1 << 20
#: Revisits of equal rows that one task makes at once.
COPIES = 10_000
_RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
    "archive string, record_offset bigint, record_length bigint"
)
_FIELDS = [x.split()[0] for x in _RECORD.split(", ")]


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, payload: bytes | None, *, size: int | None = None, own: str | None = None, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record. Without a payload it is a revisit: it keeps the HTTP head, whose Content-Length is that (``size``) of the payload with digest ``own``."""
    revisit = payload is None
    size, own = (size, own) if revisit else (len(payload), digest(payload))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {json.dumps(url)[1:-1]}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{own}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; a response's digest and length are those of the payload that is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    number = lambda name: int(x) if (x := fields.get(name, "")[len("<urn:page:") : -1]) else None
    if kind == "revisit":
        sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, own = sizes[0], fields["warc-payload-digest"].removeprefix("sha1:")
    else:
        size, own = len(payload), digest(payload)
        if fields["warc-payload-digest"] != f"sha1:{own}":
            raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
    return {
        "page_id": number("warc-record-id"),
        "url": json.loads(f'"{fields["warc-target-uri"]}"'),
        "record_type": kind,
        "refers_to": number("warc-refers-to"),
        "payload_bytes": size,
        "payload_digest": own,
        "payload": payload if kind != "revisit" else None,
    }


def split_records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from inflated bytes, holding one record and one read at a time."""
    data = bytearray()
    need = None
    for part in stream:
        data += part
        while True:
            if need is None:
                end = data.find(b"\r\n\r\n")
                if end < 0:
                    break
                sizes = [x for x in bytes(data[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:")]
                if not sizes:
                    raise ValueError("a record without Content-Length")
                need = end + 4 + int(sizes[-1].split(b":")[1]) + 4
            if len(data) < need:
                break
            yield bytes(data[:need])
            del data[:need]
            need = None
    if data.strip():
        raise ValueError("the archive ends within a record")


def inflate(f) -> Iterator[bytes]:
    """The inflated bytes of a gzip file of one or more members, at most ``_READ`` at a time. Raises where the last member is cut off."""
    unzip, begun = zlib.decompressobj(31), False
    while chunk := f.read(_READ):
        while chunk:
            begun = True
            part = unzip.decompress(chunk, _READ)
            if part:
                yield part
            chunk = unzip.unconsumed_tail
            if unzip.eof:
                chunk, unzip, begun = unzip.unused_data, zlib.decompressobj(31), False
    while begun and (part := unzip.decompress(unzip.unconsumed_tail, _READ)):
        yield part
    if begun and not unzip.eof:
        raise ValueError("the gzip stream is cut off")


def plan_records(pages: DataFrame, scratch: Scratch, *, min_bytes: int = 0) -> DataFrame:
    """The records of ``pages`` (page_id, url, html): page_id, url, html (null for a revisit), size, sha (of the payload) and refers_to; all decided by digests before anything is written."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    rows = rows.withColumns({"sha": F.sha1(F.encode("html", "UTF-8")), "size": F.octet_length("html").cast("bigint")})
    key = ["page_id", "url", "sha"]
    own = scratch.table(rows.groupBy(*key, "size").agg(F.count("*").alias("k")), "keys")
    # digests that more than one row has
    again = own.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.sum("k").alias("n"), F.max(F.struct("page_id", "url")).alias("last")).where("n > 1 and last.page_id is not null")
    again = scratch.table(again.select("sha", "n", F.col("last.page_id").alias("most"), F.col("last.url").alias("most_url")), "again")
    found = hot_join(own, again.drop("n"), ["sha"], again.select("sha", "n"), ["page_id", "url"]).where("most is not null")
    winner = F.col("page_id").eqNullSafe(F.col("most")) & (F.col("url") == F.col("most_url"))
    found = scratch.table(found.select(*key, "size", "k", "most", winner.alias("winner")), "repeated")
    # one row of equal ones, by the key of the join that follows
    first = rows.groupBy(*key, "size").agg(F.first("html").alias("html"), F.count("*").alias("k"))
    names = [F.col(c).alias("_" + c) for c in key]
    first = first.join(found.select(*names, "most", "winner"), [F.col(c).eqNullSafe(F.col("_" + c)) for c in key], "left")
    revisit = F.col("most").isNotNull() & ~F.col("winner")
    copies = F.when(F.col("most").isNull(), F.col("k")).otherwise(F.lit(1).cast("bigint"))
    first = first.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    first = first.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "size", "sha", F.when(revisit, F.col("most")).alias("refers_to"))
    # the other copies of equal rows revisit too: made from the keys alone, in blocks of bounded size
    more = found.where("k > 1").withColumn("block", F.explode(F.expr(f"sequence(0L, (k - 2) div {COPIES})"))).repartition("page_id", "url", "sha", "block")
    more = more.withColumn("copy", F.explode(F.expr(f"sequence(1L, least({COPIES}L, k - 1 - {COPIES}L * block))")))
    return first.unionByName(more.select("page_id", "url", F.lit(None).cast("string").alias("html"), "size", "sha", F.col("most").alias("refers_to")))


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        uri, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        with files.create(uri) as out:
            zip_ = zlib.compressobj(6, zlib.DEFLATED, 31)

            def put(batch: pa.RecordBatch) -> None:
                nonlocal n
                for page_id, url, html, size, sha, refers_to in zip(*(c for c in batch.columns), strict=True):
                    payload = html.as_py().encode() if html.is_valid else None
                    own = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                    out.write(zip_.compress(record(page_id.as_py(), url.as_py(), payload, size=size.as_py(), own=own, refers_to=refers_to.as_py())))
                    n += 1

            put(first)
            for batch in batches:
                put(batch)
            out.write(zip_.flush())
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], ["archive", "records"])

    return run


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """One monolithic archive for each partition of ``planned``: (archive, records)."""
    return planned.mapInArrow(lean(_write(folder)), "archive string, records bigint")


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                index = []
                with files.read(source) as f, files.create(uri) as out:
                    at = 0
                    for data in split_records(inflate(f)):
                        zip_ = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = zip_.compress(data) + zip_.flush()
                        out.write(member)
                        index.append((at, len(member)))
                        at += len(member)
                with files.create(uri + ".idx") as out:
                    for offset, length in index:
                        out.write(f"{offset}\t{length}\n".encode())
                yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([uri]), pa.array([len(index)], pa.int64())], ["source", "archive", "records"])

    return run


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(source, archive, records): for every file of ``archives`` (archive) its copy with a member a record; beside it lies ``.idx``."""
    return archives.select("archive").mapInArrow(lean(_normalise(folder)), "source string, archive string, records bigint")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            with files.read(uri + ".idx") as f:
                index = [tuple(map(int, x.split(b"\t"))) for x in f.read().splitlines()]
            with files.read(uri) as f:
                rows = []
                for offset, length in index:
                    f.seek(offset)
                    fields = parse(zlib.decompress(f.read(length), 31))
                    rows.append(fields | {"archive": uri, "record_offset": offset, "record_length": length})
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in _RECORD.split(", ")]
    for r in rows:
        r.pop("payload", None)
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(_FIELDS, types, strict=True)], _FIELDS)


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of normalised archives, each read by its index entry; payload digests are checked."""
    return archives.select("archive").mapInArrow(lean(_read), _RECORD)


def archive_round_trip(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to monolithic archives, normalise these, and read every record back."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    raw = scratch.table(write_archives(plan_records(pages, scratch, min_bytes=min_bytes), scratch.path("raw")), "written")
    n = raw.count()
    # one archive a task: names are spread evenly, whatever the file sizes of the table that lists them
    spread = lambda df: df.select("archive").repartitionByRange(max(1, n), "archive")
    members = scratch.path("members")
    done = scratch.table(normalise(spread(raw), members), "normalised")
    scratch.keep(done, members)
    return read_archives(spread(done))
