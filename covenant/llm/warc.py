"""WARC archives: writing deduplicated records and reading them in sequence.

An archive is a series of gzip members, a record each. The reader goes through it
front to back: it feeds a member to zlib piece by piece, takes the header as soon
as its blank line is there, then exactly ``Content-Length`` bytes of block, checks
the digests, and goes on at the byte after the member. It never holds more than a
record.

Pages with equal payloads of at least ``LEAST`` bytes are written once: the page
of the smallest id as a response, the others as revisits that name it. The choice
is made over digests and ids alone, by a partial aggregate and an equi-join.

Archives are ``.warc.gz`` files in the shared folder, each written by one task under a
name of its attempt and moved into place when it is whole; a manifest, written by
Spark's own committer, lists those of the attempts that count, so a lost executor costs
a retried task and leaves at most files that nothing refers to. The reader opens each
file of the manifest and streams it. Where the shared folder is no path that workers can
open (an object store, say), archives are cells of a table instead; the reader takes
any table of paths and bytes too, for instance ``spark.read.format("binaryFile")``.

Defined results: a null payload is empty; payloads under ``LEAST`` bytes are all
responses; among pages with equal payload and equal id each is a response; a page
without id is a response and no other refers to it; further columns are ignored;
an empty table makes no archive and gives an empty result. A revisit is verified if a
verified response among the records read has the id it names, its digest and length.
A member that is no proper record gives a row with ``error`` and the next one is read;
a broken gzip stream gives one and ends its archive.
"""

from __future__ import annotations

import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_folder, text_chunks

LEAST = 100
#: Compressed bytes after which an archive is closed and a new one begun.
ARCHIVE_BYTES = 4 << 20
#: Compressed bytes given to zlib at a time.
FEED = 1 << 14
ID = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _field(value: object) -> str:
    """A header value: line breaks would end the header early."""
    return " ".join(str(value).split())


def record(page_id: int | None, uri: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """A response, or with ``refers_to`` a revisit without payload, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    header = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_field(uri or '')}",
        f"WARC-Payload-Digest: sha256:{payload_digest}",
        f"WARC-Block-Digest: sha256:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        header += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(header).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member with a fixed header, so that equal records are equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Malformed(ValueError):
    pass


def records(archive: bytes | BinaryIO, findings: bool = False) -> Iterator[tuple[int, dict[str, str] | None, bytes | str]]:
    """``(offset, header fields, block)`` of each record, front to back.

    What is no record raises; with ``findings`` it gives ``(offset, None, message)``.
    """
    source = io.BytesIO(archive) if isinstance(archive, (bytes, bytearray, memoryview)) else archive
    at, held = 0, b""
    while held or (held := source.read(FEED)):
        start, z, got = at, zlib.decompressobj(31), bytearray()
        fields: dict[str, str] | None = None
        body = need = 0
        wrong = None
        while not z.eof:
            if not held and not (held := source.read(FEED)):
                wrong = f"the member at {start} is cut short"
                break
            try:
                got += z.decompress(held)
            except zlib.error as e:
                wrong = f"the member at {start} is no gzip: {e}"
                break
            at += len(held) - len(z.unused_data)
            held = z.unused_data
            if fields is None and wrong is None and (end := got.find(b"\r\n\r\n")) >= 0:
                try:
                    fields = header_fields(bytes(got[:end]))
                    body, need = end + 4, length_of(fields)
                except Malformed as e:  # what it holds is gone past
                    wrong = f"the record at {start}: {e}"
        broken = not z.eof
        if wrong is None and fields is None:
            wrong = f"the record at {start} has no header"
        if wrong is None and (len(got) != body + need + 4 or got[body + need :] != b"\r\n\r\n"):
            wrong = f"the record at {start} does not have its content length"
        if wrong is None:
            yield start, fields, bytes(got[body : body + need])
        elif not findings:
            raise Malformed(wrong)
        else:
            yield start, None, wrong
        if broken:
            return


def length_of(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not value.isdigit():
        raise Malformed(f"no content length: {value!r}")
    return int(value)


def header_fields(header: bytes) -> dict[str, str]:
    first, *lines = header.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise Malformed(f"not a record: {first[:40]!r}")
    found = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise Malformed(f"not a field: {line[:40]!r}")
        found[name.strip().lower()] = value.strip()
    return found


def parsed(fields: dict[str, str], block: bytes) -> tuple:
    """What a record says, and whether its digests hold."""
    kind = fields.get("warc-type", "")
    claimed = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    whole = fields.get("warc-block-digest", "").removeprefix("sha256:")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(
        (int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:") and x.split(b":")[1].strip().isdigit()),
        len(payload),
    )
    holds = not whole or whole == digest(block)
    if kind == "response":
        length, actual = len(payload), digest(payload)
        holds, claimed = holds and claimed in ("", actual), actual
    number = lambda x: int(x) if x.lstrip("-").isdigit() else None
    name = fields.get("warc-record-id", "").strip("<>").removeprefix(ID)
    refers = fields.get("warc-refers-to", "").strip("<>").removeprefix(ID)
    return number(name), fields.get("warc-target-uri"), kind, number(refers), length, claimed, holds, payload


def marked(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html, _digest, _first)``: the response each page repeats, or null.

    The join is on the digest only where a payload repeats; both sides are plain
    exchanges, so a payload that a third of all pages share is split.
    """
    own = pages.select(
        F.col("page_id"), F.col("url"), F.col("html"), F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("_digest")
    )
    firsts = cut(
        pages.where((F.octet_length("html") >= LEAST) & F.col("page_id").isNotNull())
        .groupBy(F.sha2(F.col("html").cast("binary"), 256).alias("_repeated"))
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("_repeated", "_first")
    )
    repeats = F.col("page_id") != F.col("_first")
    return own.join(firsts, F.col("_digest") == F.col("_repeated"), "left").select(
        "page_id", "url", "html", "_digest", F.when(repeats, F.col("_first")).alias("_first")
    )


def archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, folder: str | None = None) -> DataFrame:
    """``(path, content, n_records)``: whole archives of all pages' records.

    With a ``folder`` that all workers can open they are files there, and ``content``
    is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, n, size = TaskContext.get(), 0, 0, 0
        out: BinaryIO | None = None
        name = lambda: f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:05d}.warc.gz"

        def closed() -> pa.RecordBatch:
            if folder is None:
                columns = [pa.array([name()]), pa.array([out.getvalue()], pa.binary()), pa.array([n])]
                return pa.RecordBatch.from_arrays(columns, names=["path", "content", "n_records"])
            out.close()
            os.replace(f"{folder}/.{name()}", f"{folder}/{name()}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name()}"]), pa.array([n])], names=["path", "n_records"])

        if folder is not None:
            os.makedirs(folder, exist_ok=True)
        for b in text_chunks(batches, 2):
            for page_id, url, html, name_, first in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    out = io.BytesIO() if folder is None else open(f"{folder}/.{name()}", "wb")  # noqa: SIM115
                size += out.write(member(record(page_id, url, (html or "").encode("utf-8", "replace"), name_, first)))
                n += 1
                if size >= archive_bytes:
                    yield closed()
                    number, n, size, out = number + 1, 0, 0, None
        if n:
            yield closed()

    return marked(pages).mapInArrow(run, "path string, content binary, n_records long" if folder is None else "path string, n_records long")


READ_SCHEMA = (
    "path string, offset long, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, verified boolean, error string"
)


def read(files: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of every archive; ``files`` has ``path``, and ``content`` unless the path can be opened."""
    cells = "content" in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, path in enumerate(b.column(0).to_pylist()):
                with io.BytesIO(b.column(1)[i].as_py() or b"") if cells else open(path, "rb") as source:
                    rows, held = [], 0
                    for offset, fields, block in records(source, findings=True):
                        if fields is None:
                            rows.append((path, offset, None, None, "malformed", None, None, None, False, block) + ((None,) if payloads else ()))
                        else:
                            page_id, uri, kind, refers, length, name, holds, payload = parsed(fields, block)
                            rows.append((path, offset, page_id, uri, kind, refers, length, name, holds, None) + ((payload,) if payloads else ()))
                            held += len(payload) if payloads else 0
                        if len(rows) >= 1000 or held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    schema = READ_SCHEMA + (", payload binary" if payloads else "")
    names, declared = zip(*(x.split() for x in schema.split(", ")))
    arrow = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds = [arrow[k] for k in declared]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

    found = files.select("path", *(["content"] if cells else [])).mapInArrow(run, schema)
    return held_to_responses(found if payloads else cut(found))


def held_to_responses(found: DataFrame) -> DataFrame:
    """The records; a revisit is verified only if a verified response of the id it names has its digest and length."""
    responses = (
        found.where("record_type = 'response' AND verified AND page_id IS NOT NULL")
        .select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
        .distinct()
    )
    same = (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    revisits = found.where("record_type = 'revisit'").join(responses, same, "left")
    revisits = revisits.withColumn("verified", F.col("verified") & F.col("_id").isNotNull()).select(*found.columns)
    return found.where("record_type <> 'revisit'").unionByName(revisits)


def local_path(folder: str) -> str | None:
    """A folder as a path that workers can open; null if it is in another kind of store."""
    scheme, colon, rest = folder.partition(":")
    if not colon or "/" in scheme:
        return folder
    return "/" + rest.lstrip("/") if scheme == "file" else None


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    path = local_path(folder)
    if path is None:
        archives(pages).write.parquet(folder)
        return read(spark.read.schema("path string, content binary, n_records long").parquet(folder))
    archives(pages, folder=f"{path}/files").write.parquet(f"{folder}/manifest")
    listed = spark.read.schema("path string, n_records long").parquet(f"{folder}/manifest")
    # few rows, each a whole archive: a task for each share of them
    most = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read(listed.repartition(most, "path"))
