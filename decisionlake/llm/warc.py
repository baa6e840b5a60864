"""WARC archives from pages, and the normaliser for archives that were gzipped as one stream.

* :func:`write_archives` writes one WARC file a partition, its records in a single gzip stream, as simple crawlers do. A
  payload that occurs again (same bytes, at least ``min_bytes``) becomes a ``revisit`` of the page with the smallest id.
* :func:`normalise` inflates each such file once, from front to back, and rewrites every record as its own gzip member.
  A sidecar index (a Parquet table, one row a record: file, offset, length, type, ids) says where each member lies.
* :func:`read_records` reads members by the index alone, so any subset of records can be fetched.

A task holds one record at a time. Files go to the cluster's shared store under a temporary name and are renamed when
they are whole, so a task that is run again replaces its own file and readers see complete files only.

Defined results: a null html is an empty payload; payloads under ``min_bytes`` are always responses; repeated rows of
the smallest page id are all responses; a null page id never wins (all null: all are responses); an empty table gives an empty
index; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlake.llm.common import slices

MIN_REVISIT_BYTES = 100
DATE = "1970-01-01T00:00:00Z"             # pages carry no fetch time
CHUNK = 1 << 20                           # bytes read from a store at a time
RECORD_ID = "urn:page:"
INDEX = ("file string, offset bigint, length bigint, record_type string, record_id string, target_uri string, "
         "page_id bigint")


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of ``pages`` (page_id, url, html); only keys and digests are shuffled to decide."""
    p = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    keys = p.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    again = keys.join(first.drop("n"), "digest").where("NOT page_id <=> refers_to").distinct()
    again = again.withColumnsRenamed({"page_id": "__page", "digest": "__digest"})
    return p.join(again, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left").drop("__page", "__digest")


def _store(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{RECORD_ID}{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {len(payload)}"]
    if refers_to is None:
        body = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode() + payload
        head.append("Content-Type: application/http; msgtype=response")
    else:
        body = b""
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class _Whole:
    """An output file that appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str):
        from pyspark import TaskContext
        self.fs, root = _store(folder)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{root}/{name}"
        self.temp = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
        self.out = self.fs.open_output_stream(self.temp, compression=None)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of :func:`mark_revisits`; returns (file, records), one row a file. Lazy: cut or write the result once."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        name, file, n, squeeze = f"part-{TaskContext.get().partitionId():06d}.warc.gz", None, 0, zlib.compressobj(1, zlib.DEFLATED, 31)
        for b in slices(batches, 64):
            for row in b.to_pylist():
                if file is None:
                    file = _Whole(folder, name)
                    file.out.write(squeeze.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:" + name.encode() + b">\r\nWARC-Date: "
                                                    + DATE.encode() + b"\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
                file.out.write(squeeze.compress(_record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])))
                n += 1
        if file is not None:
            file.out.write(squeeze.flush())
            file.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})
    return marked.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "file string, records bigint")


def _inflated(stream):
    """The bytes of a gzip file of any number of members, in pieces."""
    engine = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            yield engine.decompress(data, 4 * CHUNK)
            data = engine.unconsumed_tail
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(31)


def records(pieces):
    """(headers, whole record) of every record in a stream of bytes; header names are lower-case."""
    held, at = bytearray(), 0
    pieces = iter(pieces)

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if held[at:].strip():
                    raise ValueError("the archive ends inside a record")
                return
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in held[at:end].decode().split("\r\n")[1:])}
        stop = end + 4 + int(headers["content-length"]) + 4
        while len(held) < stop:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield headers, bytes(held[at:stop])
        at = stop
        if at > 4 * CHUNK:
            del held[:at]
            at = 0


def _page(uri: str | None) -> int | None:
    found = uri.strip("<>").removeprefix(RECORD_ID) if uri else "none"
    return None if found == "none" or found.startswith("urn:") else int(found)


def normalise(files: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites each of ``files`` (file) with a gzip member a record; returns the index rows. Lazy: write the result once."""
    def run(batches):
        import pyarrow as pa
        fs, root = _store(source)
        for b in batches:
            for name in b.column("file").to_pylist():
                out, rows, at = _Whole(target, name), [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, record in records(_inflated(stream)):
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(record) + engine.flush()
                        out.out.write(member)
                        rows.append({"file": name, "offset": at, "length": len(member), "record_type": headers.get("warc-type"),
                                     "record_id": headers.get("warc-record-id"), "target_uri": headers.get("warc-target-uri"),
                                     "page_id": _page(headers.get("warc-record-id"))})
                        at += len(member)
                out.close()
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                    [(k, pa.int64() if k in ("offset", "length", "page_id") else pa.string()) for k in rows[0]] if rows else []))
    return files.select("file").mapInArrow(run, INDEX)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, record_type, payload, payload_bytes, payload_digest, refers_to) of the response and revisit records of ``index``.

    A response's size and digest are taken from the payload that was read, a revisit's from its headers; a response that
    does not match its own header fails.
    """
    def run(batches):
        import pyarrow as pa
        fs, root = _store(folder)
        name, file = None, None
        for b in slices(batches, 64):
            rows = []
            for row in b.to_pylist():
                if row["file"] != name:
                    name, file = row["file"], fs.open_input_file(f"{root}/{row['file']}")
                raw = zlib.decompress(file.read_at(row["length"], row["offset"]), 31)
                headers, record = next(records([raw]))
                digest, payload = headers["warc-payload-digest"].removeprefix("sha256:"), None
                size, refers = int(headers["payload-length"]), _page(headers.get("warc-refers-to"))
                if headers["warc-type"] == "response":
                    body = record[record.index(b"\r\n\r\n") + 4:-4]
                    payload = body[body.index(b"\r\n\r\n") + 4:]
                    if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                        raise ValueError(f"{headers['warc-record-id']}: the payload is not what its header says")
                rows.append((_page(headers["warc-record-id"]), headers["warc-type"], payload, size, digest, refers))
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             ["page_id", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])
    wanted = index.where(F.col("record_type").isin("response", "revisit")).select("file", "offset", "length")
    return wanted.mapInArrow(run, "page_id bigint, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint")


def archive_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes, normalises and indexes the archives of ``pages`` below ``folder``; returns the index."""
    spark: SparkSession = pages.sparkSession
    write_archives(mark_revisits(pages), f"{folder}/stream").write.parquet(f"{folder}/files")
    files = spark.read.parquet(f"{folder}/files")
    number = F.regexp_extract("file", r"(\d+)", 1).cast("int")           # a task a file: Spark would read the short list in few
    files = files.repartitionById((files.agg(F.max(number)).first()[0] or 0) + 1, number)
    normalise(files, f"{folder}/stream", f"{folder}/members").write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")
