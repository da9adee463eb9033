"""WARC archives: a writer, and a splittable reader.

Writing: each task writes its records, one gzip member each, to a file of its own under a temporary name and then moves it into place, so a task
that runs twice leaves one file; a file in place is whole and is never replaced. Of equal payloads the page with the smallest id is a response and the others are revisits of it.

Reading: a file is cut into byte ranges without an index. A task scans its range for the gzip magic; a candidate is a record if its member inflates,
passes the gzip checksum, begins with a WARC header and has the length that header states. Where a chain of records breaks off before the range's end
(a gzip stream that lay within a payload, or a damaged file), the file is walked from its start, and a damaged one raises an error. A task owns the records that start inside its range,
and reads past its end for the last one.

Null html is an empty payload. A null page_id comes back as null; it is never the one referred to unless no page of the payload has an id (then
all are responses). Rows that repeat the page_id referred to are responses each. An empty table gives no files and no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, parts, pick, written

#: Payloads under LEAST bytes are stored each time. SPLIT: bytes of an archive to a reading task.
LEAST, SPLIT = 100, 4 << 20
#: Bytes of payloads that a reading task keeps before it knows that its records follow one another to its range's end.
HELD = 64 << 20
MAGIC, START = b"\x1f\x8b\x08", b"WARC/1."
DATE = "1970-01-01T00:00:00Z"
_STEP = 1 << 14


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """A record in a gzip member of its own."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {''.join(c for c in url if c not in chr(13) + chr(10))}"] if url else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parsed(data: bytes) -> tuple[dict[str, str], bytes, bytes] | None:
    """(header fields in lower case, HTTP head, payload), or None if it isn't a whole record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(START):
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        return None
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    return fields, http, payload


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages with digest, and refers_to where the record is a revisit."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pick(pages, page_id="long", url="string", html="string").withColumn("digest", F.sha2(payload, 256))
    large = rows.filter(F.octet_length(payload) >= least)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes the archives into `folder` (a URI of a file system that all executors see) and returns (path, bytes, records) of each."""

    def run(batches):
        from pyarrow import fs

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        name, trial = f"{base}/part-{task.partitionId():06d}.warc.gz", f"{base}/.trial-{task.taskAttemptId()}"
        size = count = 0
        out = None
        for batch in batches:
            for page_id, url, source, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(trial)
                member = record(page_id, url, (source or "").encode(), digest, refers_to, refers_to is not None)
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            if store.get_file_info(name).type == fs.FileType.NotFound:
                store.move(trial, name)
            else:  # another attempt of this task was first, with the same records
                store.delete_file(trial)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([size]), pa.array([count])], names=["path", "bytes", "records"])

    return written(decided(pages, least).mapInArrow(run, "path string, bytes long, records long"), "warc-files")


class _Bytes:
    """Random access to a file through one buffer."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def view(self, at: int) -> memoryview:
        if not self.at <= at < self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(min(1 << 20, self.size - at), at) if at < self.size else b""
        return memoryview(self.held)[at - self.at :]

    def starts(self, at: int, with_: bytes) -> bool:
        got = bytes(self.view(at)[: len(with_)])
        while len(got) < len(with_) and at + len(got) < self.size:
            got += bytes(self.view(at + len(got))[: len(with_) - len(got)])
        return got == with_

    def find(self, at: int, end: int) -> int:
        """The next magic that starts in [at, end), or -1."""
        while at < end:
            view = self.view(at)
            i = bytes(view[: end - at + len(MAGIC) - 1]).find(MAGIC)
            if i >= 0:
                return at + i
            step = min(len(view), end - at)
            for back in range(len(MAGIC) - 1, 0, -1):  # a magic may lie across the buffer's end
                if step > back and at + step - back < end and self.starts(at + step - back, MAGIC):
                    return at + step - back
            at += max(1, step)
        return -1

    def member(self, at: int) -> tuple[bytes, int] | None:
        """What a gzip member that starts at `at` holds, if it begins as a record does, and where it ends."""
        inflate, out, begun = zlib.decompressobj(31), [], b""
        while not inflate.eof:
            chunk = self.view(at)[:_STEP]
            if not len(chunk):
                return None
            try:
                out.append(inflate.decompress(chunk))
            except zlib.error:
                return None
            if len(begun) < len(START):
                begun = b"".join(out)[: len(START)]
                if not START.startswith(begun):
                    return None
            at += len(chunk)
        return b"".join(out), at - len(inflate.unused_data)


def _walk(data: _Bytes, at: int):
    """(start, record) of the members that follow one another from `at`; ends with (start, None) where something else stands."""
    while at < data.size:
        got = data.member(at) if data.starts(at, MAGIC) else None
        found = parsed(got[0]) if got else None
        yield at, found
        if not found:
            return
        at = got[1]


def records_in(file, size: int, start: int, end: int, held: int = HELD):
    """(fields, HTTP head, payload) of the records that start in [start, end)."""
    data, at = _Bytes(file, size), start
    while (at := data.find(at, end)) >= 0:
        chain, size_held, rest, sure = [], 0, None, True
        for here, found in _walk(data, at):
            if here >= end:
                break
            if not found:
                sure = False
                break
            if rest is None and chain and size_held > held:
                rest = here  # until the chain is known to be sound, no more than this is kept; what follows is read again
            if rest is None:
                chain.append(found)
                size_held += len(found[2])
        if not chain:
            at += 1  # the magic was part of other bytes
        elif sure:
            yield from chain
            for here, found in _walk(data, rest) if rest is not None else ():
                if here >= end:
                    return
                yield found
            return
        else:  # a stream within a payload, or a damaged file: only the way from the file's start can tell
            for here, found in _walk(data, 0):
                if here >= end:
                    return
                if not found:
                    raise ValueError(f"no record at byte {here} of the archive")
                if here >= start:
                    yield found
            return


def read(spark: SparkSession, files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record of (path, bytes)."""

    def run(batches):
        from pyarrow import fs

        number = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_file(name) as file:
                    for fields, http, payload in records_in(file, size, start, min(start + split, size)):
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                        stated = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != stated):
                            raise ValueError(f"{path}: a payload doesn't match its digest")
                        rows.append((number(fields["warc-record-id"]), fields.get("warc-target-uri"), stated, digest, kind, number(fields.get("warc-refers-to"))))
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ranges = files.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    return ranges.repartition(parts(spark), "path", "start").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    files = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    return read(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN first END AS refers_to
FROM f
"""
