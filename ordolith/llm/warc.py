"""Operator 8: WARC archives, written one gzip member a record and read by byte ranges.

``write_warc`` gives every page one record. Of pages with equal payloads of at least ``least`` bytes the one with the
largest id is the response and the others are revisits of it. ``read_warc`` splits every file into byte ranges: a
task searches its range for the gzip magic, accepts a candidate only if it inflates to a WARC header, and from there on
follows member after member. A record belongs to the range in which its first byte lies, so ranges need no
coordination, and a lost task is simply read again.

Nulls: a null payload is empty; a null url gives a record without a target; a null id is kept (an equal payload
under a real id wins the response). Repeated rows: all rows under the largest id of a payload are responses. A task holds
one payload at a time. An empty table gives no files and no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, scratch_path, slices, stored, table
from .tokenids import open_fs, publish

MAGIC = b"\x1f\x8b\x08"
MANIFEST = "file string, size bigint"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def record(page_id, url, html: str | None, refers_to, revisit: bool) -> bytes:
    """One record as a gzip member of its own."""
    payload = (html or "").encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if revisit else payload
    head.append(f"Content-Length: {len(body)}")
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + squeeze.flush()


def with_revisits(pages: DataFrame, least: int) -> DataFrame:
    """Adds ``refers_to`` and ``revisit`` by payload digest; digests are summed before the shuffle, and only those of
    several pages are joined back, as a join that adaptive execution splits where one payload is very frequent."""
    body = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.withColumn("digest", F.when(F.octet_length(body) >= least, F.sha2(body, 256)))
    owners = pages.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner")
    joined = pages.join(owners, "digest", "left").withColumn("revisit", F.col("digest").isNotNull() & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")))
    return joined.select("page_id", "url", "html", F.when(F.col("revisit"), F.col("owner")).alias("refers_to"), "revisit")


def write_warc(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, roll: int = 1 << 27) -> DataFrame:
    """Write archives to ``folder``; returns the manifest (file, size), stored in the shared folder."""
    picked = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    ready = with_revisits(picked, least)
    out = arrow_schema(pages.sparkSession, MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        filesystem, root = open_fs(folder)
        filesystem.create_dir(root, recursive=True)
        done, sink, size = [], None, 0

        def close():
            nonlocal sink, size
            if sink:
                sink.close()
                name = f"pages-{task:06d}-{len(done):04d}.warc.gz"
                publish(filesystem, f"{root}/.{task}-{attempt}.tmp", f"{root}/{name}")
                done.append((name, size))
                sink, size = None, 0

        for batch in batches:
            for lo, hi in slices(batch.columns, batch.num_rows):
                for row in zip(*(c.slice(lo, hi - lo).to_pylist() for c in batch.columns)):
                    data = record(*row)
                    sink = sink or filesystem.open_output_stream(f"{root}/.{task}-{attempt}.tmp")
                    sink.write(data)
                    size += len(data)
                    if size >= roll:
                        close()
        close()
        if done:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), out.types)], schema=out)

    return stored(ready.mapInArrow(run, MANIFEST), "warc-manifest")


class RangeReader:
    """Records that begin in [lo, hi) of a file, in order, as (offset, header dict, payload)."""

    def __init__(self, file, lo: int, hi: int, chunk: int = 1 << 20):
        self.file, self.lo, self.hi, self.chunk = file, lo, hi, chunk
        self.end = file.size()

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(max(0, min(n, self.end - offset)))

    def is_record(self, offset: int) -> bool:
        """Whether a member starts here that inflates to a WARC header."""
        try:
            return zlib.decompressobj(31).decompress(self.at(offset, 512), 16).startswith(b"WARC/1.")
        except zlib.error:
            return False

    def first(self) -> int | None:
        """The first valid member start in the range."""
        at = self.lo
        while at < self.hi:
            data = self.at(at, min(self.chunk, self.hi - at) + len(MAGIC) - 1)
            i = data.find(MAGIC)
            while i >= 0 and at + i < self.hi:
                if self.is_record(at + i):
                    return at + i
                i = data.find(MAGIC, i + 1)
            at += self.chunk
        return None

    def __iter__(self):
        at = self.first()
        while at is not None and at < self.hi:
            try:
                data, size = self.member(at)
            except zlib.error:  # not a whole member: search on behind it
                self.lo = at + 1
                at = self.first()
                continue
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "replace").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            if lines[0].startswith("WARC/1.") and "content-length" in fields:
                yield at, fields, rest[: int(fields["content-length"])]
            at += size

    def member(self, offset: int) -> tuple[bytes, int]:
        """The inflated member, and its size in the file."""
        inflate, parts, at = zlib.decompressobj(31), [], offset
        step = 1 << 14
        while not inflate.eof:
            data = self.at(at, step)
            if not data:
                raise zlib.error("the file ends in a member")
            parts.append(inflate.decompress(data))
            at += len(data)
            step = min(2 * step, self.chunk)
        return b"".join(parts), at - len(inflate.unused_data) - offset


def number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def ranges(manifest: DataFrame, split: int) -> DataFrame:
    return manifest.select("file", F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {split}L)")).alias("lo")).withColumn("hi", F.col("lo") + split)


def read_warc(manifest: DataFrame, folder: str, *, split: int = 1 << 24, payloads: bool = False) -> DataFrame:
    """Every record of the files: ids, the digest and size of the full payload, type, what it refers to, url, payload."""
    spark = manifest.sparkSession
    out = arrow_schema(spark, RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = open_fs(folder)
        for batch in batches:
            for name, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                with filesystem.open_input_file(f"{root}/{name}") as f:
                    for _, h, payload in RangeReader(f, lo, hi):
                        kind = h.get("warc-type", "")
                        said = h.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "revisit":
                            digest, size = base64.b32decode(said).hex(), int(h["x-payload-length"])
                        else:
                            digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                            if said and base64.b32decode(said).hex() != digest:
                                raise ValueError(f"{name}: a payload does not have the digest that its record states")
                        rows.append((number(h.get("warc-record-id")), size, digest, kind, number(h.get("warc-refers-to")), h.get("warc-target-uri"), payload if payloads else None))
                        held += 200 + (len(payload) if payloads else 0)
                        if held > 1 << 22:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = ranges(manifest, split).repartition(n, "file", "lo").mapInArrow(run, RECORDS)
    return found if payloads else found.drop("payload")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows in DuckDB.
ORACLE_SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    o AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest, max(page_id) OVER (PARTITION BY body) AS owner FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 1000 AND page_id <> owner THEN owner END AS refers_to FROM o"""
