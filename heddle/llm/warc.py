"""WARC (operator 1): gzip archives with one member for each record, an index, and ranged reads.

Writing puts one record after the other into part files of the shared folder and yields
the index: file, offset, length, URL and digest of each record. Reading sorts the selected
index rows by file and offset, joins neighbouring byte ranges into one read, and parses the
records out of it. A task that is run again writes a file of another name, and the index
names only files of tasks that ended well.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.shared import scratch, stored

INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"
#: A payload of at least so many bytes may be replaced by a revisit record.
REVISIT_BYTES = 0
#: Ranges closer than GAP bytes become one read of at most READ bytes (or one longer record).
GAP, READ = 64 << 10, 8 << 20
FILE_BYTES = 1 << 30
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 (160 bits: four groups of 40 bits, eight digits each)."""
    sha = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*groups)), *_BASE32)


def with_types(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to.

    Of equal payloads of at least revisit_bytes, the row with the least page_id is the
    response (all its repeated rows are), the others refer to it. Where all ids of equal
    payloads are null, there is nothing to refer to and all are responses. Only digests
    and ids are shuffled, to find the digests that several rows have; these are stored, so
    their size is known when they are joined back: small, they are broadcast and payloads
    stay where they are; else AQE splits the hot digests of the join.
    """
    p = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", digest(F.col("payload")))
    first = p.groupBy(F.col("digest").alias("__d")).agg(F.min("page_id").alias("__first"), F.count("*").alias("__n"))
    first = stored(first.filter("__n > 1").select("__d", "__first"), "warc-digests")
    p = p.join(first, F.col("digest") == F.col("__d"), "left")
    again = (F.length("payload") >= revisit_bytes) & F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(F.col("page_id"))
    p = p.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("__first")))
    return p.drop("__d", "__first")


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"[a-z0-9]+:", uri) else f"file://{uri}")


def _record(page_id: int | None, url: str | None, payload: bytes, sha: str, kind: str, refers: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: All printable ASCII but the per cent sign: with it, percent-encoding is undone exactly.
SAFE = "".join(map(chr, range(0x21, 0x7F))).replace("%", "")


def write_warc(typed: DataFrame, folder: str) -> DataFrame:
    """Write with_types()'s rows under folder; the index, stored."""

    def run(batches):
        where, base = open_fs(folder)
        where.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        rows: dict[str, list] = {c.split()[0]: [] for c in INDEX.split(", ")}
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                page, url, payload, sha, kind, refers = (get[n][i].as_py() for n in ("page_id", "url", "payload", "digest", "record_type", "refers_to"))
                if out is None:
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{base}/{name}", compression=None)
                pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = pack.compress(_record(page, url, payload, sha, kind, refers)) + pack.flush()
                out.write(member)
                for n, v in zip(rows, (page, url, sha, kind, f"{folder}/{name}", at, len(member)), strict=True):
                    rows[n].append(v)
                at += len(member)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            if out is None or len(rows["file"]) >= 10_000:
                if out is not None:
                    out.close()  # rows of the index are given out only for whole files
                    out = None
                yield _batch(rows)
                rows = {n: [] for n in rows}
        if out is not None:
            out.close()
        if rows["file"]:
            yield _batch(rows)

    return stored(typed.select("page_id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(run, INDEX), "warc-index")


def _batch(rows: dict[str, list]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.string())) for n, v in rows.items()], names=list(rows))


def parse(member: bytes) -> dict:
    """A record of the index out of its gzip member; an error if its digest is not that of its payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != sha):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": None if url is None else unquote(url),
        "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload_bytes": size,
        "payload_digest": sha,
        "payload": payload.decode() if kind == "response" else None,
    }


def ranges(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int, list[tuple[int, int]]]]:
    """Index rows (file, offset, length), sorted, as reads (file, start, end, records in it)."""
    out: list = []
    for file, at, n in rows:
        if out and out[-1][0] == file and at - out[-1][2] <= GAP and at + n - out[-1][1] <= READ:
            out[-1][2] = max(out[-1][2], at + n)
            out[-1][3].append((at, n))
        else:
            out.append([file, at, at + n, [(at, n)]])
    return [tuple(x) for x in out]


def read_warc(index: DataFrame, payloads: bool = True, partitions: int | None = None) -> DataFrame:
    """The records that index rows name: RECORD, without payload unless asked for.

    Rows are dealt by ranges of (file, offset), so a large archive is read by many tasks
    and each reads forward.
    """

    def run(batches):
        opened: dict = {}
        for batch in batches:
            rows = sorted(zip(*(batch.column(batch.schema.names.index(n)).to_pylist() for n in ("file", "offset", "length")), strict=True))
            for file, start, end, parts in ranges(rows):
                if file not in opened:
                    for f in opened.values():
                        f.close()
                    where, path = open_fs(file)
                    opened = {file: where.open_input_file(path)}
                raw = opened[file].read_at(end - start, start)
                got = [parse(raw[a - start : a - start + n]) for a, n in parts]
                yield _batch({n: [r[n] for r in got] for n in names})

    schema = RECORD if payloads else RECORD.removesuffix(", payload string")
    names = [c.split()[0] for c in schema.split(", ")]
    n = partitions or max(index.sparkSession.sparkContext.defaultParallelism, index.rdd.getNumPartitions())
    return index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html; other columns are left behind) as WARC and read all of it back: RECORD without payload.

    A null html is an empty payload, a null url a record without target. Empty tables give
    no archive and no rows.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    return read_warc(write_warc(with_types(pages), folder), payloads=False)
