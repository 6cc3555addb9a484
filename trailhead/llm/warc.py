"""Legacy archive converter: ARC records become WARC records.

ARC files are a run of records, each a header line whose fields depend on the file's version block and whose last field
declares the length of what follows. ``parse_arc`` reads both versions by these lengths; ``to_warc`` makes the equivalent
WARC/1.1 record: an identifier derived from key and payload digest, the 14-digit date as a WARC-Date, the record type and
the SHA-256 digests. ``write_archives`` and ``read_archives`` do this for tables, in files that only Spark writes
and lists, so any store it can reach will do and lost tasks leave no partial archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailhead.llm.common import cut, fresh_path, named, small_batches, small_side
from trailhead.llm.textops import parts, tidy

# The field names that a version block declares.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
#: Payloads of fewer bytes are never revisits.
LEAST = 100
KEY = b"X-Record-Key"
#: Records are written in bundles of at most so many bytes, or one record, and files hold so many bundles. A longer record counts as
#: several, so a file holds at most BUNDLE * PER_FILE bytes and one record more.
BUNDLE, PER_FILE = 4 << 20, 16


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    body: bytes
    version: int
    status: int | None = None


def version_block(version: int, name: str = "legacy.arc", date: str = "20000101000000") -> bytes:
    """The first record of an ARC file: it names the version and the fields of all later header lines."""
    body = f"{version} 0 trailhead\n{FIELDS[version]}\n".encode()
    tail = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {tail}{len(body)}\n".encode() + body + b"\n"


def arc_record(url: str, date: str, body: bytes, version: int, offset: int = 0, mime: str = "text/html", ip: str = "0.0.0.0", status: int = 200, name: str = "legacy.arc") -> bytes:
    """One ARC record. White space in the url is percent-encoded, as the header line is cut at blanks."""
    url = re.sub(r"[\s\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "urn:none"
    head = f"{url} {ip} {date} {mime} {len(body)}\n" if version == 1 else f"{url} {ip} {date} {mime} {status} {hashlib.md5(body).hexdigest()} - {offset} {name} {len(body)}\n"
    return head.encode("utf-8", "surrogatepass") + body + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block, cut by their declared lengths.

    A wrong field count, a length beyond the file or a missing version block is an error.
    """
    at, version, names = 0, 0, []
    while at < len(data):
        if data[at : at + 1] == b"\n":  # records end with a newline; some writers add more
            at += 1
            continue
        eol = data.index(b"\n", at)
        parts = data[at:eol].decode("utf-8", "surrogatepass").rstrip("\r").split(" ")
        first = parts[0].startswith("filedesc://")
        if not first and len(parts) != len(names):
            raise ValueError(f"ARC header line at {at}: {len(parts)} fields, {len(names)} declared")
        length = int(parts[-1])
        body = data[eol + 1 : eol + 1 + length]
        if len(body) != length:
            raise ValueError(f"ARC record at {at}: {length} bytes declared, {len(body)} left")
        at = eol + 1 + length
        if first:
            lines = body.decode("ascii", "replace").split("\n")
            version, names = int(lines[0].split(" ")[0]), lines[1].split(" ")
            continue
        f = dict(zip(names, parts, strict=True))
        yield ArcRecord(f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], body, version, int(f["Result-code"]) if "Result-code" in f else None)


def record_id(key: str, digest: str) -> str:
    """A stable identifier: the same key and payload give the same one on every run."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{key} {digest}'.encode()).digest()[:16], version=5)}>"


def warc_date(date: str) -> str:
    """14 digits (or fewer: missing parts are the first of their kind) as an ISO 8601 time in UTC."""
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its empty line) and payload; without a head, the payload is all of it."""
    at = body.find(END) if body.startswith(b"HTTP/") else -1
    return (b"", body) if at < 0 else (body[: at + 4], body[at + 4 :])


def field(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*(.*?)[ \t]*\r?$", head)
    return m[1].decode("utf-8", "surrogatepass") if m else None


def to_warc(rec: ArcRecord, key: str, refers: str | None = None) -> bytes:
    """The WARC record of an ARC record, without the two line ends that follow a record.

    HTTP captures become response records, others resource records; with refers (the key of an earlier record with an equal
    payload) it is a revisit record that keeps only the HTTP head. The payload digest is the full payload's.
    """
    head, payload = http_parts(rec.body)
    digest = hashlib.sha256(payload).hexdigest()
    kind = "revisit" if refers is not None else "response" if head else "resource"
    block = head if refers is not None else rec.body
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {warc_date(rec.date)}", f"WARC-Target-URI: {rec.url}", f"WARC-IP-Address: {rec.ip}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Type: {'application/http; msgtype=response' if head else rec.mime}", f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: {record_id(refers, digest)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + END + block


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(head, block) of every record of a WARC file, cut by Content-Length."""
    return records(iter([data]))


def records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(head, block) of every record of a WARC file that comes in chunks; no more than a record and a chunk are held."""
    buffer, gone = bytearray(), 0

    def more() -> bool:
        chunk = next(chunks, None)
        buffer.extend(chunk or b"")
        return chunk is not None

    while True:
        while len(buffer) < 5 and more():
            pass
        if buffer[:2] == b"\r\n":
            del buffer[:2]
            gone += 2
            continue
        if not buffer:
            return
        if buffer[:5] != b"WARC/":
            raise ValueError(f"no WARC record at {gone}")
        while (end := buffer.find(END)) < 0:
            if not more():
                raise ValueError(f"the head of the WARC record at {gone} doesn't end")
        head, end = bytes(buffer[: end + 4]), end + 4
        length = int(field(head, b"Content-Length"))
        while len(buffer) < end + length:
            if not more():
                raise ValueError(f"WARC record at {gone}: {length} bytes declared, {len(buffer) - end} left")
        yield head, bytes(buffer[end : end + length])
        del buffer[: end + length]
        gone += end + length


def inflate(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of all members of a gzip file in chunks; other files as they are."""
    zipped, member = data[:2] == b"\x1f\x8b", None
    for lo in range(0, len(data), step):
        piece = data[lo : lo + step]
        if not zipped:
            yield piece
            continue
        while piece:
            member = member or zlib.decompressobj(31)
            yield member.decompress(piece)
            piece = member.unused_data
            if member.eof:
                member = None
    if member:
        raise ValueError("the gzip file ends within a member")


def revisits(df: DataFrame, key: str, body: str) -> DataFrame:
    """df plus payload_digest and first_key: the smallest key with an equal payload of at least LEAST bytes, for the
    other rows with that payload; else null. One aggregation with map-side combine; only repeated digests are joined."""
    df = df.withColumn("payload_digest", F.sha2(F.coalesce(named(body), F.lit("")).cast("binary"), 256))
    long = df.where(F.octet_length(named(body)) >= LEAST).select("payload_digest", key)
    first = cut(long.groupBy("payload_digest").agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-first")
    out = df.join(small_side(first, first.count()), "payload_digest", "left")
    return out.withColumn("first_key", F.when(F.col(key).isNull() | (F.col(key) > F.col("first_key")), F.col("first_key")))


def write_archives(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html", date: str = "20240101000000", bundle: int = BUNDLE, per_file: int = PER_FILE) -> None:
    """Write one WARC record per row, each converted from an ARC record, as gzip files in a new folder.

    Rows go through ARC segments of both versions in turn, which the converter parses by declared lengths. A null body is an empty
    payload; a null url is urn:none; of rows with one key and one payload all are responses. Keys of 64 bits come through as they are.
    Files are bounded in bytes (BUNDLE, PER_FILE). Extra columns aren't read.
    """
    rows = revisits(df.select(named(key).alias("k"), named(url).alias("u"), named(body).alias("b")), "k", "b")
    rows = rows.select(F.col("k").cast("string"), "u", "b", F.col("first_key").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bundled(made: list[bytes]) -> pa.RecordBatch:
            # a record ends with two line ends, which the writer puts after each row; empty rows are no records and fill the file
            size = sum(map(len, made))
            return pa.RecordBatch.from_arrays([pa.array([END.join(made), *[b""] * (min(per_file, -(-size // bundle)) - 1)], pa.binary())], ["record"])

        pending, size = [], 0
        for n, (part, texts) in enumerate(parts(batches, 2, most=1 << 20, rows=64)):
            segment = [version_block(1 + n % 2)]
            offset = len(segment[0])
            keys, refers = ["" if x is None else x for x in part.column(0).to_pylist()], part.column(3).to_pylist()
            for k, u, text in zip(keys, part.column(1).to_pylist(), texts, strict=True):
                payload = (text or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{KEY.decode()}: {k}\r\n\r\n".encode()
                segment.append(arc_record(u or "urn:none", date, head + payload, 1 + n % 2, offset))
                offset += len(segment[-1])
            for rec, k, r in zip(parse_arc(b"".join(segment)), keys, refers, strict=True):
                record = to_warc(rec, k, r)
                if pending and size + len(record) > bundle:
                    yield bundled(pending)
                    pending, size = [], 0
                pending.append(record)
                size += len(record)
        if pending:
            yield bundled(pending)

    made = rows.mapInArrow(tidy(run), "record binary")
    # the text writer's separator ends each record; casting bytes to a string leaves them as they are
    with small_batches(df.sparkSession):
        made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def read_archives(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """One row per record of the WARC files in a folder: record_id, record_type, target_uri, date, key, payload_bytes,
    payload_digest (bare hex), refers_to_id; with content also payload (binary; null for revisits).

    The payload of records that hold one is measured and hashed anew and must agree with the record's digest. Files are inflated and
    parsed in chunks; what is held is the file as it is stored, a record and a few thousand rows.
    """
    kinds = {"record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "date": pa.string(), "key": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to_id": pa.string()} | ({"payload": pa.binary()} if content else {})

    def row(head: bytes, block: bytes) -> tuple:
        inner, payload = http_parts(block)
        kind, said = field(head, b"WARC-Type"), field(head, b"WARC-Payload-Digest").removeprefix("sha256:")
        whole = kind != "revisit"
        if whole and hashlib.sha256(payload).hexdigest() != said:
            raise ValueError(f"payload digest of {field(head, b'WARC-Record-ID')} doesn't agree")
        n = len(payload) if whole else int(field(inner, b"Content-Length"))
        k = field(inner, KEY)
        return (field(head, b"WARC-Record-ID"), kind, field(head, b"WARC-Target-URI"), field(head, b"WARC-Date"), int(k) if k else None, n, said, field(head, b"WARC-Refers-To"), *([payload if whole else None] * content))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))

        for b in batches:
            for data in b.column(0):
                rows, held = [], 0
                for head, block in records(inflate(data.as_py())):
                    rows.append(row(head, block))
                    held += len(block) if content else 500
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    schema = ", ".join(f"{n} {'long' if k == pa.int64() else 'binary' if k == pa.binary() else 'string'}" for n, k in kinds.items())
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(tidy(run), schema)


def round_trip(spark: SparkSession, df: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Write df's rows as archives in the shared folder and read them back: per row key, payload_bytes, payload_digest,
    record_type, refers_to (the response's key), record_id, target_uri. An empty table gives no rows; null keys, urls and bodies and
    rows that repeat a key are as in ``write_archives``; df's other columns aren't read.
    """
    folder = fresh_path(spark, "warc")
    write_archives(df, folder, key, url, body)
    back = cut(read_archives(spark, folder), "warc-rows")
    first = back.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to"))
    wanted = back.where("refers_to_id is not null").select("refers_to_id").distinct()
    first = first.join(wanted, "refers_to_id", "left_semi").groupBy("refers_to_id").agg(F.min("refers_to").alias("refers_to"))
    return back.join(first, "refers_to_id", "left").select(F.col("key").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri")
