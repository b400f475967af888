"""WARC archives: written by Spark, read back by a reader that salvages what follows damage."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import query, shared_folder, table

#: Salts of a repeated payload, bytes of a record in one gzip member at most.
SALTS = 64
MEMBER_BYTES = 8 << 20
#: Records are written in blocks that end once they hold so many bytes; a file has so many blocks at most.
BLOCK_BYTES = 4 << 20
FILE_BLOCKS = 16
#: Bytes handed to the decompressor at a time: what lies behind a member is copied for each member.
PIECE = 1 << 14

VERSION = b"WARC/1.1"
_MEMBER = b"\x1f\x8b\x08"
_START = re.compile(rb"WARC/1\.|\x1f\x8b\x08")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str,
                 refers_to: int | None) -> bytes:
    """One record. A revisit keeps the HTTP header, with the length of the full payload, and leaves the payload out."""
    revisit = payload is None
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN}{name}>",
             "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Block-Digest: sha1:{_digest(block)}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    if url:
        # white space and control characters would end the header line
        lines.insert(2, "WARC-Target-URI: " + re.sub(
            r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return b"\r\n".join([VERSION, *(x.encode() for x in lines), b"", b""]) + block + b"\r\n\r\n"


def members(record: bytes) -> bytes:
    """A record as gzip members, each of at most MEMBER_BYTES; so the last byte of the size field is always zero."""
    out = []
    for at in range(0, len(record), MEMBER_BYTES):
        packer = zlib.compressobj(3, zlib.DEFLATED, 31)
        out.append(packer.compress(record[at:at + MEMBER_BYTES]) + packer.flush())
    return b"".join(out)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", revisit_from: int = 0, block_bytes: int = BLOCK_BYTES,
                   file_blocks: int = FILE_BLOCKS) -> None:
    """Write one record per row into gzip WARC files under `path`.

    Null payloads count as empty. Of records with equal payloads of at least `revisit_from` bytes, the one with the
    smallest id is a response and the others revisit it; rows that repeat that id and payload are responses too. Rows
    whose id is null revisit if their payload occurs under an id, else they are responses. An empty table writes no record.

    Digests are combined by salted groups, so a payload that fills a third of the table is spread over tasks. The
    text writer of Spark puts the bytes of a column and a separator into a file: the records go in without their last
    byte, a zero of the last gzip size field, and the separator is that byte. So any file system of Spark will do.

    A file ends by bytes, whatever the size of its records: it holds at most `file_blocks` blocks, each of less than
    `block_bytes` and one record more. A very long payload is a record of its own block.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    parts = (rows.where(F.col("size") >= revisit_from).groupBy("digest", "size", "salt")
             .agg(F.min("id").alias("first")))
    firsts = (parts.groupBy("digest", "size").agg(F.min("first").alias("first"), F.collect_set("salt").alias("salts"))
              .select("digest", "size", "first", F.explode("salts").alias("salt")))
    marked = rows.join(firsts, ["digest", "size", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    marked = marked.select("id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest",
                           F.when(revisit, F.col("first")).alias("refers_to"))

    def block(parts):
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], ["value"])

    def build(batches):
        parts, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("id", "url", "payload", "size", "digest", "refers_to"))):
                page, url, payload, size, digest, refers_to = (v.as_py() for v in row)
                record = record_bytes(page, url, payload, size, base64.b32encode(digest).decode(), refers_to)
                parts.append(members(record))
                held += len(parts[-1])
                if held >= block_bytes:
                    yield block(parts)
                    parts, held = [], 0
        if parts:
            yield block(parts)

    (marked.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\0").option("maxRecordsPerFile", file_blocks).text(path))


def _gap(at: int, end: int, reason: str) -> dict:
    return {"gap_start": at, "gap_end": end, "reason": reason}


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at a place of plain bytes and the place behind it; ValueError if a check fails."""
    if not data.startswith(b"WARC/", at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header without end")
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not size.isdigit():
        raise ValueError("no length")
    start, stop = end + 4, end + 4 + int(size)
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError("record without end")
    block = data[start:stop]
    if (want := fields.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != _digest(block):
        raise ValueError("block digest differs")
    return {"fields": fields, "block": block}, stop + 4


def _plain(data: bytes, base: int, last: int) -> Iterator[dict]:
    """Records of plain bytes; after a failed check, on from the next version line. `base`: file place of the bytes."""
    at = 0
    while at < len(data):
        try:
            record, after = _parse(data, at)
        except ValueError as error:
            following = data.find(b"WARC/1.", at + 1)
            after = following if following >= 0 else len(data)
            yield _gap(base + at, (base + after) if following >= 0 else last, str(error))
        else:
            yield record | {"at": base + at, "end": base + after}
        at = after


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive, and the gaps between: dicts with `fields` and `block`, or with gap_start, gap_end, reason.

    Plain and gzip archives are read, records and members in any order. A plain record is as long as its header says,
    whatever its block holds. After a failed check, all is quarantined up to the next place where a version line or a
    member that begins with records stands. Of a gzip member that fails (header, stream, check sum), the records that did
    decompress and pass their own checks are kept; the gap is the member up to that next place.
    """
    at = 0
    while at < len(data):
        if data.startswith(b"WARC/", at):
            try:
                record, after = _parse(data, at)
            except ValueError as error:
                after = _next_start(data, at + 1)
                yield _gap(at, after, str(error))
            else:
                yield record | {"at": at, "end": after}
            at = after
            continue
        try:
            text, after = _members_of_record(data, at)
        except ValueError as error:
            end = 0
            text = _decompressed(data, at)[0]
            for found in _plain(text, 0, len(text)):
                if "fields" in found:
                    end = found["end"]
                    yield found | {"at": at}
            # on from behind the last record kept, so that none is read twice
            after = _next_start(data, _decompressed(data, at, end)[1] if end else at + 1)
            yield _gap(at, after, str(error))
        else:
            for found in _plain(text, 0, len(text)):
                # places inside a member can't be told in file bytes: the gap is the member
                yield _gap(at, after, found["reason"]) if "reason" in found else found | {"at": at}
        at = after


def _decompressed(data: bytes, at: int, most: int | None = None) -> tuple[bytes, int]:
    """What a broken member gives before it fails, or up to `most` bytes of it, and the file place reached."""
    stream, parts, size, step = zlib.decompressobj(31), [], 0, 4096
    while at < len(data) and not stream.eof and (most is None or size < most):
        before = stream.copy()
        try:
            out = stream.decompress(data[at:at + step])
        except zlib.error:
            out = None
        if step > 1 and (out is None or most is not None and size + len(out) > most):
            stream, step = before, 1
            continue
        if out is None:
            break
        parts.append(out)
        size += len(out)
        at = min(at + step, len(data))
    return b"".join(parts), at


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    if not data.startswith(_MEMBER, at):
        raise ValueError("no gzip member")
    stream, parts, rest = zlib.decompressobj(31), [], memoryview(data)
    while not stream.eof:
        piece = rest[at:at + PIECE]
        if not piece:
            raise ValueError("gzip member without end")
        try:
            parts.append(stream.decompress(piece))
        except zlib.error as error:
            raise ValueError(f"gzip: {error}") from None
        at += len(piece)
    return b"".join(parts), at - len(stream.unused_data)


def _members_of_record(data: bytes, at: int) -> tuple[bytes, int]:
    """The text of a member, with the members that continue its record."""
    text, after = _inflate(data, at)
    parts = [text]
    while len(text) == MEMBER_BYTES and after < len(data):
        try:
            text, following = _inflate(data, after)
        except ValueError:
            break
        if text.startswith(b"WARC/"):
            break
        parts.append(text)
        after = following
    return b"".join(parts), after


def _next_start(data: bytes, at: int) -> int:
    """The next place where a version line stands or a member begins that holds one; the end if there is none.

    A broken member counts if its first bytes are a version line.
    """
    for found in _START.finditer(data, at):
        place = found.start()
        if found[0] != _MEMBER:
            return place
        try:
            if b"WARC/1." in _inflate(data, place)[0]:
                return place
        except ValueError:
            if _decompressed(data, place, 7)[0].startswith(b"WARC/1."):
                return place
    return len(data)


def read_archives(spark, path: str) -> DataFrame:
    """Records and quarantined gaps of the WARC files under `path`, one row each.

    Columns: file, record_type, page_id (of this library's record ids), url, payload BINARY (null for revisits),
    payload_bytes, payload_digest, refers_to, and for gaps gap_start, gap_end, gap_reason with all else null.
    A file is read by one task, in time linear in its bytes, so files should be bounded, as `write_archives` makes them.
    A folder without files gives
    no rows.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .where("length > 0").select("path", "content"))
    schema = ("file string, record_type string, page_id bigint, url string, payload binary, payload_bytes bigint, "
              "payload_digest string, refers_to bigint, gap_start bigint, gap_end bigint, gap_reason string")
    names = [c.split()[0] for c in schema.split(", ")]

    def number(text: str | None):
        found = re.fullmatch(rf"<{_URN}(-?\d+)>", text or "")
        return int(found[1]) if found else None

    def row(file, found):
        if "reason" in found:
            return (file, *[None] * 7, found["gap_start"], found["gap_end"], found["reason"])
        fields, block = found["fields"], found["block"]
        kind = fields.get("warc-type")
        head, _, body = block.partition(b"\r\n\r\n")
        size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        whole = kind != "revisit"
        digest = _digest(body) if whole else fields.get("warc-payload-digest", "").removeprefix("sha1:")
        return (file, kind, number(fields.get("warc-record-id")), fields.get("warc-target-uri"),
                body if whole else None, len(body) if whole else int(size[1]) if size else None, digest,
                number(fields.get("warc-refers-to")), None, None, None)

    def parse(batches):
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(),
                 pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                for found in salvage(content.as_py()):
                    rows.append(row(file.as_py(), found))
                    size += len(rows[-1][4] or b"")
                    if len(rows) >= 2000 or size > MEMBER_BYTES:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return files.mapInArrow(parse, schema)


@query("op10_warc")
def op10_warc(spark, sf_dir):
    path = shared_folder(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path).where("gap_start IS NULL")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
