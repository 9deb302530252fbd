"""WARC records in ZIP packages: a writer, and a reader that range-reads records without extracting a package.

A package is a ZIP file with archive members (``archive/*.warc`` or ``archive/*.warc.gz``, one gzip member a record in the
latter) and index members (``indexes/*.cdx`` or ``indexes/*.cdxj``, one line a record with its file and place). The reader
finds the end-of-central-directory record (or the ZIP64 one behind its locator), parses the central directory, resolves each
stored member's data offset through its local header, reads the indexes, and then reads just the byte ranges of records,
neighbouring ranges at once, in parallel over packages and over blocks of a package.

Nothing is passed over silently. Stretches of a stored member that no index line covers are read record by record; a member
that is deflated can't be range-read and is inflated as a stream; a member packed in any other way, a broken directory, index
or record is an error that names package and member. Records other than responses and revisits (requests, metadata) are no
pages and give no rows. Paths are opened through pyarrow's file systems, so packages may lie in any store that those reach.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.tables import new_path, stored

#: A package is closed at this size; payloads of at least MIN_REVISIT bytes are stored once.
PACKAGE_BYTES, MIN_REVISIT = 64 << 20, 1000
#: Byte ranges of records are dealt out by blocks of this size, and read together up to READ_BYTES.
BLOCK_BYTES, READ_BYTES = 16 << 20, 4 << 20
#: The most groups of equal payloads whose digests are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 100_000
#: Index lines or records that one batch holds at most.
BATCH_ROWS = 4096
DATE = "2024-01-01T00:00:00Z"
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


# Records ------------------------------------------------------------------------------------------------------------


def _record(page, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: a response, or a revisit whose block is the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {quote(url or '', safe='%/:=&?~#+!$,;@()*[]')}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _page(urn: str | None) -> int | None:
    """The page of a record id that the writer made; None for any other id."""
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.removeprefix("-").isdigit() else None


def parse_record(raw: bytes) -> dict | None:
    """A record's type, ids, full payload's size and digest, and payload (None for a revisit). None for other types of record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _fields(head)
    if not head.startswith(b"WARC/") or len(rest) < int(warc["content-length"]):
        raise ValueError("no whole WARC record")
    if warc["warc-type"] not in ("response", "revisit"):
        return None
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = warc["warc-type"] == "revisit"
    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex() if revisit else hashlib.sha1(payload).hexdigest()
    return {
        "page_id": _page(warc.get("warc-record-id")), "url": warc.get("warc-target-uri"), "record_type": warc["warc-type"],
        "payload_bytes": int(_fields(http)["content-length"]) if revisit else len(payload), "payload_digest": digest,
        "refers_to": _page(warc.get("warc-refers-to")), "payload": None if revisit else payload}


# Writing ------------------------------------------------------------------------------------------------------------


class _Package:
    """A package being written to a stream; its name is new, so a repeated task attempt never touches another's file."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        store, name = opened(self.path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(name)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(MEMBER), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, url: str, record: bytes) -> None:
        packed = gzip.compress(record, 1, mtime=0)
        self.member.write(packed)
        self.lines.append(f"{quote(url or '-')} {DATE} {json.dumps({'filename': MEMBER.rpartition('/')[2], 'offset': self.at, 'length': len(packed)})}\n")
        self.at += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines))
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines), self.at


def _written(batches, folder: str, package_bytes: int):
    package, done = None, []
    for batch in batches:
        for page, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            package = package or _Package(folder)
            package.add(url, _record(page, url, payload, digest, refers_to))
            if package.at >= package_bytes:
                done.append(package.close())
                package = None
    if package:
        done.append(package.close())
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "records", "bytes"])


def write_packages(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per row under folder; return the packages (path, records, bytes).

    Payload: the html in UTF-8, empty if null. Of equal payloads of MIN_REVISIT bytes or more the row with the largest id is
    the response and the others revisit it; rows that repeat that id are responses too, and a group without any id has only
    responses. Null urls are empty. No rows: no packages.
    """
    content = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), content.alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.max("page").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    groups = stored(groups, "equal-payloads")
    joined = rows.join(F.broadcast(groups) if groups.count() <= MAX_BROADCAST else groups, "digest", "left")
    refers_to = F.when(F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    return stored(joined.select("page", "url", "payload", "digest", refers_to.alias("refers_to"))
                  .mapInArrow(lambda it: _written(it, folder, package_bytes), "path string, records bigint, bytes bigint"), "packages")


# Reading ------------------------------------------------------------------------------------------------------------


def directory(read_at, size: int) -> list[dict]:
    """The members of a ZIP file: name, method, sizes, and the offset of the local header. read_at(offset, length) reads."""
    tail_at = max(0, size - 65_557)
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, at = struct.unpack_from("<HII", tail, end + 10)
    where = tail_at + end - 20
    if where >= 0 and (locator := read_at(where, 20)).startswith(b"PK\x06\x07"):
        (far,) = struct.unpack_from("<Q", locator, 8)
        wide = read_at(far, 56)
        if not wide.startswith(b"PK\x06\x06"):
            raise ValueError("no ZIP64 end of central directory where its locator points")
        entries, length, at = struct.unpack_from("<QQQ", wide, 32)
    data, p, members = read_at(at, length), 0, []
    for _ in range(entries):
        if data[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, plain, n, x, c, offset = *struct.unpack_from("<H", data, p + 10), *struct.unpack_from("<IIHHH", data, p + 20), *struct.unpack_from("<I", data, p + 42)
        name = data[p + 46 : p + 46 + n].decode("utf-8", "replace")
        extra, e = data[p + 46 + n : p + 46 + n + x], 0
        while e + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # only the fields that are full in the short form, in this order
                q = e + 4
                for field in ("plain", "packed", "offset"):
                    if {"plain": plain, "packed": packed, "offset": offset}[field] == 0xFFFFFFFF:
                        (value,) = struct.unpack_from("<Q", extra, q)
                        q += 8
                        plain, packed, offset = (value if field == f else v for f, v in (("plain", plain), ("packed", packed), ("offset", offset)))
            e += 4 + width
        members.append({"name": name, "method": method, "packed": packed, "plain": plain, "header": offset})
        p += 46 + n + x + c
    return members


def data_offset(read_at, member: dict) -> int:
    """Where a member's data begin: behind its local header, whose name and extra field have lengths of their own."""
    head = read_at(member["header"], 30)
    if not head.startswith(b"PK\x03\x04"):
        raise ValueError("no local header")
    n, x = struct.unpack_from("<HH", head, 26)
    return member["header"] + 30 + n + x


def _present(piece: bytes) -> bytes:
    """A piece of a member; none at all means that the directory tells of bytes beyond the file's end."""
    if not piece:
        raise ValueError("the file ends within a member")
    return piece


def _inflated(read_at, start: int, length: int):
    """A deflated member's bytes, in pieces."""
    inflate, at = zlib.decompressobj(-15), start
    while not inflate.eof:
        if at >= start + length:
            raise ValueError("deflated data end early")
        piece = _present(read_at(at, min(1 << 20, start + length - at)))
        at += len(piece)
        out = inflate.decompress(piece, 1 << 22)
        while out or inflate.unconsumed_tail:
            yield out
            out = inflate.decompress(inflate.unconsumed_tail, 1 << 22)


def _stored_bytes(read_at, start: int, length: int):
    at = start
    while at < start + length:
        piece = _present(read_at(at, min(1 << 20, start + length - at)))
        at += len(piece)
        yield piece


def _bytes_of(read_at, member: dict):
    """A whole member's bytes, in pieces."""
    start = data_offset(read_at, member)
    return (_inflated if member["method"] == 8 else _stored_bytes)(read_at, start, member["packed"])


def _records(parts):
    """The records in a stream of bytes, gzip members or plain ones; each is parsed once it is whole, and nothing is read twice."""
    data = b""
    for part in parts:
        data += part
        if data[:1] == b"\x1f":
            while data:
                inflate = zlib.decompressobj(31)
                out = [inflate.decompress(data)]
                while not inflate.eof:
                    more = next(parts, None)
                    if more is None:
                        raise ValueError("a gzip member ends early")
                    out.append(inflate.decompress(more))
                data = inflate.unused_data
                yield b"".join(out)
        else:
            while (at := data.find(b"\r\n\r\n")) >= 0:
                size = at + 4 + int(_fields(data[:at])["content-length"])
                held, n = [data], len(data)
                while n < size + 4 and (more := next(parts, None)) is not None:
                    held.append(more)
                    n += len(more)
                data = b"".join(held)  # once a record, however many parts it has
                if n < size:
                    raise ValueError("a record ends early")
                yield data[:size]
                data = data[size + 4 :]
    if data.strip(b"\r\n"):
        raise ValueError("bytes after the last record")


def _lines(parts):
    rest = b""
    for part in parts:
        *lines, rest = (rest + part).split(b"\n")
        yield from lines
    yield rest


def _indexed(read_at, indexes: list[dict], archives: list[dict]) -> dict[str, list[tuple[int, int]]]:
    """By archive member the places of its records, in order, that the indexes tell."""
    by_name = {m["name"].rpartition("/")[2]: m["name"] for m in archives}
    places: dict[str, list[tuple[int, int]]] = {m["name"]: [] for m in archives}
    for index in indexes:
        for line in _lines(_bytes_of(read_at, index)):
            if b"{" not in line:
                continue  # a blank line or a header
            entry = json.loads(line[line.index(b"{") :])
            name = by_name[entry["filename"].rpartition("/")[2]] if "filename" in entry or len(archives) > 1 else archives[0]["name"]
            places[name].append((int(entry["offset"]), int(entry["length"])))
    return {name: sorted(set(found)) for name, found in places.items()}


def _places(read_at, size: int):
    """(member, offset, length, kind) of everything to be read: a record of an index, a stretch to read record by record, or a
    whole deflated member."""
    members = [m for m in directory(read_at, size) if not m["name"].endswith("/")]
    archives = [m for m in members if m["name"].startswith("archive/")]
    for m in archives:
        if m["method"] not in (0, 8):
            raise ValueError(f"member {m['name']} is packed by method {m['method']}")
    indexes = [m for m in members if m["name"].startswith("indexes/") and m["name"].endswith((".cdx", ".cdxj")) and archives]
    indexed = _indexed(read_at, indexes, archives)
    for m in archives:
        start = data_offset(read_at, m)
        if m["method"] == 8:
            yield m["name"], start, m["packed"], "deflated"
            continue
        upto = 0
        for offset, length in [*indexed[m["name"]], (m["packed"], 0)]:
            if offset < upto or offset + length > m["packed"]:
                raise ValueError(f"an index has places that overlap or lie outside of {m['name']}")
            if offset > upto:
                yield m["name"], start + upto, offset - upto, "stretch"
            if length:
                yield m["name"], start + offset, length, "record"
            upto = offset + length


def _located(batches):
    names = ["path", "member", "offset", "length", "kind"]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                store, name = opened(path)
                with store.open_input_file(name) as file:
                    rows = []
                    for place in _places(lambda offset, length, f=file: f.read_at(length, offset), file.size()):
                        rows.append((path, *place))
                        if len(rows) == BATCH_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                            rows = []
            except (KeyError, ValueError, struct.error, zlib.error) as e:
                raise ValueError(f"package {path}: {e}") from e
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)


def _ranges(batches):
    """Neighbouring places of one member, records together up to READ_BYTES; anything else alone."""
    key, run = None, []
    for batch in batches:
        for path, member, offset, length, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run and ((path, member, kind) != key or kind != "record" or offset != run[-1][0] + run[-1][1] or offset + length - run[0][0] > READ_BYTES):
                yield *key, run
                run = []
            key = (path, member, kind)
            run.append((offset, length))
    if run:
        yield *key, run


_FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]


def _raw_records(read_at, kind: str, run: list[tuple[int, int]]):
    if kind == "record":
        start = run[0][0]
        data = read_at(start, run[-1][0] + run[-1][1] - start)
        for offset, length in run:
            raw = data[offset - start : offset - start + length]
            yield zlib.decompress(raw, 31) if raw[:1] == b"\x1f" else raw
    else:
        (place,) = run
        yield from _records((_inflated if kind == "deflated" else _stored_bytes)(read_at, *place))


def _read(batches, with_payload: bool):
    fields = _FIELDS if with_payload else _FIELDS[:-1]

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in fields], [k for k, _ in fields])

    for path, member, kind, run in _ranges(batches):
        found, size = [], 0
        try:
            store, name = opened(path)
            with store.open_input_file(name) as file:
                for raw in _raw_records(lambda offset, length, f=file: f.read_at(length, offset), kind, run):
                    if (record := parse_record(raw)) is not None:
                        found.append(record)
                        size += len(raw)
                    if size > READ_BYTES or len(found) == BATCH_ROWS:
                        yield batch_of(found)
                        found, size = [], 0
        except (KeyError, ValueError, zlib.error) as e:
            raise ValueError(f"package {path}, member {member}: {e}") from e
        if found:
            yield batch_of(found)


def read_packages(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of packages (column path): page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    payload is null for revisits. Sizes and digests are of the full payload: of a response computed from what was read. page_id
    is null for records of other writers. A path that repeats is read once, a null path not at all; one that can't be read, and
    a damaged package, is an error. No packages, no rows; other columns are ignored.
    """
    paths = packages.select("path").filter("path IS NOT NULL").distinct()
    places = paths.repartition(max(1, paths.count()), "path").mapInArrow(_located, "path string, member string, offset bigint, length bigint, kind string")
    places = stored(places, "places")
    total = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(places.sparkSession.sparkContext.defaultParallelism, total // BLOCK_BYTES + 1)
    dealt = places.withColumn("block", F.floor(F.col("offset") / (BLOCK_BYTES // 4))).repartition(int(tasks), "path", "block")
    kind = ", ".join(f"{k} {({pa.int64(): 'bigint', pa.string(): 'string'}).get(t, 'binary')}" for k, t in (_FIELDS if with_payload else _FIELDS[:-1]))
    return dealt.sortWithinPartitions("path", "offset").drop("block").mapInArrow(lambda it: _read(it, with_payload), kind)


def round_trip(pages: DataFrame, with_payload: bool = False, **columns: str) -> DataFrame:
    """Write the rows of pages as packages in the shared folder and read every record back: a row of the result per row of pages.

    Null htmls are empty payloads, null urls empty, null ids stay null; very long payloads are one record; repeated rows stay rows
    (see write_packages for ties); other columns are ignored; an empty table gives no rows."""
    folder = new_path(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, folder, **columns), with_payload)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
g AS (SELECT *, count(*) OVER (PARTITION BY digest) AS c, max(page_id) OVER (PARTITION BY digest) AS m FROM d),
r AS (SELECT *, n >= 1000 AND c > 1 AND m IS NOT NULL AND page_id IS DISTINCT FROM m AS again FROM g)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN m END AS refers_to
FROM r
"""
