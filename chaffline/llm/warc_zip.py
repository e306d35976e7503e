"""Web archives packaged as ZIP files: written by Spark tasks, read by ranges without extraction.

A package holds stored (uncompressed) members: `archive/data.warc.gz`, every record a gzip member
of its own, and `indexes/index.cdxj`, one line per record with its place. The reader parses the end
records, ZIP64 or not, and the central directory, finds the stored members and the index, and
fetches records by ranges of the package itself. A package without an index is walked
record by record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaffline.llm.arrays import slices
from chaffline.llm.store import attempt_name, locate, new_folder, write_bytes
from chaffline.session import cut_lineage

#: Compressed bytes of records in a package before the next one is begun.
PACKAGE_BYTES = 32 << 20
#: Bytes a reader fetches at once; a longer record is fetched whole.
RANGE_BYTES = 4 << 20

# Fixed values of the ZIP format: signatures and the mark of a value held in the ZIP64 field.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = (
    b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07",
)
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF
_DATE_1980 = 0x21

ReadAt = Callable[[int, int], bytes]


# Packages --------------------------------------------------------------------------------

def zip_stored(members: list[tuple[str, bytes]], zip64: bool = True) -> bytes:
    """A ZIP file of stored members, sizes and places in ZIP64 fields if `zip64`."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        plain, crc, at, size = name.encode(), zlib.crc32(data), len(out), len(data)
        short = _FULL32 if zip64 else size
        wide = struct.pack("<HHQQ", 1, 16, size, size) if zip64 else b""
        common = struct.pack("<HHHHHIII", 45, 0x800, 0, 0, _DATE_1980, crc, short, short)
        out += _LOCAL + common + struct.pack("<HH", len(plain), len(wide)) + plain + wide + data
        wide = struct.pack("<HHQQQ", 1, 24, size, size, at) if zip64 else b""
        tail = struct.pack("<HHHHHII", len(plain), len(wide), 0, 0, 0, 0, _FULL32 if zip64 else at)
        directory += _CENTRAL + struct.pack("<H", 45) + common + tail + plain + wide
    at, size, count = len(out), len(directory), len(members)
    out += directory
    if zip64:
        out += _END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, at)
        out += _LOCATOR64 + struct.pack("<IQI", 0, at + size, 1)
        count, size, at = _FULL16, _FULL32, _FULL32
    out += _END + struct.pack("<HHHHIIH", 0, 0, count, count, size, at, 0)
    return bytes(out)


@dataclass(frozen=True)
class Member:
    name: str
    offset: int  # of the data in the package
    size: int


def stored_members(read: ReadAt, size: int) -> list[Member]:
    """The members of a package of `size` bytes, from its central directory alone."""
    tail_at = max(0, size - 22 - _FULL16)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(_END)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if _FULL16 == count or _FULL32 in (length, at):
        locator = read(tail_at + end - 20, 20)
        if locator[:4] == _LOCATOR64:
            place = struct.unpack_from("<Q", locator, 8)[0]
            record = read(place, 56)
            if record[:4] != _END64:
                raise ValueError("broken ZIP64 end of central directory")
            count, length, at = struct.unpack_from("<QQQ", record, 32)
    directory, members, p = read(at, length), [], 0
    for _ in range(count):
        if directory[p : p + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", directory, p + 10)[0]
        packed, plain, n, extra, comment = struct.unpack_from("<IIHHH", directory, p + 20)
        offset = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n].decode()
        wide = _zip64_values(directory[p + 46 + n : p + 46 + n + extra])
        values = [next(wide) if v == _FULL32 else v for v in (plain, packed, offset)]
        p += 46 + n + extra + comment
        if method != 0:
            raise ValueError(f"{name} is compressed in its package: its records have no ranges")
        header = read(values[2], 30)
        if header[:4] != _LOCAL:
            raise ValueError(f"broken local header of {name}")
        n, extra = struct.unpack_from("<HH", header, 26)
        members.append(Member(name, values[2] + 30 + n + extra, values[1]))
    return members


def _zip64_values(extra: bytes) -> Iterator[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            yield from struct.unpack_from(f"<{size // 8}Q", extra, at + 4)
        at += 4 + size


# Records ---------------------------------------------------------------------------------

def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [f"{k}: {' '.join(v.split())}" for k, v in headers.items() if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, names in lower case, and block of the first record of `data`."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("a WARC record is cut short")
    return headers, rest[:size]


def digest_label(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def digest_hex(label: str) -> str:
    return base64.b32decode(label.removeprefix("sha1:")).hex()


def _urn(key) -> str:
    """The record id of a page; a page without an id gets one that no other record has."""
    return f"<urn:uuid:{uuid.uuid4()}>" if key is None else f"<urn:page:{key}>"


def _page_record(row: dict, date: str) -> bytes:
    payload = (row["payload"] or "").encode()
    headers = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": _urn(row["page_id"]),
        "WARC-Date": date,
        "WARC-Target-URI": row["url"],
        "WARC-Payload-Digest": digest_label(row["payload_digest"]),
        "WARC-Payload-Length": str(row["payload_bytes"]),
        "Content-Type": "application/http; msgtype=response",
    }
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    if row["record_type"] == "revisit":
        headers["WARC-Refers-To"] = _urn(row["refers_to"])
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return warc_record(headers, http.encode())
    return warc_record(headers, http.encode() + payload)


# Writing ---------------------------------------------------------------------------------

def mark_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Pages with payload, payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of at least `least_bytes` bytes the page with the largest id is the response.
    """
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select(
        "page_id",
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
    )
    # What repeats is found from one row per digest and task; the payloads then move once, by digest.
    repeated = (
        keyed.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    revisit = F.col("page_id") < F.col("response")
    return keyed.join(repeated, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response")).alias("refers_to"),
    )


def write_packages(pages: DataFrame, folder: str | None = None, least_bytes: int = 1000) -> DataFrame:
    """Write a WARC record per page into packages and return their manifest (path, n_records).

    Without `folder` the packages go to a new folder below the session's checkpoint folder. Null
    html is an empty payload, a null url leaves its header out; line breaks in a url become spaces.
    Pages without an id or that repeat one have a record each and never are a revisit of
    themselves. An empty table writes nothing.
    """
    target = folder or new_folder(pages.sparkSession, "packages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, written = TaskContext.get().partitionId(), []
        date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        data, lines = bytearray(), []

        def close() -> None:
            path = f"{target}/{attempt_name(task, len(written), '.wacz')}"
            about = json.dumps({"profile": "data-package", "resources": [{"path": "archive/data.warc.gz"}]})
            members = [
                ("archive/data.warc.gz", bytes(data)),
                ("indexes/index.cdxj", "".join(lines).encode()),
                ("datapackage.json", about.encode()),
            ]
            write_bytes(path, zip_stored(members))
            written.append((path, len(lines)))
            data.clear()
            lines.clear()

        for batch in slices(batches, "payload", 8 << 20):
            for row in batch.to_pylist():
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                record = packer.compress(_page_record(row, date)) + packer.flush()
                place = {"offset": len(data), "length": len(record), "filename": "data.warc.gz"}
                lines.append(f"urn:page:{row['page_id']} - {json.dumps(place)}\n")
                data += record
                if len(data) >= PACKAGE_BYTES:
                    close()
        if lines:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in written], pa.string()), pa.array([n for _, n in written], pa.int64())],
            ["path", "n_records"],
        )

    return cut_lineage(mark_revisits(pages, least_bytes).mapInArrow(run, "path string, n_records long"))


# Reading ---------------------------------------------------------------------------------

def list_ranges(packages: DataFrame) -> DataFrame:
    """Ranges of whole records in packages (column `path`): path, offset, length, parts.

    `parts` are the lengths of the records in the range; it is null where a package has no index
    and the range is a whole member to walk through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = locate(path)
                with store.open_input_file(place) as source:
                    members = stored_members(lambda at, n: source.read_at(n, at), source.size())
                    rows = list(_ranges(members, lambda at, n: source.read_at(n, at)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(rows), pa.string()),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                    ],
                    ["path", "offset", "length", "parts"],
                )

    return packages.select("path").mapInArrow(run, "path string, offset long, length long, parts array<long>")


def _ranges(members: list[Member], read: ReadAt) -> Iterator[tuple[int, int, list[int] | None]]:
    archives = {m.name.rpartition("/")[2]: m for m in members if m.name.startswith("archive/")}
    places: dict[str, list[tuple[int, int]]] = {}
    for index in (m for m in members if m.name.startswith("indexes/")):
        for line in read(index.offset, index.size).decode().splitlines():
            entry = json.loads(line[line.index("{") :])
            places.setdefault(entry["filename"], []).append((int(entry["offset"]), int(entry["length"])))
    for name, archive in archives.items():
        if name not in places:
            yield archive.offset, archive.size, None
            continue
        at, total, parts = 0, 0, []
        for offset, length in sorted(places[name]):
            if parts and (total + length > RANGE_BYTES or at + total != offset):
                yield archive.offset + at, total, parts
                parts = []
            if not parts:
                at, total = offset, 0
            parts.append(length)
            total += length
        if parts:
            yield archive.offset + at, total, parts


def _records(read: ReadAt, offset: int, length: int, parts: list[int] | None) -> Iterator[bytes]:
    if parts is not None:
        data, at = read(offset, length), 0
        for size in parts:
            yield _plain(data[at : at + size])
            at += size
        return
    end, held = offset + length, b""
    while offset < end or held:
        # One gzip member, or one plain record, at a time.
        if not held:
            held = read(offset, min(RANGE_BYTES, end - offset))
            offset += len(held)
        if held[:2] == b"\x1f\x8b":
            unpack, out = zlib.decompressobj(31), b""
            while not unpack.eof:
                out += unpack.decompress(held)
                held = unpack.unused_data
                if not unpack.eof:
                    if offset >= end:
                        raise ValueError("an archive is cut short")
                    held = read(offset, min(RANGE_BYTES, end - offset))
                    offset += len(held)
            yield out
        else:
            size = None
            while size is None or len(held) < size:
                head = held.find(b"\r\n\r\n")
                if head >= 0:
                    fields = held[:head].lower().split(b"\r\n")
                    own = next(int(f.split(b":")[1]) for f in fields if f.startswith(b"content-length:"))
                    size = head + 4 + own + 4
                    if len(held) >= size:
                        break
                if offset >= end:
                    raise ValueError("an archive is cut short")
                more = read(offset, min(RANGE_BYTES, end - offset))
                offset, held = offset + len(more), held + more
            yield held[:size]
            held = held[size:]


def _plain(data: bytes) -> bytes:
    return zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data


_RECORD = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string())]
    + [("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)


def _record_row(data: bytes) -> dict:
    headers, block = parse_record(data)
    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
    kind = headers["warc-type"]
    label = headers.get("warc-payload-digest")
    found = hashlib.sha1(payload).hexdigest()
    if kind != "revisit":
        if label and label.startswith("sha1:") and digest_hex(label) != found:
            raise ValueError(f"{headers['warc-record-id']}: the payload does not match its digest")
        digest, size = found, len(payload)
    else:
        digest = digest_hex(label) if label else None
        size = int(headers["warc-payload-length"]) if "warc-payload-length" in headers else None
    return {
        "record_id": headers["warc-record-id"],
        "record_type": kind,
        "target_uri": headers.get("warc-target-uri"),
        "refers_to": headers.get("warc-refers-to"),
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": None if kind == "revisit" else payload,
    }


def read_packages(packages: DataFrame) -> DataFrame:
    """The records of packages (column `path`), one row each.

    record_id, record_type, target_uri, refers_to (a record_id), payload_digest (hex), payload_bytes
    (both of the full payload, for revisits too) and payload (null for revisits). The
    payload of every other record is checked against its digest. Packages may be ZIP64 or not; a
    member that is not stored, or a record cut short, is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = locate(row["path"])
                with store.open_input_file(place) as source:
                    rows, size = [], 0
                    for data in _records(lambda at, n: source.read_at(n, at), row["offset"], row["length"], row["parts"]):
                        rows.append(_record_row(data))
                        size += len(data)
                        if size > RANGE_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _RECORD)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)

    ranges = cut_lineage(list_ranges(packages))
    parallel = max(packages.sparkSession.sparkContext.defaultParallelism, ranges.rdd.getNumPartitions())
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")]
        + [T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType())]
    )
    return ranges.repartition(parallel).mapInArrow(run, schema)
