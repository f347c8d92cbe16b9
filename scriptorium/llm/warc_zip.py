"""WARC records in ZIP packages: write, and read back without extraction.

A package is a ZIP whose members are stored: ``archive/data.warc.gz`` (one
gzip member per WARC record) and ``indexes/index.cdxj`` (one line per record:
offset and length inside the member).  The reader parses the end-of-central-
directory record, its ZIP64 form where present, the central directory and the
local headers, turns index lines into absolute byte ranges, and reads only
those ranges.  Work is dealt by record, not by package.

Files are reached through ``pyarrow.fs`` (file, s3, gs, hdfs URIs), under the
folder named by ``spark.checkpoint.dir`` unless another is given.  A task
writes packages under names no other attempt uses; only packages listed by
successful tasks enter the manifest, so a lost executor leaves at most a file
nobody reads.

Inputs out of the ordinary: null html is an empty payload; a row without
page_id is always a response and nobody refers to it; rows that repeat the
smallest page_id of a payload are all responses; a null url leaves the target
header out; an empty table gives no package and no record; extra columns are
ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_back, materialize, scratch_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
READ_BYTES = 4 << 20
ROLL_BYTES = 256 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# ZIP structures: signature and fixed part (public ZIP application note)
_EOCD = struct.Struct("<4s4H2LH")
_EOCD64_LOCATOR = struct.Struct("<4sLQL")
_EOCD64 = struct.Struct("<4sQ2H2L4Q")
_CENTRAL = struct.Struct("<4s6H3L5H2L")
_LOCAL = struct.Struct("<4s5H3L2H")
_BIG, _BIG16 = 0xFFFFFFFF, 0xFFFF


# ---------------------------------------------------------- ZIP directory ---
def zip_members(read, size: int) -> dict[str, tuple[int, int]]:
    """{name: (absolute data offset, length)} of the stored members.

    ``read(offset, n)`` returns bytes; ``size`` is the file's length.  A
    compressed member raises ValueError: its bytes can't be range-read.
    """
    tail_at = max(0, size - _EOCD.size - 0xFFFF)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, length, start, _ = _EOCD.unpack_from(tail, at)
    if _BIG in (length, start) or count == _BIG16:
        sig, _, at64, _ = _EOCD64_LOCATOR.unpack(read(tail_at + at - _EOCD64_LOCATOR.size, _EOCD64_LOCATOR.size))
        if sig != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        sig, _, _, _, _, _, _, count, length, start = _EOCD64.unpack(read(at64, _EOCD64.size))
        if sig != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
    raw, at, out = read(start, length), 0, {}
    for _ in range(count):
        (sig, _, _, flags, method, _, _, _, packed, full, n_name, n_extra, n_note, _, _, _,
         local) = _CENTRAL.unpack_from(raw, at)
        if sig != b"PK\x01\x02":
            raise ValueError("bad central directory")
        at += _CENTRAL.size
        name = raw[at:at + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[at + n_name:at + n_name + n_extra]
        at += n_name + n_extra + n_note
        full, packed, local = _zip64_values(extra, full, packed, local)
        if method != 0:
            raise ValueError(f"{name} is compressed, not stored")
        head = _LOCAL.unpack(read(local, _LOCAL.size))
        if head[0] != b"PK\x03\x04":
            raise ValueError("bad local header")
        out[name] = (local + _LOCAL.size + head[9] + head[10], packed)
    return out


def _zip64_values(extra: bytes, *values: int) -> list[int]:
    """Values that are all ones are taken, in order, from the ZIP64 extra field."""
    wide, at = b"", 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            wide = extra[at + 4:at + 4 + n]
        at += 4 + n
    out = []
    for v in values:
        if v == _BIG:
            v, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
        out.append(v)
    return out


# -------------------------------------------------------------- records ---
def payload_digest(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def warc_record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One response, or a revisit (HTTP head only) when ``refers_to`` is given."""
    def urn(x):
        return f"<urn:page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    heads = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", urn(page_id)),
             ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")]
    if url is not None:
        heads.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        heads += [("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    heads += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload (None for a revisit),
    payload_bytes, payload_digest; a payload that doesn't match its digest raises."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")

    def page(k):
        v = h.get(k, "")[len("<urn:page:"):-1]
        return int(v) if v else None
    revisit = h["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("payload doesn't match its digest")
    return {"page_id": page("WARC-Record-ID"), "url": h.get("WARC-Target-URI"), "record_type": h["WARC-Type"],
            "refers_to": page("WARC-Refers-To"), "payload": None if revisit else payload,
            "payload_bytes": size, "payload_digest": digest}


def _open_fs(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


# ------------------------------------------------------------- operators ---
def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, refers_to): pages whose payload a smaller page_id has too."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    ids = pages.filter("page_id is not null").select(
        "page_id", F.sha1(body).alias("sha"), F.octet_length(body).alias("size"))
    firsts = materialize(
        ids.filter(F.col("size") >= min_bytes).groupBy("sha", "size")
        .agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("top"), F.count("*").alias("n"))
        .filter("refers_to < top").drop("top"), "payload-firsts")
    return (join_back(ids, firsts, ["sha", "size"], "n", "page_id").filter("page_id > refers_to")
            .groupBy("page_id", "sha", "size").agg(F.min("refers_to").alias("refers_to")))


def write_packages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES,
                   date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a WARC record per (page_id, url, html) row; returns the manifest
    (path, bytes, records) as a written table."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.col("html").alias("html"))
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = (p.withColumn("sha", F.sha1(body)).withColumn("size", F.octet_length(body))
            .join(revisits(p, min_bytes), ["page_id", "sha", "size"], "left")
            .select("page_id", "url", "html", "refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        fs, root = _open_fs(folder)
        out, pack = [], None

        def close():
            nonlocal pack
            if pack:
                member, zf, raw, lines, path, _ = pack
                member.close()
                zf.writestr(zipfile.ZipInfo(INDEX), "".join(lines))
                zf.close()
                raw.close()
                out.append({"path": path, "bytes": fs.get_file_info(path).size, "records": len(lines)})
                pack = None

        for rb in batches:
            for r in rb.to_pylist():
                if pack is None:
                    fs.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}.zip"
                    raw = fs.open_output_stream(path)
                    zf = zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED, allowZip64=True)
                    pack = [zf.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), zf, raw, [], path, 0]
                data = gzip.compress(warc_record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8"),
                                                 r["refers_to"], date), compresslevel=3, mtime=0)
                pack[0].write(data)
                pack[3].append(json.dumps({"page": r["page_id"], "offset": pack[5], "length": len(data)}) + "\n")
                pack[5] += len(data)
                if pack[5] >= roll_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
            [("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    made = rows.mapInArrow(run, "path string, bytes long, records long")
    scheme = folder.split("://")[0] + "://" if "://" in folder else ("file://" if folder.startswith("file:") else "")
    return materialize(made.withColumn("path", F.concat(F.lit(scheme), "path")), "warc-manifest")


def record_ranges(manifest: DataFrame) -> DataFrame:
    """(path, start, length) of every record, from the packages' directories and indexes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for uri in rb.column(0).to_pylist():
                fs, path = _open_fs(uri)
                with fs.open_input_file(path) as f:
                    def read(at, n, f=f):
                        return f.read_at(n, at)
                    members = zip_members(read, f.size())
                    base, _ = members[DATA]
                    rows = [json.loads(x) for x in read(*members[INDEX]).splitlines()]
                yield pa.RecordBatch.from_pydict(
                    {"path": [uri] * len(rows), "start": [base + x["offset"] for x in rows],
                     "length": [x["length"] for x in rows]},
                    schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    paths = manifest.select("path")
    return paths.repartition(F.col("path")).mapInArrow(run, "path string, start long, length long")


def read_records(manifest: DataFrame, with_payload: bool = True, read_bytes: int = READ_BYTES) -> DataFrame:
    """The records of the packages: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest (and payload), each read by its range; a
    task reads about ``read_bytes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                 ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
        schema = pa.schema(kinds + [("payload", pa.binary())] * with_payload)
        f, opened = None, None
        for rb in batches:
            out = []
            for r in rb.to_pylist():
                if r["path"] != opened:
                    fs, path = _open_fs(r["path"])
                    f, opened = fs.open_input_file(path), r["path"]
                rec = parse_record(zlib.decompress(f.read_at(r["length"], r["start"]), 31))
                out.append({n: rec[n] for n in schema.names})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    ddl = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    ranges = record_ranges(manifest)
    # the ranges are small rows that stand for many bytes, so the number of tasks follows from the packages' sizes
    parts = manifest.agg(F.coalesce(F.ceil(F.sum("bytes") / read_bytes), F.lit(1))).first()[0]
    dealt = ranges.repartitionByRange(int(parts), F.col("path"), F.col("start")).sortWithinPartitions("path", "start")
    return dealt.mapInArrow(run, ddl + (", payload binary" if with_payload else ""))
