import io
import zipfile
from base64 import b32encode
from hashlib import sha1

import pytest

from scriptorium.llm import warc_zip as W

PAGES = "page_id long, url string, html string, record_type string"


def brute(rows, least=0):
    out = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        same = [j for j, _, g, _ in rows if j is not None and (g or "").encode() == b]
        first = min(same) if same and i is not None and len(b) >= least else i
        out.append((i, len(b), b32encode(sha1(b).digest()).decode(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=str)


ROWS = [(3, "http://a/1", "<p>x</p>", "q"), (1, "http://a/2", "<p>x</p>", "q"), (2, None, "<p>y é 漢</p>", "q"), (9, "u", None, "q"),
        (8, "u\r\nWARC-Type: fake", "", "q"), (None, "n", "<p>x</p>", "q"), (7, "v", "a" * 400_000, "q"), (7, "v", "a" * 400_000, "q"),
        (11, "w", "WARC/1.1\r\n\r\nnot a record\r\n\r\n", "q"), (12, "w2", "a" * 400_000, "q")]


def records(df, **kw):
    got = W.read_records(W.write_packages(df, **kw)).collect()
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str), got


@pytest.mark.parametrize("roll", [W.ROLL_BYTES, 400])
def test_round_trip(spark, roll):
    df = spark.createDataFrame(ROWS, PAGES).repartition(3)
    got, full = records(df, roll_bytes=roll)
    assert got == brute(ROWS)
    texts = {r[0]: (r[2] or "").encode() for r in ROWS}
    assert all(bytes(r.payload) == texts[r.page_id] for r in full if r.record_type == "response")
    assert {r.url for r in full if r.page_id == 3} == {"http://a/1"} and [r.url for r in full if r.page_id == 2] == [None]


def test_ranges_are_read_in_tasks_by_their_bytes(spark):
    rows = [(i, f"u{i}", f"{i} " * 300, "q") for i in range(400)]
    manifest = W.write_packages(spark.createDataFrame(rows, PAGES).repartition(2))
    size = manifest.agg({"bytes": "sum"}).first()[0]
    read = W.read_records(manifest, read_bytes=size // 6)
    assert read.rdd.getNumPartitions() >= 6 and sorted(r.page_id for r in read.collect()) == list(range(400))


def test_least_size_and_empty_table(spark):
    assert records(spark.createDataFrame(ROWS, PAGES), min_bytes=9)[0] == brute(ROWS, 9)
    assert records(spark.createDataFrame([], PAGES))[0] == []


def build(zip64=False, comment=b"", method=zipfile.ZIP_STORED):
    out = io.BytesIO(b"junk before")
    out.seek(0, 2)
    with zipfile.ZipFile(out, "w", method) as z:
        z.comment = comment
        for i in range(5):
            with z.open(zipfile.ZipInfo(f"m/é{i}"), "w", force_zip64=zip64) as f:
                f.write(b"x" * i + bytes([i]))
    raw = out.getvalue()
    return raw, lambda at, n: raw[at:at + n]


@pytest.mark.parametrize("limit", [None, 20])
def test_directory(monkeypatch, limit):
    if limit:       # offsets over the limit make the writer use the ZIP64 structures
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    raw, read = build(comment=b"PK\x05\x06 in a comment? no"[4:])
    assert (b"PK\x06\x06" in raw) == bool(limit)
    got = W.zip_members(read, len(raw))
    assert {n: raw[a:a + k] for n, (a, k) in got.items()} == {f"m/é{i}": b"x" * i + bytes([i]) for i in range(5)}


def test_bad_packages():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"data" * 100)
    raw = out.getvalue()
    with pytest.raises(ValueError, match="not stored"):
        W.zip_members(lambda at, n: raw[at:at + n], len(raw))
    with pytest.raises(ValueError, match="no end"):
        W.zip_members(lambda at, n: b"none"[at:at + n], 4)
    rec = W.warc_record(1, "u", b"payload", None, "2020-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        W.parse_record(rec.replace(b"payload\r\n", b"pAyload\r\n"))
