import base64
import gzip
import hashlib
import io

import pytest

from edgeloom.llm import warc

SCHEMA = "page_id long, url string, html string, payload binary, sha1 int"
PAGES = [(1, "http://a/\r\nX: y", "same"), (5, "http://b/é x", "same"), (3, None, "same"), (7, "u", None), (9, "u", ""), (4, "http://c/", "WARC/1.1\r\n\r\n é"), (None, "n", "same"), (6, "b", "x" * 5_000_000), (6, "b", "x" * 5_000_000)]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("most_broadcast", [warc.MOST_BROADCAST, 0])
def test_round_trip(spark, monkeypatch, most_broadcast):
    monkeypatch.setattr(warc, "MOST_BROADCAST", most_broadcast)  # 0: the shuffled way
    got = warc.archive_pages(spark.createDataFrame([(*p, b"", 1) for p in PAGES], SCHEMA)).collect()
    first = {"same": 5, "": 9, "WARC/1.1\r\n\r\n é": 4, "x" * 5_000_000: 6}
    want = []
    for i, _, h in PAGES:
        to = first[h or ""]
        away = i is not None and i != to
        want.append((str(i), len((h or "").encode()), digest(h), "revisit" if away else "response", to if away else None))
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunks_and_archives(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(*p, b"", 1) for p in PAGES], SCHEMA)
    folder = f"file://{tmp_path}/warc"
    written = warc.chunked(warc.records_of_pages(rows)).coalesce(1)
    assert written.selectExpr("max(octet_length(data))").first()[0] == warc.CHUNK
    manifest = warc.write(written, folder)
    assert manifest.selectExpr("sum(n_records)").first()[0] == len(PAGES)
    every = warc.read(spark, manifest, folder)
    assert every.groupBy("record_id", "chunk_no").count().filter("count > 1").count() == 0
    assert every.select("record_id").distinct().count() == len(PAGES)
    chunks = every.filter("record_id like 'urn:page:6:%'").orderBy("record_id", "chunk_no").collect()
    assert len(chunks) == 2 * 5 and sum(c.is_last for c in chunks) == 2
    one = chunks[:5]
    assert b"".join(c.data for c in one) == b"x" * 5_000_000 and [c.offset for c in one] == [k * warc.CHUNK for k in range(5)]
    so_far = b""
    for c in one:
        so_far += c.data
        assert c.digest_so_far == base64.b32encode(hashlib.sha1(so_far).digest()).decode()
    [name] = [r.archive for r in manifest.collect()]
    text = gzip.open(tmp_path / "warc" / name).read()
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and b"\r\nX: y" not in text
    assert not list(tmp_path.glob("warc/*.open"))


def test_smaller_payloads_are_all_responses(spark):
    rows = spark.createDataFrame([(*p, b"", 1) for p in PAGES[:6]], SCHEMA)
    assert warc.records_of_pages(rows, least_bytes=5).filter("refers_to is not null").count() == 0


def archive(*records):
    """(id, kind, payload, declared digest, declared length, refers to) as plain WARC bytes."""
    out = io.BytesIO()
    for name, kind, payload, declared, size, to in records:
        record = warc._Record(out, name, kind, "u", declared, size, to, "2000-01-01T00:00:00Z")
        record.add(payload)
        record.running = type("", (), {"digest": lambda _, d=declared: base64.b32decode(d)})()
        record.left = 0
        record.close()
    return gzip.decompress(out.getvalue())


def test_damaged_archives_are_noticed():
    plain = archive(("urn:page:1:0", "response", b"abc", digest("abc"), 3, None))
    assert [r[4] for r in warc.chunks_of(io.BytesIO(plain), "a")] == [digest("abc")]
    with pytest.raises(EOFError):
        list(warc.chunks_of(io.BytesIO(plain[:-6]), "a"))
    with pytest.raises(ValueError, match="no record"):
        list(warc.chunks_of(io.BytesIO(b"no record\r\n"), "a"))


def test_chunks_must_be_the_declared_payload():
    record = warc._Record(io.BytesIO(), "r", "response", "u", digest("abc"), 3, None, "2000-01-01T00:00:00Z")
    record.add(b"abd")
    with pytest.raises(ValueError, match="declared"):
        record.close()


A, B = ("a", "response", b"abc", digest("abc"), 3, None), ("b", "revisit", b"", digest("abc"), 3, "a")


@pytest.mark.parametrize(
    ("records", "wrong"),
    [
        ([A, B], None),
        ([A, ("b", "revisit", b"", digest("abd"), 3, "a")], "a"),
        ([A, ("b", "revisit", b"", digest("abc"), 4, "a")], "a"),
        ([A, ("b", "revisit", b"", digest("abc"), 3, "z")], "z"),
        ([A, A], "a"),
        ([("a", "response", b"abc", digest("abd"), 3, None)], "a"),
    ],
)
def test_revisits_and_digests_are_verified(spark, records, wrong):
    last = [r[:3] + r[4:] for r in warc.chunks_of(io.BytesIO(archive(*records)), "x") if r[5]]
    schema = ", ".join(c for c in warc.CHUNKS.split(", ") if not c.startswith("data "))
    assert warc._wrong(spark.createDataFrame(last, schema)) == wrong
