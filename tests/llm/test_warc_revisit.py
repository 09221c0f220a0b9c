import base64
import hashlib

import gzip
import time
from pathlib import Path

from tessera.llm.warc_revisit import _record, export_archives, page_record, records, resolved_records, round_trip, write_archives

SCHEMA = "page_id long, url string, html string, digest int, id string"


def corpus():
    rows = [(i, f"http://x/{i} y", f"<p>{i % 17}é</p>" * (i % 5 + 1), 1, "x") for i in range(200)]
    rows += [(400, "u", "other payload", 1, "x"), (400, "v", "one more", 1, "x"), (401, None, "one more", 1, "x")]
    rows += [(500, "u", None, 1, "x"), (501, None, "", 1, "x"), (502, "u", "z" * 300_000, 1, "x"), (503, "u", "z" * 300_000, 1, "x"), (502, "u", "z" * 300_000, 1, "x")]
    return rows + [(504, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb", 1, "x")]


def brute(rows, least):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for i, d in sorted((i, digest(h)) for i, _, h, *_ in rows):
        first.setdefault(d, i)
    out = []
    for i, _, h, *_ in rows:
        n, d = len((h or "").encode()), digest(h)
        again = first[d] != i and n >= least
        out.append((i, n, d, "revisit" if again else "response", first[d] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = corpus()
    pages = spark.createDataFrame([*rows, (None, "u", "lost", 1, "x")], SCHEMA)
    for least, sent in ((0, 1000), (30, 1000), (0, 0), (30, 0)):
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in round_trip(pages, least_bytes=least, sent=sent).collect()), key=str)
        assert got == brute(rows, least)
    assert round_trip(pages.limit(0)).collect() == []


def test_records_are_readable(spark, tmp_path):
    pages = spark.createDataFrame(corpus(), SCHEMA)
    write_archives(pages, str(tmp_path / "w"))
    archives = spark.read.parquet(str(tmp_path / "w")).collect()
    found = [f for a in archives for f, _ in records(bytes(a.warc))]
    assert sum(a.records for a in archives) == len(corpus())
    assert sum(f["warc-type"] == "warcinfo" for f in found) == len(archives)
    one = page_record(3, "u", b"x", hashlib.sha1(b"x").digest(), None, "2024-01-01T00:00:00Z")
    assert [b for _, b in records(one)][0].endswith(b"\r\n\r\nx")


def test_names_and_urls(spark, tmp_path):
    pages = spark.createDataFrame(corpus(), SCHEMA)
    write_archives(pages, str(tmp_path / "w"))
    names = [r.archive for r in export_archives(spark, str(tmp_path / "w"), str(tmp_path / "files")).collect()]
    assert sorted(p.name for p in (tmp_path / "files").iterdir()) == sorted(names)
    found = [f for n in names for f, _ in records(Path(tmp_path / "files" / n).read_bytes()) if f["warc-type"] != "warcinfo"]
    plain = [f for n in names for f, _ in records(gzip.decompress(Path(tmp_path / "files" / n).read_bytes())) if f["warc-type"] != "warcinfo"]
    assert found == plain and len(found) == len(corpus())
    assert len({f["warc-record-id"] for f in found}) == len({(i, h or "") for i, _, h, *_ in corpus()})
    of = {f["warc-record-id"]: f["warc-target-uri"] for f in found if f["warc-type"] == "response"}
    assert all(f["warc-refers-to"] in of for f in found if f["warc-type"] == "revisit")
    assert any(f["warc-target-uri"] == "http://x/3%20y" for f in found)
    assert resolved_records(spark, str(tmp_path / "w")).where("payload_bytes is null").count() == 0


def test_reading_is_linear():
    one = _record("response", "urn:x", "2024-01-01T00:00:00Z", [], b"x" * 50)
    began = time.perf_counter()
    assert sum(1 for _ in records(one * 100_000)) == 100_000
    assert time.perf_counter() - began < 30
