"""Packages of web archives: an exact round trip, the library's own ZIP files, damaged ones, and the query against its SQL."""

import base64
import gzip
import hashlib
import io
import json
import random
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from signalfold.llm import warc
from signalfold.llm.store import materialize

SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    """Sorted results; rows: (page_id, url, html)."""
    first = {}
    for i, (page, _, html) in enumerate(rows):
        text = html or ""
        if len(text.encode()) >= least:
            first[text] = min(first.get(text, (True, 1 << 62, 1 << 62)), (page is None, page or 0, i))
    out = []
    for i, (page, _, html) in enumerate(rows):
        text = html or ""
        best = first.get(text)
        again = best is not None and best[2] != i
        out.append((page, len(text.encode()), digest(text), "revisit" if again else "response", (None if best[0] else best[1]) if again else None))
    return sorted(out, key=repr)


def pages():
    rng = random.Random(4)
    texts = [None, "", "a", "ünï 日本", "x" * 300_000, "<html>\r\n\r\nWARC/1.1\r\n\r\n</html>", *("page " * rng.randint(1, 50) + str(i % 9) for i in range(60))]
    rows = [(i, f"http://www.ex{i % 3}.org/a b/{i}?q=é" if i % 5 else None, t) for i, t in enumerate(texts)]
    return [*rows, *rows[3:9], (None, "u", "a"), (None, "u", "alone"), (None, None, "alone"), (500, "u\nv", "a")]


def test_round_trip(spark, tmp_path):
    rows = pages()
    frame = spark.createDataFrame(rows, SCHEMA)
    for k, f in enumerate((frame.repartition(5), materialize(frame.coalesce(1).withColumns({"key": F.lit(1), "file": F.lit("x"), "name": F.lit(2), "payload": F.lit(3)}), "odd"))):
        got = warc.archived(f, f"file://{tmp_path}/{k}", package_bytes=2000)
        assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)
    assert sorted(map(tuple, warc.archived(frame, min_bytes=9).collect()), key=repr) == expected(rows, 9)


def test_packages_are_plain_zip_files_and_payloads_come_back(spark, tmp_path):
    rows = pages()
    packages = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(2), f"file://{tmp_path}/out", package_bytes=5000)
    held = packages.collect()
    assert len(held) > 2 and sum(r.records for r in held) == len(rows)
    for r in held:
        z = zipfile.ZipFile(r.path.removeprefix("file://"))
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {0}
        for part in json.loads(z.read("datapackage.json"))["resources"]:
            data = z.read(part["path"])
            assert (len(data), f"sha256:{hashlib.sha256(data).hexdigest()}") == (part["bytes"], part["hash"])
        assert len(z.read(warc.INDEX).splitlines()) == r.records and gzip.decompress(z.read(warc.ARCHIVE)).count(b"WARC/1.1\r\nWARC-Type") == r.records
    records = warc.read_archives(spark, packages, with_payload=True).collect()
    texts = sorted(bytes(r.payload).decode() for r in records if r.type == "response")
    assert texts == sorted({t or "" for _, _, t in rows})
    assert {r.name for r in records if r.type == "response"} >= {r.refers for r in records if r.type == "revisit"} and len({r.name for r in records}) == len(rows)


def test_empty_table_and_pages_of_other_types(spark):
    empty = warc.archived(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and dict(empty.dtypes)["refers_to"] == "bigint"
    named = spark.createDataFrame([("a/b: c", "u", "x"), ("ü::null:%", "u", "x"), ("", "u", "y")], "page_id string, url string, html string")
    assert sorted(map(tuple, warc.archived(named).select("page_id", "record_type", "refers_to").collect())) == [("", "response", None), ("a/b: c", "response", None), ("ü::null:%", "revisit", "a/b: c")]


def _package(records, index=True, packed=True, index_name="indexes/index.cdx.gz", compress=zipfile.ZIP_STORED, comment=b"", before=b"", archive="archive/x.warc"):
    """A package made by zipfile, with as many of its odd features as asked for."""
    data, lines = b"", []
    for r in records:
        piece = gzip.compress(r) if packed else r
        lines.append(b'org,x)/ 2020 ' + json.dumps({"offset": len(data), "length": len(piece), "filename": "x.warc" + ".gz" * packed}).encode() + b"\n")
        data += piece
    out = io.BytesIO(before)
    out.seek(0, 2)
    with zipfile.ZipFile(out, "a" if before else "w", compress) as z:
        z.comment = comment
        z.writestr("pages/pages.jsonl", "{}")
        z.writestr(archive + ".gz" * packed, data)
        if index:
            half = len(lines) // 2
            text = gzip.compress(b"".join(lines[:half])) + gzip.compress(b"".join(lines[half:])) if index_name.endswith(".gz") else b"".join(lines)
            z.writestr(index_name, text)
    return out.getvalue()


RECORDS = [warc.record(f"urn:page:{i}::x", "http://x.org/", t.encode(), "2020-01-01T00:00:00Z", digest(t)) for i, t in enumerate(["", "a", "b" * 90_000, "\r\n\r\n", "日"])]


@pytest.mark.parametrize("odd", [{}, {"index": False}, {"packed": False}, {"index": False, "packed": False}, {"index_name": "indexes/i.cdxj"}, {"comment": b"PK\5\6 not the end"}, {"before": b"#!/bin/sh\n"}])
def test_reads_packages_of_others(spark, tmp_path, odd):
    path = tmp_path / "a.wacz"
    path.write_bytes(_package(RECORDS, **odd))
    got = warc.read_archives(spark, spark.createDataFrame([(f"file://{path}",)], "path string"), with_payload=True).collect()
    assert sorted(bytes(r.payload).decode() for r in got) == sorted(["", "a", "b" * 90_000, "\r\n\r\n", "日"])


def test_reads_zip64_directories(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = _package(RECORDS)
    assert b"PK\6\6" in data and b"PK\6\7" in data
    package = warc.Package(io.BytesIO(data), len(data))
    assert [m.name for m in package.archives()] == ["archive/x.warc.gz"] and len(package.members) == 3
    # The directory's own numbers say that they did not fit.
    end = data.rindex(b"PK\5\6")
    data = data[:end + 8] + b"\xff" * 12 + data[end + 20:]
    at = data.rindex(b"PK\1\2", 0, data.rindex(b"archive/x.warc.gz"))
    package = warc.Package(io.BytesIO(data), len(data))
    member = package.archives()[0]
    assert warc.walked(package, member).tolist() == warc.indexed(package)["x.warc.gz"].tolist() and at > 0
    path = tmp_path / "a.wacz"
    path.write_bytes(data)
    assert warc.read_archives(spark, spark.createDataFrame([(str(path),)], "path string")).count() == len(RECORDS)


def test_damaged_packages_are_errors(spark, tmp_path):
    good = _package(RECORDS, packed=False)
    wrong = good.replace(b"b" * 90_000, b"b" * 89_999 + b"c")
    deflated = _package(RECORDS, compress=zipfile.ZIP_DEFLATED)
    for data, why in ((b"", "ZIP"), (b"nothing", "ZIP"), (good[:-30], "ZIP"), (wrong, "digest"), (deflated, "stored")):
        path = tmp_path / f"{len(data)}-{why}.wacz"
        path.write_bytes(data)
        with pytest.raises(PySparkException, match=why):
            warc.read_archives(spark, spark.createDataFrame([(str(path),)], "path string")).collect()
