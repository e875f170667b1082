import gzip
import hashlib
import io
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from rows import clashing

from evalspark.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def by_hand(pages, least=100):
    first = {}
    for i, _, html in pages:
        data = (html or "").encode()
        if len(data) >= least and i is not None:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        refers = first.get(data) if first.get(data) != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def made():
    rng = random.Random(1)
    pages = [(i, f"http://h/{i}", rng.choice(["", "short", "é" * 50, "x" * 99, f"page {i} " + "y" * 200])) for i in range(60)]
    pages += [(100 + i, None, "copy " * 40) for i in range(30)] + [(5, "http://again/", "copy " * 40)] * 2
    pages += [(None, "u", "copy " * 40), (None, "u", "alone " * 40), (None, "u", "alone " * 40), (200, "a\r\nb: c", None), (201, "", "WARC/1.1\r\n\r\nx" * 30),
              (202, "x", "long " * 700_000)]
    return pages


def test_round_trip(spark):
    df = clashing(spark.createDataFrame(made(), SCHEMA).repartition(4))
    assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str) == by_hand(made())


def test_payloads_and_urls_come_back(spark):
    pages = [(1, "http://a/é ", "<p>é𝄞\r\n\r\n</p>" * 20), (2, "http://b/%20?x=1", None)]
    found = warc.read_records(warc.locate(warc.archive(spark.createDataFrame(pages, SCHEMA)))).collect()
    got = {r["page_id"]: (r["url"], bytes(r["payload"]).decode()) for r in found}
    assert got == {1: ("http://a/%C3%A9%20", pages[0][2]), 2: ("http://b/%20?x=1", "")}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def _package(n, comment=b""):
    out = io.BytesIO()
    rows = [{"page_id": i, "url": "u", "payload": b"p%d" % i, "size": len(b"p%d" % i), "digest": hashlib.sha256(b"p%d" % i).hexdigest(),
             "refers_to": None, "revisit": False} for i in range(n)]
    assert warc.write_package(out, iter(rows)) == n
    if comment:
        with zipfile.ZipFile(out, "a") as z:
            z.comment = comment
    return out.getvalue()


def _members(data):
    return warc.members(pa.BufferReader(data), len(data))


@pytest.mark.parametrize("comment", [b"", b"a comment", b"with PK\x05\x06 and " + b"x" * 60_000])
def test_members_are_found(comment):
    data = _package(5, comment)
    found = _members(data)
    with zipfile.ZipFile(io.BytesIO(_package(5))) as z:  # the library's own reader stumbles over a comment with a signature
        for name, (at, length) in found.items():
            assert data[at:at + length] == z.read(name)
    assert set(found) == {warc.MEMBER, warc.INDEX}


@pytest.mark.parametrize("limit", ["ZIP64_LIMIT", "ZIP_FILECOUNT_LIMIT"])
def test_zip64_directories(monkeypatch, limit):
    """With the limits of the writer lowered, sizes, offsets or counts move to the ZIP64 records."""
    monkeypatch.setattr(zipfile, limit, 1)
    data = _package(9)
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    monkeypatch.undo()
    at, length = _members(data)[warc.MEMBER]
    assert gzip.decompress(data[at:at + length]).count(b"WARC/1.1") == 9


def test_other_files_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.MEMBER, "x" * 100)
    with pytest.raises(ValueError, match="only stored"):
        _members(out.getvalue())
    with pytest.raises(ValueError, match="no end record"):
        _members(b"no archive")
    assert _members(b"PK\x05\x06" + bytes(18)) == {}


def test_wrong_payload_is_an_error():
    r = warc.record(1, "u", b"abc", 3, hashlib.sha256(b"abd").hexdigest(), None, False)
    with pytest.raises(ValueError, match="differ"):
        warc.parse(r)


def test_neighbours_are_read_together():
    spans = list(warc._spans([("a", 10, 5), ("a", 15, 7), ("a", 30, 1), ("b", 31, 2), ("b", 33, warc.READ)]))
    assert spans == [("a", 10, 12, [(0, 5), (5, 7)]), ("a", 30, 1, [(0, 1)]), ("b", 31, 2, [(0, 2)]), ("b", 33, warc.READ, [(0, warc.READ)])]


def test_only_listed_packages_are_read(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "z" * 300) for i in range(10)], SCHEMA).repartition(2)
    packages = warc.archive(df, folder=f"file:{tmp_path}/packages")
    (tmp_path / "packages" / "package-lost.zip").write_bytes(b"half of a pack")
    assert warc.read_records(warc.locate(packages)).filter(F.col("record_type") == "response").count() == 1
    assert packages.agg(F.sum("records")).first()[0] == 10
