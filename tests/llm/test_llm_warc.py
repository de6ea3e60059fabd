import gzip
import hashlib
import json

from pyarrow import fs

from urlguard.llm import warc
from urlguard.session import new_folder

PAGES = "page_id long, url string, html string, file string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).repartition(3)


def brute(rows):
    first = {}
    for page_id, _, html in rows:
        if len((html or "").encode()) >= 100 and page_id is not None:
            first[html] = min(page_id, first.get(html, page_id))
    found = []
    for page_id, url, html in rows:
        data = (html or "").encode()
        least = first.get(html) if len(data) >= 100 else None
        again = least is not None and (page_id is None or page_id > least)
        found.append((
            warc.page_name(page_id), url, "revisit" if again else "response", warc.page_name(least) if again else None,
            hashlib.sha256(data).hexdigest(), len(data), None if again else data,
        ))
    return sorted(found, key=str)


LONG = "<p>é</p>" * 40
ROWS = [
    (1, "http://a", "short"), (2, "http://b", "short"), (3, None, LONG), (4, "http://d", LONG), (5, "http://e\r\nX: y", LONG),
    (None, "http://f", LONG), (6, "http://g", None), (7, "http://h", ""), (8, "http://i", "\r\n\r\nWARC/1.1\r\n\r\n" * 30),
    (9, "http://j", "z" * 300_000), (3, "http://again", LONG), (10, "u" * 5000, "x" * 100), (11, "v", "x" * 100), (None, None, "q" * 200),
]


def test_round_trip(spark):
    folder = warc.normalise(spark, warc.write(pages(spark, ROWS)))
    found = sorted((tuple(r) for r in warc.read_records(spark, folder).collect()), key=str)
    expected = [(a, u and u.replace("\r", "%0D").replace("\n", "%0A"), *rest) for a, u, *rest in brute(ROWS)]
    assert [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in found] == sorted(expected, key=str)


def test_members_and_index(spark):
    source = warc.write(pages(spark, ROWS))
    folder = warc.normalise(spark, source)
    system, top = fs.FileSystem.from_uri(folder)
    whole, old = fs.FileSystem.from_uri(source)[1], spark.read.parquet(f"{source}/manifest").collect()
    plain = sorted(gzip.decompress(open(f"{whole}/{r.file}", "rb").read()) for r in old)
    files = spark.read.parquet(f"{folder}/manifest").collect()
    assert sorted(gzip.decompress(open(f"{top}/{r.file}", "rb").read()) for r in files) == plain
    for row in files:
        data = open(f"{top}/{row.file}", "rb").read()
        at = 0
        for line in open(f"{top}/{row.file}.index").read().split("\n"):
            entry = json.loads(line)
            assert entry["offset"] == at
            assert gzip.decompress(data[at : at + entry["length"]]).startswith(b"WARC/1.1\r\n")
            at += entry["length"]
        assert at == len(data)


def test_any_archive(spark):
    """Several members and several records in one, in a file that was not written here."""
    records = [warc.to_bytes(warc.page_record(k, "u", b"p" * k, hashlib.sha256(b"p" * k).hexdigest(), None)) for k in range(50)]
    folder = new_folder(spark, "foreign")
    system, top = fs.FileSystem.from_uri(folder)
    system.create_dir(top, recursive=True)
    with open(f"{top}/x.warc.gz", "wb") as file:
        file.write(gzip.compress(b"".join(records[:20])) + gzip.compress(b"".join(records[20:])))
    spark.createDataFrame([("x.warc.gz", 50)], warc.ARCHIVES).write.parquet(f"{folder}/manifest")
    found = warc.read_records(spark, warc.normalise(spark, folder)).select(warc.page_id("record_id").alias("k"), "payload_bytes").collect()
    assert sorted(map(tuple, found)) == [(k, k) for k in range(50)]


def test_rotation(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 400)
    folder = warc.write(pages(spark, [(k, "u", f"page {k}") for k in range(20)]).coalesce(1))
    assert spark.read.parquet(f"{folder}/manifest").count() > 5
    assert warc.read_records(spark, warc.normalise(spark, folder)).count() == 20


def test_empty_table(spark):
    folder = warc.normalise(spark, warc.write(pages(spark, [])))
    assert warc.read_records(spark, folder).count() == 0
