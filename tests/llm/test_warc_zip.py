import gzip
import hashlib
import io
import zipfile
from tempfile import mkdtemp

import pytest

from chaffline.llm import warc_zip
from chaffline.llm.store import read_bytes, write_bytes

PAGES = [
    (1, "http://a", "x" * 1500), (2, "http://b", "x" * 1500), (3, None, "x" * 1500), (4, "http://c", "y" * 999),
    (5, "http://c", "y" * 999), (6, "u\r\nEvil: 1", None), (7, "http://d", ""), (8, "http://ü", "é" * 500),
    (9, "http://ü", "é" * 500), (10, "http://e", "\r\n\r\nWARC/1.1\r\n" * 300), (11, "http://f", "z" * 5_000_000),
    (11, "http://f", "z" * 5_000_000), (None, "http://g", "x" * 1500), (None, None, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*p, "in the way", "x") for p in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, response string").repartition(3)


def expected():
    best = {}
    for i, _, html in PAGES:
        if i is not None and len((html or "").encode()) >= 1000:
            best[html] = max(best.get(html, i), i)
    out = []
    for i, url, html in PAGES:
        data = (html or "").encode()
        keep = best.get(html)
        revisit = i is not None and keep is not None and i < keep
        out.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", str(keep) if revisit else None))
    return sorted(out, key=str)


def found(frame):
    def name(urn):
        if urn is None:
            return None
        return "None" if urn.startswith("<urn:uuid:") else urn.removeprefix("<urn:page:").removesuffix(">")

    rows = warc_zip.read_packages(frame).collect()
    without = [r.record_id for r in rows if "uuid" in r.record_id]
    assert len(set(without)) == len(without)  # a page without an id has a record id of its own
    for r in rows:
        assert (r.payload is None) == (r.record_type == "revisit")
    return sorted(
        ((name(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, name(r.refers_to)) for r in rows), key=str
    )


def test_round_trip(pages):
    assert found(warc_zip.write_packages(pages)) == expected()


def test_other_readers_open_the_packages(pages):
    paths = [r.path for r in warc_zip.write_packages(pages).collect()]
    count = 0
    for path in paths:
        with zipfile.ZipFile(io.BytesIO(read_bytes(path))) as package:
            assert package.testzip() is None
            assert all(m.compress_type == zipfile.ZIP_STORED for m in package.infolist())
            plain = gzip.decompress(package.read("archive/data.warc.gz"))
            count += package.read("indexes/index.cdxj").count(b"\n")
            assert plain.startswith(b"WARC/1.1\r\n")
    assert count == len(PAGES)


@pytest.mark.parametrize("zip64", [True, False])
@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("indexed", [True, False])
def test_packages_of_others(spark, zip64, packed, indexed):
    """Written by Python's zipfile or here, gzip or plain records, with an index or without one."""
    bodies = [b"first", b"", b"third \r\n\r\n" * 10, b"q" * 3_000_000]
    data, lines = b"", ""
    for i, body in enumerate(bodies):
        record = warc_zip.warc_record({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:page:{i}>"}, body)
        record = gzip.compress(record) if packed else record
        lines += f"k{i} 2024 " + '{"offset": "%d", "length": "%d", "filename": "d.warc"}\n' % (len(data), len(record))
        data += record
    members = [("archive/d.warc", data), ("pages/p.jsonl", b"{}")] + [("indexes/index.cdxj", lines.encode())] * indexed
    if zip64:
        whole = warc_zip.zip_stored(members, zip64=True)
    else:
        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as package:
            for name, content in members:
                package.writestr(name, content)
            package.comment = b"a comment PK"
        whole = sink.getvalue()
    path = f"{mkdtemp()}/x.wacz"
    write_bytes(path, whole)
    frame = spark.createDataFrame([(path,)], "path string")
    rows = sorted(warc_zip.read_packages(frame).collect(), key=lambda r: r.record_id)
    assert [bytes(r.payload) for r in rows] == bodies
    assert [r.payload_digest for r in rows] == [hashlib.sha1(b).hexdigest() for b in bodies]


def test_broken_packages_are_errors():
    whole = warc_zip.zip_stored([("archive/a.warc", b"abc")])
    read = lambda at, n: whole[at : at + n]
    assert warc_zip.stored_members(read, len(whole))[0].size == 3
    with pytest.raises(ValueError, match="not a ZIP"):
        warc_zip.stored_members(lambda at, n: b"\0" * n, 500)
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("archive/a.warc", b"abc" * 100)
    packed = sink.getvalue()
    with pytest.raises(ValueError, match="compressed"):
        warc_zip.stored_members(lambda at, n: packed[at : at + n], len(packed))
    with pytest.raises(ValueError, match="cut short"):
        warc_zip.parse_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")


def test_empty_table(pages):
    packages = warc_zip.write_packages(pages.limit(0))
    assert packages.collect() == [] and found(packages) == []


def test_query_on_odd_pages(spark, pages, tmp_path):
    from chaffline.llm import queries

    pages.select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.warc_in_zip(spark, str(tmp_path)).collect()
    text = lambda i: None if i is None else str(i)
    plain = [(i if i != "None" else None, *rest) for i, *rest in expected()]
    assert sorted(((text(r[0]), *r[1:4], text(r[4])) for r in rows), key=str) == sorted(plain, key=str)
