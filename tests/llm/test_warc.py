import hashlib
import zipfile

import pytest

from riskloom.llm import warc


def brute(rows):
    pay = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in pay:
        if len(p) >= 100 and i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in pay:
        f = first.get(p)
        to = f if f is not None and i != f else None
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


ROWS = [(5, "http://a/\r\nX: y", "x" * 100), (3, None, "x" * 100), (3, None, "x" * 100), (9, "u", "x" * 99), (8, "u", "x" * 99), (1, "", None), (2, "é", ""),
        (None, "u", "x" * 100), (None, "u", "solo" * 50), (11, "u", "é" * 60), (10, "u", "é" * 60), (20, "u", "long\r\n\r\n" * 50_000),
        (21, "u", "long\r\n\r\n" * 50_000)] + [(100 + i, "u", f"page {i % 7} " * 20) for i in range(40)]


@pytest.mark.parametrize("archive,reach,limit", [(1 << 20, 1 << 20, 100), (300, 200, 0)])
def test_round_trip(spark, tmp_path, archive, reach, limit):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)
    manifest = warc.write_archives(pages, str(tmp_path / "new"), archive_bytes=archive, broadcast_rows=limit)
    assert manifest.agg({"records": "sum"}).first()[0] == len(ROWS)
    (tmp_path / "new" / "left-behind.wacz").write_bytes(b"PK")                 # of a task that was lost
    got = warc.read_archives(manifest, reach).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS)


def test_an_identifier_with_several_payloads(spark, tmp_path):
    """Rows of one identifier hold different payloads; revisits of each of them get the right figures."""
    a, b = "a" * 200, "b" * 300
    rows = [(3, "u", a), (3, "u", b), (5, "u", a), (6, "u", b), (3, "u", a), (4, "u", "c" * 150), (None, "u", b)]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "twice"))
    assert sorted((tuple(r) for r in warc.read_archives(manifest).collect()), key=str) == brute(rows)


def test_zip64_directory_and_ranges(tmp_path, monkeypatch):
    path = tmp_path / "far.zip"
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.comment = b"end"
        z.writestr("padding", b"0" * 500)
        z.writestr("indexes/index.cdxj", b"one\ntwo\nthree")
        z.writestr(zipfile.ZipInfo("packed"), b"x" * 100, compress_type=zipfile.ZIP_DEFLATED)
    package = warc.Package(str(path))
    assert path.read_bytes().count(b"PK\x06\x06") == 1
    assert list(package.lines("indexes/index.cdxj", 4)) == [b"one", b"two", b"three"]
    at, n = package.stored("padding")
    assert package.range(at, n) == b"0" * 500
    with pytest.raises(ValueError):
        package.stored("packed")


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, str(tmp_path))).count() == 0
