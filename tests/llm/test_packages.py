"""ZIP packages against the standard library's writer, and archives by round trip."""

import base64
import hashlib
import io
import os
import random
import zipfile
from collections import Counter

import pytest

from listwatch.llm.packages import DATA, INDEX, Damaged, WarcPackages, directory, index_lines, parse_record


def reader(data):
    return lambda at, length: data[max(0, at): max(0, at) + length]


def archive(members, comment=b"", before=b"", **options):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data, method in members:
            z.writestr(zipfile.ZipInfo(name), data, method)
        z.comment = comment
    return before + out.getvalue()


MEMBERS = [("a.txt", b"alpha", 0), ("archive/déjà.warc", b"x" * 5000, 0), ("empty", b"", 0), ("packed", b"y" * 5000, 8)]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("before", [b"", b"something put before" * 9])
@pytest.mark.parametrize("comment", [b"", b"PK\5\6" + b"\0" * 40, b"c" * 65_535])
def test_members_are_where_the_directory_says(monkeypatch, wide, before, comment):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = archive(MEMBERS, comment, before)
    assert (b"PK\6\6" in data) == wide
    found = directory(reader(data), len(data))
    assert [(m.name, m.stored) for m in found] == [(n, k == 0) for n, _, k in MEMBERS]
    assert all(data[m.start: m.start + m.size] == d for m, (_, d, _) in zip(found, MEMBERS) if m.stored)


def test_offsets_beyond_four_gigabytes(tmp_path):
    path = str(tmp_path / "large.zip")
    with open(path, "wb") as f:
        f.truncate((1 << 32) + 12_345)
    with zipfile.ZipFile(path, "a", zipfile.ZIP_STORED) as z:
        z.writestr("late", b"behind a hole")
    with open(path, "rb") as f:
        read = lambda at, length: (f.seek(at), f.read(length))[1]
        member, = directory(read, os.path.getsize(path))
        assert member.start > 1 << 32 and read(member.start, member.size) == b"behind a hole"


def test_broken_packages_are_refused():
    good = archive(MEMBERS)
    for data in (b"", b"PK", good[:-30], good[:-1], good[100:60], b"PK\5\6" + b"\xff" * 18, good.replace(b"PK\1\2", b"PK\1\3")):
        with pytest.raises(Damaged):
            directory(reader(data), len(data))


def test_index_lines_must_lie_in_their_member():
    def package(line):
        data = archive([(DATA, b"r" * 100, 0), (INDEX, line, 0)])
        return list(index_lines(reader(data), directory(reader(data), len(data))))

    where = b'a 2000 {"filename": "data.warc.gz", "offset": %d, "length": %d}\n'
    assert [n for _, n in package(where % (0, 40) + b"\n" + where % (40, 60))] == [40, 60]
    for line in (where % (50, 51), where % (-1, 5), b"no json\n", b'{"filename": "other", "offset": 0, "length": 1}\n', b'x {"offset": 1}\n'):
        with pytest.raises(Damaged):
            package(line)


def b32(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, least=0):
    found = []
    taken = Counter()
    for i, html in rows:
        size = len((html or "").encode())
        same = [j for j, other in rows if (other or "") == (html or "")]
        named = [j for j in same if j is not None]
        first = min(named) if named else None
        taken[i, html or ""] += 1
        response = size < least or i == first and taken[i, html or ""] == 1
        found.append((i, size, b32(html), "response" if response else "revisit", None if response else first))
    return sorted(found, key=str)


ROWS = [(7, "same"), (3, "same"), (3, "same"), (9, None), (8, ""), (None, "same"), (None, "own"), (12, "é\r\n\r\nlines"), (11, "long " * 300_000),
        (13, "WARC/1.1\r\n\r\n\x00<x>"), (-5, "neg"), (20, "😀")]


@pytest.mark.parametrize("least, size", [(0, 64 << 20), (5, 300)])
def test_pages_come_back(spark, least, size):
    rng = random.Random(least)
    rows = ROWS + [(100 + i, rng.choice(["hot page", f"page {i % 40}"])) for i in range(200)]
    pages = spark.createDataFrame([(i, f"http://h.example/ü {i}\n" if i else None, h, "x", 0) for i, h in rows],
                                  "page_id long, url string, html string, type string, path int").repartition(5)
    packages = WarcPackages(revisit_bytes=least, package_bytes=size)
    manifest = packages.write(pages)
    assert sum(r["records"] for r in manifest.collect()) == len(rows) and (manifest.count() > 20) == (size < 1000)
    found = packages.read(packages.places(manifest)).collect()
    assert not any(r["problem"] for r in found)
    as_id = lambda v: None if v is None else int(v)
    mine = sorted(((as_id(r["name"]), r["payload_bytes"], r["payload_digest"], r["type"], as_id(r["refers_to"])) for r in found), key=str)
    assert mine == brute(rows, least)
    texts = {(i, (h or "").encode()) for i, h in rows}
    assert all((as_id(r["name"]), bytes(r["payload"])) in texts for r in found if r["type"] == "response")
    assert {r["uri"] for r in found if r["name"] == "12"} == {"http://h.example/%C3%BC%2012%0A"}
    for r in manifest.limit(3).collect():
        with zipfile.ZipFile(r["path"].removeprefix("file:")) as z:
            assert z.testzip() is None and z.namelist()[:2] == [DATA, INDEX]


def test_empty_table_and_selected_records(spark):
    packages = WarcPackages()
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert packages.read(packages.places(packages.write(empty))).count() == 0
    pages = spark.createDataFrame([(i, "u", f"text {i}") for i in range(50)], "page_id long, url string, html string")
    places = packages.places(packages.write(pages)).orderBy("path", "at").limit(7)
    found = packages.read(places).collect()
    assert len(found) == 7 and all(bytes(r["payload"]) == f"text {r['name']}".encode() for r in found)
    assert packages.read(places, payload=False).where("payload is null").count() == 7


def test_damaged_files_give_a_problem_each(spark, tmp_path):
    packages = WarcPackages()
    good = packages.write(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"))
    path = good.first()["path"].removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    at = data.index(DATA.encode()) + 300
    data[at: at + 60] = b"\0" * 60
    (tmp_path / "bytes.wacz").write_bytes(data)
    (tmp_path / "short.wacz").write_bytes(bytes(data[:-9]))
    paths = [(path,), (str(tmp_path / "bytes.wacz"),), (str(tmp_path / "short.wacz"),), (str(tmp_path / "absent.wacz"),)]
    places = packages.places(spark.createDataFrame(paths, "path string"))
    found = packages.read(places).collect()
    assert len(found) == 4 and sum(r["problem"] is None for r in found) == 1


def test_records_must_be_whole():
    import gzip
    for block in (b"", b"HTTP/1.1\r\n\r\n", b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort", b"WARC/1.1\r\n\r\nx"):
        with pytest.raises(Damaged):
            parse_record(gzip.compress(block))
    with pytest.raises(Damaged):
        parse_record(b"not compressed")
