import gzip
import hashlib
import io

import pytest

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, path int"


def pages():
    big = "é<p>" + "x" * 1500
    rows = [(i, f"http://h/{i}", f"page {i} " + "y" * (i * 37)) for i in range(60)]
    rows += [(100, "u", big), (101, None, big), (140, "u", big), (102, "a b\r\nX: y ", big), (None, "n", big), (104, "u", "z" * 1000), (105, "u", "z" * 1000), (106, "u", "z" * 999), (107, "u", "z" * 999)]
    rows += [(108, "u", None), (109, "u", ""), (110, "u", "\r\n\r\nWARC/1.1\r\n\r\n" + "q" * 3_000_000), (None, "u", "n" * 2000), (None, "u", "n" * 2000), (140, "u", big)]
    return rows


def brute(rows):
    best, out = {}, []
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            best.setdefault(b, []).append(p)
    for p, _, h in rows:
        b = (h or "").encode()
        ids = [x for x in best.get(b, []) if x is not None]
        to = max(ids) if ids and max(ids) != p else None
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def test_archive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    df = spark.createDataFrame([(*r, "x", 1) for r in pages()], SCHEMA).repartition(3)
    whole = warc.write_monolithic(df, str(tmp_path / "whole"))
    for (path,) in whole.collect():  # one member over all records
        inflate = __import__("zlib").decompressobj(31)
        with open(path, "rb") as f:
            inflate.decompress(f.read())
        assert inflate.eof and not inflate.unused_data
    files = warc.normalise(whole, str(tmp_path / "records"))
    assert files.count() == whole.count() > 3
    assert sorted((tuple(r) for r in warc.read_records(files).collect()), key=str) == brute(pages())
    # Files that already have a member per record are normalised to the same records.
    again = warc.normalise(files.select("path"), str(tmp_path / "again"))
    assert sorted((tuple(r) for r in warc.read_records(again).collect()), key=str) == brute(pages())


def test_query_form(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in pages()], SCHEMA)
    assert sorted((tuple(r) for r in warc.archive(df).collect()), key=str) == brute(pages())
    assert warc.archive(df.limit(0)).count() == 0


def test_cut_off_streams_are_errors():
    data = gzip.compress(warc.record(1, "u", b"abc", None))
    for broken in (data[:-12], gzip.compress(warc.record(1, "u", b"abc", None)[:-3])):
        with pytest.raises(warc.FormatError):
            s = warc._Inflated(io.BytesIO(broken))
            head = s.until(b"\r\n\r\n")
            list(s.blocks(int(warc._fields(head)["content-length"]) + 4))
            s.until(b"\r\n\r\n")


def test_streams_of_several_members():
    records = [warc.record(i, "u", b"x" * (i * 700_000), None) for i in range(4)]
    s = warc._Inflated(io.BytesIO(b"".join(map(gzip.compress, records))))
    n = 0
    while head := s.until(b"\r\n\r\n"):
        body = b"".join(s.blocks(int(warc._fields(head)["content-length"]) + 4))
        assert head + body == records[n]
        n += 1
    assert n == 4
