import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from turnloom.llm import warc


def expected(rows, least=0):
    first, out, done = {}, [], set()
    order = lambda p: (p is None, p or 0)
    for p, h in rows:
        b = (h or "").encode()
        if b not in first or order(p) < order(first[b]):
            first[b] = p
    for p, h in rows:
        b = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        if len(b) < least or p == first[b] and b not in done:
            done.add(b)
            out.append((p, len(b), digest, "response", None))
        else:
            out.append((p, len(b), digest, "revisit", first[b]))
    return sorted(map(str, out))


ROWS = [(1, "<html>a</html>"), (2, "<html>a</html>"), (2, "<html>a</html>"), (3, None), (4, ""), (None, "lost"), (None, "lost"), (5, "lost"),
        (6, "WARC/1.1\r\n\r\nfake\r\n\r\n"), (7, "x" * 1_000_000), (8, "x" * 1_000_000), (8, "ü" * 300_000), (9, "same"), (9, "same"), (None, None)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(p, f"http://h/{p}\r\nX: y", h, "1", "2") for p, h in ROWS], "page_id long, url string, html string, sha string, nth string")
    for least in (0, 10):
        manifest = warc.write_archives(warc.with_role(pages, F.col("html"), least))
        got = warc.read_archives(manifest).collect()
        assert sorted(str(tuple(r)) for r in got) == expected(ROWS, least)
    assert warc.read_archives(warc.write_archives(warc.with_role(pages.limit(0), F.col("html")))).count() == 0


def test_chunks_stay_small(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "ab" * 200_000)], "page_id long, url string, html string")
    rows = warc.chunk_table(warc.with_role(pages, F.col("html"))).collect()
    assert [r["chunk"] for r in rows] == [0, 1] and [r["last"] for r in rows] == [False, True]
    assert max(len(r["data"]) for r in rows) <= warc.CHUNK and b"".join(r["data"] for r in rows) == b"ab" * 200_000


def test_archive_is_standard_and_checked(tmp_path):
    a = warc.Archive(f"file://{tmp_path}/a.warc.gz")
    body = b"hello " * 100_000
    a.begin("5", "http://x", "response", "", hashlib.sha1(body).hexdigest(), 1, len(body))
    a.chunk(body[:100])
    a.chunk(body[100:])
    a.end()
    a.begin("6", "http://x", "revisit", "5", hashlib.sha1(body).hexdigest(), 1, len(body))
    a.end()
    a.out.close()
    plain = gzip.decompress((tmp_path / "a.warc.gz").read_bytes())
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and plain.count(b"WARC/1.1\r\n") == 2 and body + b"\r\n\r\nWARC/1.1" in plain
    (f, size, digest), (g, none, _) = warc.read_archive(f"file://{tmp_path}/a.warc.gz")
    assert size == len(body) and f["WARC-Payload-Digest"] == f"sha1:{digest}" and none == 0
    assert g["WARC-Refers-To"] == f["WARC-Record-ID"]
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(plain[:-30]))
    with pytest.raises(OSError):
        list(warc.read_archive(f"file://{tmp_path}/b.warc.gz"))
    b = warc.Archive(f"file://{tmp_path}/c.warc.gz")
    b.begin("5", "http://x", "response", "", hashlib.sha1(body).hexdigest(), 1, len(body))
    b.chunk(body[:-1])
    with pytest.raises(ValueError):
        b.end()
