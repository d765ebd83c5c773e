"""WARC archives through a chunk table.

A payload travels as rows (record, chunk number, bytes) of at most ``CHUNK``
bytes, in order, never as a whole record: writer and reader carry the SHA-1 and
the length of the record at hand from chunk to chunk and from batch to batch,
and the archive holds and checks what they add up to.

Of the records with equal payloads of at least ``least`` bytes the one with the
smallest page_id is a ``response``, the others are ``revisit`` records without a
body that name it; smaller payloads are all responses.  Archives are gzip files
with one member per record, as the format recommends.

A record's file and order are not fixed; every attempt of a task writes files of
its own, and only those named in the manifest are read.

Cases: a null payload counts as empty; null ids come last when the smallest is
sought, and a revisit of a response without id refers to null.  Of repeated rows
with the smallest id one is the response.  An empty table gives no file and no
rows.  Other columns of the input are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.files import attempt_name, create, new_folder, open_read
from turnloom.session import cut

CHUNK = 1 << 18
FILE_BYTES = 1 << 28  # of payload, then the next file begins
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the format


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def with_role(pages: DataFrame, payload: Column, least: int = 0) -> DataFrame:
    """page_id, url, payload, size, sha, nth (among equal rows), record_type, refers_to of each row.

    Equality of payloads is that of SHA-1 and length.  The groups are made of
    small rows with partial minima; payloads are moved once, by page and digest,
    so that no group of copies meets in one task.
    """
    keys = ["known", "page", "sha", "size"]  # without nulls, so that the join and the numbering of equal rows share one exchange
    src = pages.select(
        F.col("page_id").isNotNull().alias("known"), F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("page"),
        F.col("url").cast("string").alias("url"), F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"sha": F.sha1("payload"), "size": F.length("payload").cast("long")})
    ids = src.select(*keys).distinct()
    first = ids.groupBy("sha", "size").agg(F.min(F.struct((~F.col("known")).alias("x"), "page")).alias("first"))
    role = cut(ids.join(first, ["sha", "size"]).select(
        *keys, F.when(~F.col("first.x"), F.col("first.page")).alias("first_id"),
        ((F.col("known") != F.col("first.x")) & (F.col("page") == F.col("first.page"))).alias("is_first")))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("url"))
    got = src.join(role, keys).withColumn("nth", nth).withColumn("page_id", F.when(F.col("known"), F.col("page")))
    response = (F.col("size") < least) | (F.col("is_first") & (F.col("nth") == 1))
    return got.select(
        "page_id", "url", "payload", "size", "sha", "nth", F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.when(~response, F.col("first_id")).alias("refers_to"))


def chunk_table(records: DataFrame) -> DataFrame:
    """One row per chunk, those of a record one after the other: page_id, url, record_type, refers_to, sha, chunk, last, data."""
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(CHUNK))).cast("int")
    rows = records.withColumn("chunk", F.explode(F.sequence(F.lit(0), count - 1)))
    data = F.substring(F.col("payload"), F.col("chunk") * CHUNK + 1, F.lit(CHUNK))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(
        name("page_id").alias("page_id"), name("url").alias("url"), "size", "record_type", name("refers_to").alias("refers_to"), "sha", "nth",
        "chunk", (F.col("chunk") == count - 1).alias("last"), F.when(F.col("record_type") == "response", data).alias("data"))


def _urn(page: str, sha: str, nth: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {sha} {nth}').urn}>"


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


class Archive:
    """Writes records chunk by chunk, each a gzip member of its own."""

    def __init__(self, uri: str):
        self.uri, self.out, self.records, self.bytes = uri, create(uri), 0, 0

    def begin(self, page: str, url: str, kind: str, refers: str, sha: str, nth: int, size: int) -> None:
        self.kind, self.want, self.size, self.sha, self.got = kind, sha, size, hashlib.sha1(), 0
        self.zip = zlib.compressobj(1, zlib.DEFLATED, 31)
        lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page, sha, nth)}", "WARC-Date: 1970-01-01T00:00:00Z",
                 f"WARC-Target-URI: {_line(url)}", "Content-Type: text/html; charset=utf-8",
                 f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(sha))}", f"X-Payload-Length: {size}", f"X-Page-ID: {page}",
                 f"Content-Length: {size if kind == 'response' else 0}"]
        if kind == "revisit":
            lines += [f"WARC-Refers-To: {_urn(refers, sha, 1)}", f"X-Refers-To-Page-ID: {refers}", f"WARC-Profile: {PROFILE}"]
        self._put("\r\n".join(lines).encode() + END)

    def _put(self, data: bytes) -> None:
        self.out.write(self.zip.compress(data))

    def chunk(self, data: bytes) -> None:
        self.sha.update(data)
        self.got += len(data)
        self.bytes += len(data)
        self._put(data)

    def end(self) -> None:
        if self.kind == "response" and (self.got != self.size or self.sha.hexdigest() != self.want):
            raise ValueError("the chunks do not add up to the record")
        self._put(END)
        self.out.write(self.zip.flush())
        self.records += 1


def write_archives(records: DataFrame) -> DataFrame:
    """Write every record; the manifest: part, uri, records."""
    folder = new_folder(records.sparkSession, "warc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, now, number = [], None, 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.chunk == 0:
                    if now is None or now.bytes >= FILE_BYTES:
                        if now is not None:
                            now.out.close()
                            done.append(now)
                        now, number = Archive(f"{folder}/{attempt_name()}-{number}.warc.gz"), number + 1
                    now.begin(r.page_id, r.url, r.record_type, r.refers_to, r.sha, r.nth, r.size)
                if r.data is not None:
                    now.chunk(r.data)
                if r.last:
                    now.end()
        if now is not None:
            now.out.close()
            done.append(now)
        part = TaskContext.get().partitionId()
        yield pd.DataFrame({"part": [part] * len(done), "uri": [d.uri for d in done], "records": [d.records for d in done]})

    return cut(chunk_table(records).mapInPandas(run, "part int, uri string, records long"))


def _inflated(uri: str) -> Iterator[bytes]:
    """The plain bytes of a file of gzip members, at most ``CHUNK`` at a time."""
    with open_read(uri) as src:
        unzip, data = zlib.decompressobj(31), b""
        while data or (data := bytes(src.read(CHUNK))):
            yield unzip.decompress(data, CHUNK)
            data = unzip.unconsumed_tail
            if unzip.eof:
                data, unzip = unzip.unused_data, zlib.decompressobj(31)


def read_archive(uri: str) -> Iterator[tuple[dict[str, str], int, str]]:
    """Header, body length and body SHA-1 (base32) of each record, holding no more than a chunk of the body."""
    plain, have = _inflated(uri), b""
    while True:
        while END not in have:
            more = next(plain, None)
            if more is None:
                if have:
                    raise OSError("the archive ends inside a record")
                return
            have += more
        head, have = have.split(END, 1)
        lines = head.decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise OSError("not a record")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        left = size = int(fields["Content-Length"])
        sha = hashlib.sha1()
        while left:
            sha.update(have[:left])
            left, have = left - len(have[:left]), have[left:]
            if left:
                have = next(plain)
        while len(have) < len(END):
            have += next(plain)
        if not have.startswith(END):
            raise OSError("a record has the wrong length")
        have = have[len(END) :]
        yield fields, size, base32(sha.digest())


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; digests and lengths are checked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda x: int(x) if x else None
        for pdf in batches:
            for uri in pdf["uri"]:
                rows = []
                for f, size, digest in read_archive(uri):
                    kind, want, length = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"])
                    if kind == "response" and (digest, size) != (want, length):
                        raise OSError("a payload does not match its digest")
                    rows.append((number(f["X-Page-ID"]), length, want, kind, number(f.get("X-Refers-To-Page-ID"))))
                    if len(rows) == 5000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    n = max(1, manifest.count())
    return manifest.repartitionByRange(n, "part", "uri").select("uri").mapInPandas(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})
