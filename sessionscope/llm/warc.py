"""WARC archives: one member per record, and a sidecar offset index.

``write_whole`` writes records into ``whole/part-*.warc.gz``, each file one gzip stream, as
crawlers sometimes leave them: no record can be reached without inflating all before
it.  ``normalise`` inflates each such file once, front to back, a block at a time, and
rewrites every record as a gzip member of its own into ``warc/part-*.warc.gz``, with a row
for each in the Parquet table ``index``: file, place and length of the member, record
id and type.  ``read_records`` then reads records by ranged reads.

Payloads are the html in UTF-8 (null: empty).  Among records with equal payloads of at
least ``min_bytes`` the one with the largest page_id is a response and the others are
revisits of it, without payload; repeated rows with that page_id are all responses.  A null
page_id counts as smallest.  Line ends inside a URL are percent-encoded; a null URL has
no header.  An empty table makes no archive.  Other columns are not read.  Files of
failed or speculative tasks are named by no table and are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.llm.common import Scratch
from sessionscope.llm.files import located, open_input, open_output, open_stream

BLOCK = 1 << 20
GZIP = 31  # window bits of zlib that stand for the gzip format
# Fixed value: the profile that the format's standard names for equal payloads.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, member_at long, member_bytes long, record_id string, record_type string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(identifier: str | None) -> int | None:
    number = identifier.removeprefix("<urn:page:").removesuffix(">") if identifier else ""
    return int(number) if number else None


def record_bytes(page_id, url, html, head) -> bytes:
    """One record; ``head`` is the page it revisits, or None."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if head is not None else payload)
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'response' if head is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        headers.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if head is not None:
        headers += [f"WARC-Refers-To: {record_id(head)}", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join([*headers, "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def with_heads(pages: DataFrame, min_bytes: int, scratch: Scratch) -> DataFrame:
    """page_id, url, html and ``head``: the page a record revisits.

    Copies are counted before the join; only payloads that occur twice are joined.
    """
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    chosen = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html")
    )
    keyed = chosen.withColumn("key", F.sha1(F.col("html").cast("binary")))
    heads = (
        keyed.where(F.octet_length("html") >= min_bytes)
        .groupBy("key")
        .agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
        .where("n > 1")
        .select("key", "head")
    )
    joined = keyed.join(scratch.write(heads, "heads"), "key", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("head"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("head")).alias("head"))


def write_whole(records: DataFrame, folder: str) -> DataFrame:
    """Writes every partition as one gzip stream; returns the written table of file names."""

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, out, squeeze = f"part-{uuid.uuid4().hex}.warc.gz", None, None
        for batch in batches:
            if out is None and len(batch):
                out = open_output(f"{folder}/whole/{name}")
                squeeze = zlib.compressobj(1, zlib.DEFLATED, GZIP)
            pages, heads = batch["page_id"].array, batch["head"].array
            for page, url, html, head in zip(pages, batch["url"], batch["html"], heads):
                page, head = (None if pd.isna(x) else int(x) for x in (page, head))
                out.write(squeeze.compress(record_bytes(page, url, html, head)))
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            yield pd.DataFrame({"file": [name]})

    # Ids travel as text: a missing one would turn the others into floating-point numbers.
    safe = records.select(F.col("page_id").cast("string"), "url", "html", F.col("head").cast("string"))
    safe.mapInPandas(store, "file string").write.parquet(f"{folder}/files")
    return records.sparkSession.read.schema("file string").parquet(f"{folder}/files")


class _Inflated:
    """Lines and blocks of a gzip file that is read once, front to back."""

    def __init__(self, source):
        self.source, self.inflater = source, zlib.decompressobj(GZIP)
        self.held, self.at = b"", 0

    def _more(self) -> bool:
        data = self.inflater.unconsumed_tail
        if self.inflater.eof:  # a further member may follow
            data, self.inflater = self.inflater.unused_data, zlib.decompressobj(GZIP)
        data = data or self.source.read(BLOCK)
        if not data:
            return False
        self.held, self.at = self.held[self.at :] + self.inflater.decompress(data, BLOCK), 0
        return True

    def line(self) -> bytes:
        while (end := self.held.find(b"\n", self.at) + 1) == 0:
            if not self._more():
                end = len(self.held)
                break
        line, self.at = self.held[self.at : end], end
        return line

    def blocks(self, size: int) -> Iterator[bytes]:
        while size:
            if self.at == len(self.held) and not self._more():
                raise EOFError("the archive ends inside a record")
            part = self.held[self.at : self.at + size]
            self.at += len(part)
            size -= len(part)
            yield part


def parse_headers(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines[1:]:
        name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def split_records(source, member) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Copies each record of one gzip stream to ``member`` as a member of its own.

    Yields place, length and headers of each; holds a block at a time.
    """
    stream, at = _Inflated(source), 0
    while True:
        first = stream.line()
        if not first:
            return
        if not first.strip():
            continue
        head = [first]
        while (line := stream.line()).strip():
            head.append(line)
        headers = parse_headers(head)
        squeeze, size = zlib.compressobj(6, zlib.DEFLATED, GZIP), 0
        parts = (b"".join(head) + b"\r\n",), stream.blocks(int(headers["content-length"])), (b"\r\n\r\n",)
        for blocks in parts:
            for block in blocks:
                size += member.write(squeeze.compress(block))
        size += member.write(squeeze.flush())
        yield at, size, headers
        at += size


def normalise(files: DataFrame, folder: str) -> None:
    """Rewrites all named whole-stream files and writes the index.  A file is one task's work."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for whole in batch["file"]:
                name, rows = f"part-{uuid.uuid4().hex}.warc.gz", []
                with open_stream(f"{folder}/whole/{whole}") as source, open_output(f"{folder}/warc/{name}") as out:
                    for at, size, headers in split_records(source, out):
                        rows.append((name, at, size, headers["warc-record-id"], headers["warc-type"]))
                        if len(rows) == 10_000:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    # A row is a whole archive, so rows are dealt out one by one.
    n = max(1, files.count())
    dealt = files.repartitionByRange(n, "file")
    dealt.mapInPandas(rewrite, INDEX).write.parquet(f"{folder}/index")


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[field.split()[0] for field in INDEX.split(", ")])


def parse_record(data: bytes) -> tuple:
    """A row of ``RECORD`` from one inflated record; raises if payload and digest differ."""
    source = io.BytesIO(data)
    lines = []
    while (line := source.readline()).strip():
        lines.append(line)
    headers = parse_headers(lines)
    block = source.read(int(headers["content-length"]))
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    size = int(parse_headers(http.split(b"\r\n"))["content-length"])
    if headers["warc-type"] == "response" and (payload_digest(payload) != digest or len(payload) != size):
        raise ValueError(f"{headers['warc-record-id']}: payload and digest differ")
    page, head = page_of(headers["warc-record-id"]), page_of(headers.get("warc-refers-to"))
    return page, size, digest, headers["warc-type"], head, headers.get("warc-target-uri")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record by its index row: see ``RECORD``.

    A response's digest is taken anew from its payload; a revisit states its own.
    """
    folder = located(spark, folder)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in RECORD.split(", ")]
        for batch in batches:
            rows = []
            for name, members in batch.groupby("file"):
                with open_input(f"{folder}/warc/{name}") as source:
                    for at, size in zip(members["member_at"], members["member_bytes"]):
                        source.seek(int(at))
                        rows.append(parse_record(zlib.decompress(source.read(int(size)), GZIP)))
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"}).replace({np.nan: None})

    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    return index.mapInPandas(load, RECORD)


def archive_pages(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Whole-stream archives of all pages, then the normalised ones with their index."""
    folder = located(pages.sparkSession, folder)
    scratch = Scratch(pages.sparkSession, "warc")
    normalise(write_whole(with_heads(pages, min_bytes, scratch), folder), folder)
