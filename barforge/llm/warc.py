"""WARC archives: a writer that uses Spark's own committed files, and a reader that salvages damaged archives.

Writing: every row becomes one record (response, or revisit of the response with an equal payload), and Spark's text
writer puts the records of a partition into a file, so a lost executor leaves no half-written archive behind. Files
are kept small by a bound on their number of records that follows the largest payload of their size class.

Reading: a record is accepted when its version line, its header, its length, its end and its digests hold. Where a
check fails, the reader searches for the next gzip member or version line from which a record is valid again, goes on
there, and reports the bytes between as a quarantined gap. Plain and gzipped members are read, mixed as well.

Defined results: a null payload is an empty one; a null url is left out; control characters in urls are percent-encoded;
of rows that share the smallest page_id of a payload each is a response; a null page_id is never referred to; an empty
table gives an archive without records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, maybe_broadcast, shared_dir

#: Payloads with fewer bytes are never revisits.
LEAST_BYTES = 100
#: Bytes that a file of the writer has at most, unless one record alone is larger.
FILE_BYTES = 32 << 20
#: Sizes above which a payload belongs to the next class.
SMALL_BYTES = 64 << 10
CLASSES = [SMALL_BYTES << 2 * k for k in range(8)]
END = b"\r\n\r\n"


def revisits(pages: DataFrame) -> DataFrame:
    """``pages`` with _digest, _bytes and _refers_to (null for a response)."""
    body = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.withColumns({"_digest": F.sha2(body, 256), "_bytes": F.octet_length(body).cast("long")})
    first = sized.where(F.col("_bytes") >= LEAST_BYTES).groupBy(F.col("_digest").alias("_same")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    first = maybe_broadcast(materialize(first.where(F.col("_n") > 1).select("_same", "_first"), "payloads"), 100_000)
    out = sized.join(first, (F.col("_digest") == F.col("_same")) & (F.col("_bytes") >= LEAST_BYTES), "left")
    other = ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.withColumn("_refers_to", F.when(other, F.col("_first"))).drop("_same", "_first")


def _uri(url: Column) -> Column:
    for code in [*range(0x21), 0x7F]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), url).otherwise(F.col("url"))


def records(built: DataFrame, date: str) -> DataFrame:
    """One column: the WARC record of each row of revisits(), without the blank lines that end it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    ref = F.col("_refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("_bytes")), F.lit("\r\n"))
    block = F.when(ref, http).otherwise(F.concat(http, F.coalesce(F.col("html"), F.lit(""))))
    built = built.withColumn("_block", block)
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(ref, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", _uri(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(F.col("_block"), 256))),
        F.when(ref, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.when(ref, line("WARC-Refers-To", urn(F.col("_refers_to")))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length("_block")),
        F.lit("\r\n"),
    )
    return built.select(F.concat(header, F.col("_block")).alias("value"))


def write_archives(pages: DataFrame, path: str | None = None, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write ``pages`` (page_id, url, html) as WARC files; returns their folder.

    Pages of a size class (up to SMALL_BYTES, then by powers of four) are written together, so one large page makes no
    others' files small: a file has at most FILE_BYTES, or a single record, and a partition only its last file of a class below a quarter of that.
    """
    pages = pages.select("page_id", "url", "html")
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    size = F.octet_length(F.coalesce("html", F.lit("")))
    grade = F.lit(0)
    for k, least in enumerate(CLASSES, 1):
        grade = F.when(size > least, k).otherwise(grade)
    found = dict(pages.groupBy(grade.alias("grade")).agg(F.max(size)).collect()) or {0: 0}  # a row for each class
    built = revisits(pages)
    for k, largest in sorted(found.items()):
        most = max(1, min(4096, FILE_BYTES // (largest + 1024)))
        records(built.where(grade == k), date).write.option("lineSep", END.decode()).option("maxRecordsPerFile", most).text(f"{path}/class-{k}")
    return path


class Found(NamedTuple):
    """A record, or a gap when ``reason`` is given. Offsets are in the file; ``end`` is exclusive."""

    start: int
    end: int
    header: dict[str, str]
    block: bytes
    reason: str = ""


_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_NEXT = re.compile(rb"WARC/1\.[01]\r?\n|\x1f\x8b\x08")


def _parse(data: bytes, at: int) -> tuple[int, dict[str, str], bytes] | str:
    """A plain record at ``at`` (where it ends, header, block), or what is wrong."""
    version = _VERSION.match(data, at)
    if not version:
        return "no version line"
    stop = data.find(END, version.end() - 2)
    if stop < 0:
        return "the header does not end"
    header = {}
    for line in data[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "a header line has no colon"
        header[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length, start = header.get("content-length", ""), stop + len(END)
    if not (length.isascii() and length.isdigit()):
        return "no length"
    end = start + int(length)
    if end > len(data):
        return "the block is cut short"
    block = data[start:end]
    kind, _, digest = header.get("warc-block-digest", "").partition(":")
    if kind.lower() == "sha256" and hashlib.sha256(block).hexdigest() != digest.lower():
        return "the block's digest differs"
    if data[end : end + len(END)] == END:
        end += len(END)
    elif end != len(data):
        return "the record does not end in blank lines"
    return end, header, block


def _member(data: bytes, at: int) -> tuple[int, list[tuple[dict[str, str], bytes]]] | str:
    """A gzip member at ``at``: where it ends and its records."""
    unzip = zlib.decompressobj(31)
    try:
        plain = unzip.decompress(data[at:])
    except zlib.error as e:
        return f"gzip: {e}"
    if not unzip.eof:
        return "the member is cut short"
    out, pos = [], 0
    while pos < len(plain):
        got = _parse(plain, pos)
        if isinstance(got, str):
            return got
        pos = got[0]
        out.append(got[1:])
    return len(data) - len(unzip.unused_data), out


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps of an archive, in order; together they cover every byte."""
    at, bad, why = 0, None, ""
    while at < len(data):
        got = _member(data, at) if data[at : at + 3] == b"\x1f\x8b\x08" else _parse(data, at)
        if isinstance(got, str):
            if bad is None:
                bad, why = at, got
            following = _NEXT.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if bad is not None:
            yield Found(bad, at, {}, b"", why)
            bad = None
        start, at = at, got[0]
        for header, block in [got[1:]] if len(got) == 3 else got[1]:
            yield Found(start, at, header, block)
    if bad is not None:
        yield Found(bad, len(data), {}, b"", why)


FIELDS = (
    "file string, start long, end long, reason string, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)


def _row(path: str, found: Found) -> tuple:
    if found.reason:
        return (path, found.start, found.end, found.reason, *[None] * 7)
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?[0-9]+)>", found.header.get(name, ""))) else None
    http, _, payload = found.block.partition(END)
    kind = found.header.get("warc-type")
    length = re.search(rb"\r\nContent-Length: ([0-9]+)", http)
    size = int(length[1]) if length else len(payload)
    digest = found.header.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind != "revisit" and (size != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        return (path, found.start, found.end, "the payload differs from its digest or length", *[None] * 7)
    return (path, found.start, found.end, None, number("warc-record-id"), found.header.get("warc-target-uri"), kind, number("warc-refers-to"), size, digest, payload)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records and, with a reason, quarantined gaps of the archives below ``path``. A revisit has no payload of its own."""
    names = [c.split()[0] for c in FIELDS.split(", ")]
    keep = names if payload else names[:-1]

    def parse(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in files:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows, held = [], 0
                for found in salvage(bytes(content)):
                    rows.append(_row(name, found))
                    held += len(found.block)
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)[keep]
        return out.astype({c: "Int64" for c in ("page_id", "refers_to", "payload_bytes")})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > 0).select("path", "content")
    return files.mapInPandas(parse, ", ".join(FIELDS.split(", ")[: len(keep)]))
