"""WARC archives: write a record per page, read archives back by boundary-chain verification.

Writing. :func:`write_warc` decides which payloads are repeats (equal SHA-1 and
length), and writes through Spark's text sink: a row is a record's header and block,
the sink's line separator is the ``CRLF CRLF`` that ends a record, and the files are
gzip-compressed. A repeat becomes a ``revisit`` record without payload that names the
record it refers to.

Reading. :func:`read_warc` must not trust the magic ``WARC/1.1``, since payloads can
hold it. Tasks emit, for every magic, a candidate (offset -> successor offset, from its
Content-Length). Only what the chain from the start of its file reaches is a record:
pointer jumping over a file's offsets doubles the reached prefix and the jump length each
round. A chain that does not end at the end of its file raises an error. Files are read
whole (gzip has no inner starts), so a file is what a task holds; the writer bounds it.

Null payloads are empty payloads. Equal payloads whose page ids tie for the smallest
are all responses; a null id never is the smallest unless all are null. Null urls give
a record without target. An empty table writes and reads back nothing. Extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables._workers import ship_with_tasks
from graphtables.llm.common import text_or_empty, written
from graphtables.session import shared_path

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
FIELD = re.compile(rb"([A-Za-z0-9-]+):[ \t]*([^\r\n]*)\r\n")
#: records of a file; a reader task holds one file
RECORDS_PER_FILE = 2000
#: compressed bytes that a gzip member is fed with at a time
STEP = 1 << 14
#: repeated digests up to this number are broadcast, more are joined by shuffle
BROADCAST_DIGESTS = 100_000

CANDIDATE = ("path string, size long, at long, next long, record_type string, page string, "
             "refers_to string, payload_bytes long, payload_digest string")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary or string column (160 bits: no padding)."""
    digest = F.sha1(payload)
    parts = []
    for g in range(8):      # 5 hex digits are 4 base32 digits
        bits = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.lit(BASE32).substr(F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)


def _with_references(rows: DataFrame, min_bytes: int) -> DataFrame:
    """Adds ``refers_to`` (null for responses)."""
    repeats = written(
        rows.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes")
        .agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n"), "warc-repeats")
    if repeats.count() <= BROADCAST_DIGESTS:
        repeats = F.broadcast(repeats)
    joined = rows.join(repeats, ["digest", "bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first")))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url",
               payload: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
               records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record per row of ``pages`` below ``path``; payloads of ``min_bytes`` or
    more that repeat an earlier one (smallest id) become revisits."""
    rows = pages.select(F.col(id_col).alias("page"), F.col(url).cast("string").alias("url"),
                        text_or_empty(payload).alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})
    rows = _with_references(rows, min_bytes)
    revisit = F.col("refers_to").isNotNull()

    def line(name: str, value: Column) -> Column:       # no line at all for a null value
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page").cast("string"), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    (rows.select(record.alias("value")).write
     .option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def inflate(content: bytes) -> bytes:
    """The bytes of a gzip file of any number of members; other bytes unchanged. A member is fed in steps, so that what
    follows it is not copied again for each of them."""
    if content[:2] != b"\x1f\x8b":
        return content
    out, at, rest = [], 0, memoryview(content)
    while at < len(content):
        member = zlib.decompressobj(wbits=31)
        while not member.eof and at < len(content):
            step = rest[at:at + STEP]
            out.append(member.decompress(step))
            at += len(step) - len(member.unused_data)
        if not member.eof:
            raise ValueError("a gzip member is cut off")
    return b"".join(out)


def _page(value: bytes | None) -> str | None:
    return value.decode().removeprefix("<urn:page:").removesuffix(">") if value is not None else None


def candidates(data: bytes) -> Iterator[tuple]:
    """(offset, successor, type, page, refers to, payload bytes, digest) of every magic in
    ``data`` that a complete record could start at, whether or not it is one."""
    for m in MAGIC.finditer(data):
        at, fields = m.end(), {}
        while f := FIELD.match(data, at):
            fields[f[1].lower()] = f[2]
            at = f.end()
        length = fields.get(b"content-length", b"")
        if data[at:at + 2] != b"\r\n" or not length.isdigit():
            continue
        start, end = at + 2, at + 2 + int(length)
        if data[end:end + 4] != b"\r\n\r\n":
            continue
        kind = fields.get(b"warc-type", b"").decode("latin-1")
        if kind == "revisit":
            stated = fields.get(b"warc-payload-length", b"")
            size = int(stated) if stated.isdigit() else None
            digest = fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
        else:
            size = end - start
            digest = base64.b32encode(hashlib.sha1(data[start:end]).digest()).decode()
        yield (m.start(), end + 4, kind, _page(fields.get(b"warc-record-id")),
               _page(fields.get(b"warc-refers-to")), size, digest)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in CANDIDATE.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            data = inflate(content.as_py())
            found = [(path.as_py(), len(data), *c) for c in candidates(data)]
            if found or data:       # a file of bytes without any record must fail the chain test
                found = found or [(path.as_py(), len(data), -1, -1, *[None] * 5)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*found), types)], names=names)


def jump(at: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Which of the candidates at the ascending offsets ``at`` the chain from offset 0 reaches.

    Pointer jumping: after round k the reached set holds the chain's first 2^k records, and a
    jump passes 2^k of them."""
    n = len(at)
    to = np.searchsorted(at, then)
    to = np.where((to < n) & (at[np.minimum(to, n - 1)] == then), to, n)       # n: leads to no candidate
    to = np.append(to, n)
    reached = np.zeros(n + 1, bool)
    reached[0] = at[0] == 0
    while (to[:n] < n).any():
        reached[to[reached]] = True
        to = to[to]
    return reached[:n]


def reachable(found: DataFrame) -> DataFrame:
    """The candidates on the chain from the start of their file, and ``whole``: whether that chain
    ends at the end of the file. A group is the candidates of one file."""
    def chain(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        at, then = group["at"].to_numpy(), group["next"].to_numpy()
        reached = jump(at, then)
        whole = bool((then[reached] == group["size"][0].as_py()).any())
        kept = group.filter(pa.array(reached)) if reached.any() else group.slice(0, 1)
        return kept.append_column("whole", pa.array([whole] * len(kept)))

    return found.groupBy("path").applyInArrow(chain, f"{CANDIDATE}, whole boolean")


def read_warc(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row per record of the archives below ``path``: id, type, payload size and
    digest (of a response: of the bytes read), the id it refers to, file and offset. Every file is an archive, whatever
    its name, plain or gzip, of one member or one a record; names that begin with a dot or an underscore are not read."""
    files = spark.read.format("binaryFile").load(path)
    found = files.select("path", "content").mapInArrow(_scan, CANDIDATE)
    records = written(reachable(found), "warc-records")
    broken = records.where("not whole").select("path").distinct().count()
    if broken:
        raise ValueError(f"{broken} archive files do not end where their record chain does")
    return records.select(
        F.col("page").cast(id_type).alias("page"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"), "path", F.col("at").alias("offset"))


def archive_path(spark: SparkSession) -> str:
    return shared_path(spark, "warc")


ship_with_tasks(__name__)
