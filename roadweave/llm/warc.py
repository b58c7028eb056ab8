"""WARC archives: a writer that records repeats as revisits, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.common import lookup_join, make_folder, shared_path, slices, stored, table, write_file

VERSION = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b\x08"
START = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "file string, offset long, length long, status string, record_type string, record_id string, target_uri string, payload_digest string, payload_length long, refers_to string, payload binary, gap_reason string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit has an empty block and the original's full digest and length."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{url}')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "")),
        ("WARC-Page-ID", "" if page is None else str(page)),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Page", str(refers_to))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def marked(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to of every page: of equal payloads of least_bytes or more the largest page_id is the response.

    Null html counts as empty, rows that repeat page_id and payload are one page, and a group whose page ids are
    all null has responses only.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    groups = pages.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    groups = stored(groups.where("copies > 1"), "payloads")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    out = lookup_join(pages, groups, ["digest"], "copies", total, ["page_id"])
    other = (F.octet_length("payload") >= least_bytes) & (F.col("first_id") != F.coalesce(F.col("page_id"), F.lit(-(1 << 63))))
    return out.select("page_id", "url", "payload", F.when(other, F.col("first_id")).alias("refers_to"))


def write_warc(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", compress: bool = True, most: int = 64 << 20) -> DataFrame:
    """Writes (page_id, url, payload, refers_to) rows; returns file, records, bytes. Each task writes files of about `most` bytes.

    Every record is a gzip member of its own, so a reader can start at any of them. A task writes its records in order of page.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        pack = (lambda b: gzip.compress(b, 5, mtime=0)) if compress else (lambda b: b)
        parts, size, files, count = [], 0, [], 0

        def close() -> None:
            nonlocal parts, size, count
            if parts:
                name = f"part-{task:06d}-{len(files):04d}.warc" + ".gz" * compress
                files.append((name, count, write_file(f"{path}/{name}", parts)))
            parts, size, count = [], 0, 0

        for batch in slices(batches, "payload"):
            for page, url, payload, refers in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "refers_to"))):
                parts.append(pack(record_bytes(page, url, payload or b"", refers, date)))
                size, count = size + len(parts[-1]), count + 1
                if size >= most:
                    close()
        close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files]), pa.array([f[1] for f in files], pa.int64()), pa.array([f[2] for f in files], pa.int64())], names=["file", "records", "bytes"])

    path = make_folder(records.sparkSession, path)
    # In one order, so that a retried task writes the same files again, and none of the first try is left.
    rows = records.select("page_id", "url", "payload", "refers_to").sortWithinPartitions("page_id", "url", F.xxhash64("payload"), "refers_to")
    return rows.mapInArrow(write, "file string, records long, bytes long")


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and full length of the record at the start of data; ValueError says what is wrong with it."""
    m = START.match(data)
    if not m:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        raise ValueError("the header has no end")
    head = {}
    for line in data[m.end() : end].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon and line:
            raise ValueError("a header line has no colon")
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise ValueError("no content length")
    at = end + 4
    block = data[at : at + int(length)]
    if len(block) < int(length):
        raise ValueError("the block is cut short")
    if data[at + len(block) : at + len(block) + 4] != b"\r\n\r\n":
        raise ValueError("the record has no end mark")
    want = head.get("warc-block-digest", "")
    if want.lower().startswith("sha1:") and want[5:].upper() != digest_of(block):
        raise ValueError("the block digest differs")
    return head, block, at + len(block) + 4


def member(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and compressed length of the gzip member at `at`."""
    d, out, end, view = zlib.decompressobj(31), [], at, memoryview(data)
    try:
        while not d.eof and end < len(data):
            out.append(d.decompress(view[end : end + 65536]))
            end = min(end + 65536, len(data))
    except zlib.error as e:
        raise ValueError(f"gzip: {e}") from e
    if not d.eof:
        raise ValueError("gzip: the member is cut short")
    return b"".join(out), end - at - len(d.unused_data)


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """(offset, length, headers, block, "") of each valid record, and (offset, length, None, b"", reason) of each gap between.

    Where a record fails its checks, the search goes on byte by byte for the next gzip member or version line that
    passes them; the bytes in between are one quarantined gap.
    """
    at, gap, why = 0, -1, ""
    member_at = line_at = 0
    while at < len(data):
        try:
            if data.startswith(GZIP, at):
                out, n = member(data, at)
                head, block, used = parse(out)
                if used != len(out):
                    raise ValueError("a member holds more than a record")
            else:
                if not START.match(data, at):
                    raise ValueError("no version line")
                tail = data[at:] if len(data) - at < 1 << 20 else data[at : at + _extent(data, at)]
                head, block, n = parse(tail)
        except ValueError as e:
            if gap < 0:
                gap, why = at, str(e)
            # The next place of each mark is kept until it is passed, so no byte is searched twice for it.
            if member_at <= at:
                found = data.find(GZIP, at + 1)
                member_at = found if found >= 0 else len(data)
            if line_at <= at:
                mark = START.search(data, at + 1)
                line_at = mark.start() if mark else len(data)
            at = min(member_at, line_at)
            continue
        if gap >= 0:
            yield gap, at - gap, None, b"", why
            gap = -1
        yield at, n, head, block, ""
        at += n
    if gap >= 0:
        yield gap, len(data) - gap, None, b"", why


def _extent(data: bytes, at: int) -> int:
    end = data.find(b"\r\n\r\n", at)
    m = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]{1,18})\s*\r\n", data[at : end + 2]) if end > 0 else None
    return end - at + 4 + (int(m[1]) if m else 0) + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record (status "ok") and per quarantined gap (status "gap") of all .warc and .warc.gz files under path.

    A file is read whole by one task, so keep files at the size that write_warc makes. An empty
    file has no rows.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                rows, size = [], 0
                for at, n, head, block, why in salvage(data):
                    h = head or {}
                    digest = h.get("warc-payload-digest", "")
                    rows.append((name, at, n, "ok" if head is not None else "gap", h.get("warc-type"), h.get("warc-page-id"), h.get("warc-target-uri"), digest.partition(":")[2] or None, int(h["warc-payload-length"]) if h.get("warc-payload-length", "").isdigit() else len(block) if head is not None else None, h.get("warc-refers-to-page"), block if head is not None else None, why or None))
                    size += len(block)
                    if size > 16 << 20:
                        yield pd.DataFrame(rows, columns=COLUMNS)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=COLUMNS).astype({"payload_length": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(path).select("path", "content")
    return files.mapInPandas(read, SCHEMA)


COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read back from the archives that hold them all."""
    path = shared_path(spark, "warc")
    write_warc(marked(table(spark, sf_dir, "pages")), path).agg(F.sum("records")).collect()
    back = read_warc(spark, path).where("status = 'ok'")
    return back.select(
        F.expr("try_cast(record_id AS bigint)").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.expr("try_cast(refers_to AS bigint)").alias("refers_to"),
    )
