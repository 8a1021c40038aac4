"""Web archives: written from pages, and read back by verified record boundaries.

A record names its length, so a file is a chain of records from its start. To read a file in many
tasks, each one finds the record headers that begin in its range and emits the place where each
record ends. Such a header may also lie inside a payload; pointer jumping from the file's start
keeps exactly the records that the chain reaches.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm.scratch import new_path, stored

MAGIC = b"WARC/1.0\r\n"
#: Payloads from this size on are written once and then referred to.
REVISIT_FROM = 1000
#: A task begins another archive beyond this size, and reads ranges of this size.
ARCHIVE_BYTES, RANGE_BYTES = 256 << 20, 16 << 20
#: Revisits up to this many (some 100 bytes each) are sent to every task.
SENT_REVISITS = 200_000
#: Tables of more jumps than this (24 bytes each) meet in merge joins, whatever the planner thinks of their size.
SENT_JUMPS = 500_000
#: Tasks that read archives, for each core; a task reads several byte ranges where there are more.
WAVES = 64
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ARCHIVES = "path string, bytes long, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _opened(path: str, write: bool = False):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(place.rpartition("/")[0], recursive=True)
        return system.open_output_stream(place)
    return system.open_input_file(place)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d*)>", name)[1]
    return int(found) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or with ``refers_to`` a revisit record without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:] if line)
    return {k.decode("latin-1").strip().lower(): v.decode(errors="replace").strip() for k, _, v in pairs}


def with_refers(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``: of equal payloads of ``least`` bytes or more, the largest page_id.

    NULL for that page itself, for smaller payloads and for pages without an id.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    known = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("_w_sha"), F.octet_length(payload).alias("_w_bytes"))
    ids = known.where((F.col("_w_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "_w_sha")
    first = ids.groupBy("_w_sha").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where("low < refers_to")
    later = stored(ids.join(first, "_w_sha").where("page_id < refers_to").select(F.col("page_id").alias("_w_page"), F.col("_w_sha").alias("_w_same"), "refers_to").distinct(), "revisits")
    if later.count() <= SENT_REVISITS:
        later = F.broadcast(later)
    return known.join(later, (F.col("page_id") == F.col("_w_page")) & (F.col("_w_sha") == F.col("_w_same")), "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row (page_id, url, html, refers_to); the files (path, bytes, records) as a stored table.

    Files carry the number of the task's attempt: what a lost task left is not in the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        done, out, size, records = [], None, 0, 0
        path = lambda: f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):04d}.warc"
        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
                if out is None:
                    out, size, records = _opened(path(), write=True), 0, 0
                payload = (html.as_py() or "").encode()
                size += out.write(record(page_id.as_py(), url.as_py(), payload, refers_to.as_py()))
                records += 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path(), size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((path(), size, records))
        if done:
            names, sizes, counts = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["path", "bytes", "records"])

    return stored(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, ARCHIVES), "archives")


def candidates(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, at, next) of every record header in the files, also of those inside payloads."""
    last = F.floor((F.greatest("bytes", F.lit(1)) - 1) / range_bytes)
    ranges = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    ranges = ranges.select("path", (F.col("k") * range_bytes).alias("start"), F.least((F.col("k") + 1) * range_bytes, "bytes").alias("stop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ats, nexts = [], []
                with _opened(path) as file:
                    file.seek(start)
                    data = file.read(stop - start + len(MAGIC) - 1)
                    at = data.find(MAGIC)
                    while at >= 0:
                        end = data.find(b"\r\n\r\n", at)
                        while end < 0:  # the header goes on in the next range
                            file.seek(start + len(data))
                            more = file.read(1 << 16)
                            if not more:
                                break
                            data += more
                            end = data.find(b"\r\n\r\n", max(at, len(data) - len(more) - 3))
                        length = _fields(data[at:end]).get("content-length", "") if end >= 0 else ""
                        if length.isascii() and length.isdigit() and len(length) < 19:
                            ats.append(start + at)
                            nexts.append(start + end + 4 + int(length) + 4)
                        at = data.find(MAGIC, at + 1, stop - start + len(MAGIC) - 1)
                if ats:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(ats), pa.string()), pa.array(ats, pa.int64()), pa.array(nexts, pa.int64())], ["path", "at", "next"])

    return ranges.repartition(_tasks(archives.agg(F.sum("bytes")), range_bytes), "path", "start").mapInArrow(run, "path string, at long, next long")


def _tasks(total: DataFrame, range_bytes: int) -> int:
    """As many tasks as there are ranges in so many bytes. A stated number isn't merged at run time,
    when only the small rows that name the ranges are seen."""
    return min(max(1, -(-(total.first()[0] or 0) // range_bytes)), WAVES * total.sparkSession.sparkContext.defaultParallelism)


def reachable(found: DataFrame, archives: DataFrame) -> DataFrame:
    """The candidates (path, at, next) that a chain from the file's start reaches.

    Every round doubles the reach of the jumps; a file of n records takes log2(n) rounds. Raises
    ValueError unless every file's chain ends at its last byte.
    """
    files = stored(archives.select("path", "bytes", F.xxhash64("path").alias("file")), "files")
    found = stored(found.join(files, "path").select("file", "at", "next"), "candidates")
    large = found.count() > SENT_JUMPS
    met = lambda rows: rows.hint("merge") if large else rows
    here = found.select(F.col("file").alias("_file"), F.col("at").alias("_at"))
    jumps = stored(found.join(met(here), (F.col("file") == F.col("_file")) & (F.col("next") == F.col("_at"))).select("file", "at", F.col("next").alias("to")), "jumps")
    reached = stored(found.where("at = 0").select("file", "at"), "reached")
    while jumps.limit(1).count():
        step = jumps.select(F.col("file").alias("_file"), F.col("at").alias("_at"), "to")
        further = reached.join(met(step), (F.col("file") == F.col("_file")) & (F.col("at") == F.col("_at"))).select("file", F.col("to").alias("at"))
        reached = stored(reached.unionByName(further), "reached")
        twice = jumps.withColumnRenamed("to", "_mid").join(met(step), (F.col("file") == F.col("_file")) & (F.col("_mid") == F.col("_at")))
        jumps = stored(twice.select("file", "at", "to"), "jumps")
    chain = stored(found.join(met(reached), ["file", "at"], "left_semi"), "chain")
    ends = chain.groupBy("file").agg(F.max("next").alias("end"))
    broken = files.join(ends, "file", "left").where((F.col("bytes") > 0) & ~F.col("end").eqNullSafe(F.col("bytes"))).select("path").take(3)
    if broken:
        raise ValueError(f"the chain of records doesn't end at the last byte of {', '.join(r.path for r in broken)}")
    return chain.join(files, "file").select("path", "at", "next")


def read_records(chain: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """What the records at (path, at, next) say; payloads are read whole and held against their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            rows = []
            for name, at, after in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if name != path:
                    if file is not None:
                        file.close()
                    path, file = name, _opened(name)
                file.seek(at)
                head, _, block = file.read(after - at - 4).partition(b"\r\n\r\n")
                fields = _fields(head)
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                revisit = fields["warc-type"] == "revisit"
                size = int(_fields(http)["content-length"])
                if not revisit and (len(payload) != size or hashlib.sha1(payload, usedforsecurity=False).hexdigest() != digest):
                    raise ValueError(f"the payload at {at} in {name} isn't the one that was written")
                rows.append((_page(fields["warc-record-id"]), size, digest, fields["warc-type"], _page(fields["warc-refers-to"]) if revisit else None))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if file is not None:
            file.close()

    part = F.floor(F.col("at") / range_bytes)
    tasks = _tasks(chain.agg(F.sum(F.col("next") - F.col("at"))), range_bytes)
    placed = chain.withColumn("part", part).repartition(tasks, "path", "part").sortWithinPartitions("path", "at")
    return placed.select("path", "at", "next").mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write all rows of ``pages`` (page_id, url, html) to archives and return what they say when read back.

    NULL html is an empty payload, a NULL url has no field, a NULL page_id an empty name. Rows
    repeated with their id are each a record; an empty table gives no files and no rows.
    """
    archives = write_archives(with_refers(pages), new_path(pages.sparkSession, "warc"), archive_bytes)
    return read_records(reachable(candidates(archives, range_bytes), archives), range_bytes)
