"""WARC archives with an index: written once, read back by coalesced byte ranges."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bloom
from docloom.session import cut_lineage, shared_dir

# Payloads of at least this many bytes are stored once; equal ones revisit the first.
REVISIT_BYTES = 100
# A new archive file is begun beyond this size.
FILE_BYTES = 1 << 30
# Byte ranges that lie at most GAP apart are read at once, up to RANGE bytes.
GAP, RANGE = 64 << 10, 8 << 20
# Archive bytes that a task reads.
TASK_BYTES = 64 << 20
DATE = "2025-01-01T00:00:00Z"

INDEX = (
    "file string, offset long, length long, page_id long, url string, digest string, record_type string,"
    " refers_to long, payload_bytes long"
)
RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string,"
    " refers_to long, payload binary"
)


def new_folder(spark: SparkSession) -> str:
    """A new folder for archives under the folder that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def record_types(pages: DataFrame, shortest: int = REVISIT_BYTES) -> DataFrame:
    """Of each row (page_id, url, html): digest, bytes and, for revisits, the response's id.

    Of rows with equal payloads of ``shortest`` bytes or more, the smallest id
    is the response. Rows that repeat that id are responses as well; a null id
    is one only if the payload has no other.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = cut_lineage(
        pages.select(
            "page_id", "url", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes")
        )
    )
    long_ones = narrow.where(F.col("payload_bytes") >= shortest)
    groups = long_ones.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    shared = groups.where((F.col("rows") > 1) & F.col("first").isNotNull()).select(F.col("digest").alias("_digest"), "first")
    joined = narrow.join(shared, F.col("digest") == F.col("_digest"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "digest", "payload_bytes", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, shortest: int = REVISIT_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the index, a table in ``folder``.

    The index has the file, offset and length of each record, its URL, digest
    and type. Revisits are written from their digests alone; only responses
    read their payload, and no payload is moved but those that a Bloom filter
    of the revisiting rows cannot tell apart. Each task attempt writes files of its own
    name, and the index, committed by Spark, names those of the attempts that
    succeeded: a lost executor costs its tasks only.

    A null html is an empty payload, a null URL leaves out the target, a null
    id the record's id. Other columns are left out, whatever their names. An
    empty table gives an empty index.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html")
    revisits = cut_lineage(record_types(rows, shortest).where(F.col("refers_to").isNotNull()))
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256)
    # The key of a row: its id and its payload.
    key = lambda digest: F.concat_ws("/", F.col("page_id").cast("string"), digest)
    keys = revisits.select(key(F.col("digest")).alias("_key")).distinct()
    flagged = bloom.build(keys, "_key").flag(
        rows.withColumn("digest", digest).withColumn("_id", key(F.col("digest"))), F.col("_id"), "_maybe"
    )
    whole = ["page_id", "url", "html", "digest"]
    unsure = flagged.where(F.col("_maybe")).join(keys, F.col("_id") == F.col("_key"), "left_anti").select(*whole)
    responses = flagged.where(~F.col("_maybe")).select(*whole).unionByName(unsure)
    none = lambda kind: F.lit(None).cast(kind)
    records = responses.select(*whole, none("long").alias("refers_to"), none("long").alias("payload_bytes")).unionByName(
        revisits.select("page_id", "url", none("string").alias("html"), "digest", "refers_to", "payload_bytes")
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                index = []
                for row in batch.itertuples(index=False):
                    if out is None or offset >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    body = (row.html or "").encode()
                    revisit = not pd.isna(row.refers_to)
                    size = int(row.payload_bytes) if revisit else len(body)
                    member = gzip.compress(_record(row, body, revisit, size), 4, mtime=0)
                    out.write(member)
                    kind = "revisit" if revisit else "response"
                    index.append(
                        (name, offset, len(member), row.page_id, row.url, row.digest, kind, row.refers_to, size)
                    )
                    offset += len(member)
                yield _frame(index, INDEX)
        finally:
            if out is not None:
                out.close()

    path = f"{folder}/index"
    records.mapInPandas(write, INDEX).write.parquet(path)
    return spark.read.parquet(path)


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that rows of ``index`` name, parsed.

    Rows are sorted by file and offset, ranges that lie together are read at
    once, and each record is unpacked by itself. Size and digest of a response
    are taken from its payload, those of a revisit from its own header.
    ``payloads=False`` leaves the payloads out of the result.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            records: list[tuple] = []
            held = 0
            for name, start, members in _ranges(batch):
                with store.open_input_file(f"{base}/{name}") as file:
                    file.seek(start)
                    data = file.read(members[-1][0] + members[-1][1] - start)
                for offset, length in members:
                    record = _parse(gzip.decompress(data[offset - start : offset - start + length]), payloads)
                    records.append(record)
                    held += len(record[-1] or b"")
                    if held >= RANGE:
                        yield _frame(records, RECORD)
                        records, held = [], 0
            yield _frame(records, RECORD)

    # The rows are narrow, but stand for many bytes: a task gets TASK_BYTES of archive to read.
    bytes_ = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, bytes_ // TASK_BYTES + 1)
    chosen = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset")
    return chosen.sortWithinPartitions("file", "offset").mapInPandas(read, RECORD)


def _ranges(batch: pd.DataFrame) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """File, start and members of each range that is read at once."""
    name, members = None, []
    for file, offset, length in zip(batch["file"], batch["offset"], batch["length"], strict=True):
        near = members and file == name and 0 <= offset - sum(members[-1]) <= GAP
        if members and not (near and offset + length - members[0][0] <= RANGE):
            yield name, members[0][0], members
            members = []
        name = file
        members.append((int(offset), int(length)))
    if members:
        yield name, members[0][0], members


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [field.split()[0] for field in schema.split(",")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({n: "Int64" for n in ("page_id", "refers_to") if n in names})


def _record(row, body: bytes, revisit: bool, size: int) -> bytes:
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Date: " + DATE.encode()]
    if not pd.isna(row.page_id):
        lines.append(b"WARC-Record-ID: <urn:page:%d>" % int(row.page_id))
    if row.url is not None:
        # A line break would end the header.
        url = row.url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
        lines.append(b"WARC-Target-URI: " + url.encode())
    lines += [b"WARC-Payload-Digest: sha256:" + row.digest.encode(), b"X-Payload-Length: %d" % size]
    if revisit:
        lines += [
            b"WARC-Refers-To: <urn:page:%d>" % int(row.refers_to),
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
        block = b""
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + body
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(data: bytes, payloads: bool) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(b": ", 1) for line in lines[1:])
    block = rest[: int(fields[b"Content-Length"])]
    number = lambda name: int(fields[name][10:-1]) if name in fields else None  # noqa: E731  <urn:page:7>
    url = fields.get(b"WARC-Target-URI")
    if url is not None:
        url = url.decode().replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    kind, stated = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
    if kind == "revisit":
        size = int(fields[b"X-Payload-Length"])
        return number(b"WARC-Record-ID"), url, size, stated, kind, number(b"WARC-Refers-To"), None
    body = block.partition(b"\r\n\r\n")[2]
    digest = hashlib.sha256(body).hexdigest()
    if digest != stated:
        raise ValueError(f"payload of {fields.get(b'WARC-Record-ID')} does not have its digest")
    return number(b"WARC-Record-ID"), url, len(body), digest, kind, None, body if payloads else None


def digests(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` to archives in ``folder`` and read all of them back, without their payloads."""
    index = write_archives(pages, folder)
    columns: list[str | Column] = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read_records(index, folder, payloads=False).select(*columns)
