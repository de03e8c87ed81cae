"""WARC archives: a writer, a normaliser of monolithic gzip files, an offset index, and a reader.

Writing gives archive files of about ARCHIVE_BYTES of records, each whole file a single gzip stream. The normaliser
inflates each such file once, in order, rewrites every record as a gzip member of its own and notes where
each member stands (the sidecar index), so that records can be read without what comes before them. An archive is
named after the file it was made from, which no other task writes, and says its name in its first record. Archives and
index lie in the same numbered folders; a task that reads an archive looks its places up in the index of that folder, so
no archive is shuffled. The index is read through Arrow, from any file system that both Hadoop and Arrow open.

Files are written by Spark's text writer (its commit protocol covers lost executors and its paths are any
Hadoop path): a row is a file's bytes but for a last zero byte, and zero is the line separator. A gzip
stream ends in a zero byte if its last record is under 16 MB; otherwise an empty member is appended.

Of records with equal payloads of at least MIN_REVISIT bytes, the one with the smallest page_id is a
response and the others are revisits that refer to it; rows that repeat that page_id are responses.

Defined results: null html counts as empty; null urls are written as "urn:none"; null page_ids sort last
and are written without an id.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import arrow_map, begin, filled_text, remove, scratch_path, slices, small, stored, tidy

MIN_REVISIT = 100
#: Bytes of records in one archive, at most about; archives in a folder; gzip level.
ARCHIVE_BYTES, FOLDER_ARCHIVES, LEVEL = 24 << 20, 64, 1
DATE = "2024-01-01T00:00:00Z"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit has no block: its payload is that of the record it refers to."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:docweave:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {re.sub('[\\x00-\\x20]', '', url or '') or 'urn:none'}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:docweave:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


EMPTY_MEMBER = gzip_member(b"")


def ends_in_zero(data: bytes) -> bytes:
    return data if data.endswith(b"\0") else data + EMPTY_MEMBER


def records_of(chunks):
    """(headers, block) of each record of a stream given in pieces of any size."""
    held = bytearray()
    source = iter(chunks)

    def more() -> bool:
        piece = next(source, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if bytes(held).strip():
                    raise ValueError("a WARC record without an end")
                return
        lines = bytes(held[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = end + 4 + int(head["Content-Length"])
        while len(held) < size + 4:
            if not more():
                raise ValueError("a WARC record is cut short")
        yield head, bytes(held[end + 4 : size]), bytes(held[: size + 4])
        del held[: size + 4]


def inflated(data: bytes, step: int = 1 << 20):
    """The contents of a gzip file (any number of members), in pieces."""
    at, d = 0, zlib.decompressobj(31)
    while at < len(data):
        piece = d.decompress(data[at : at + step])
        at += step
        while d.eof:
            if piece:
                yield piece
            rest = d.unused_data.lstrip(b"\0")
            d = zlib.decompressobj(31)
            piece = d.decompress(rest) if rest else b""
            if not rest:
                break
        if piece:
            yield piece


def named(name: str) -> bytes:
    """The member with the record that an archive begins with."""
    block = b"software: docweave\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:docweave:archive:{name}>", f"WARC-Filename: {name}", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return gzip_member("\r\n".join(head).encode() + block + b"\r\n\r\n")


def name_of(data) -> str:
    """The name that the first record of an archive says."""
    head, _, _ = next(records_of([zlib.decompressobj(31).decompress(data[: 1 << 12])]))
    return head["WARC-Filename"]


def normalise(data: bytes, name: str = "") -> tuple[bytes, list[tuple]]:
    """A file with one member for each record, begun by one with its name if there is one, and for each record its
    index row."""
    members, index = [named(name)] if name else [], []
    at = sum(map(len, members))
    for head, _, raw in records_of(inflated(data)):
        m = gzip_member(raw)
        index.append((page_of(head["WARC-Record-ID"]), at, len(m), head["WARC-Type"]))
        members.append(m)
        at += len(m)
    return b"".join(members), index


def page_of(urn: str):
    tail = urn.rstrip(">").rpartition(":")[2]
    return int(tail) if tail else None


# --- files ----------------------------------------------------------------------------------------


def write_files(rows: DataFrame, path: str, by: list[str]) -> None:
    """rows: a binary column `data`, each row the bytes of a file of its own, ending in a zero byte, and the columns
    that name folders."""
    cut = F.substring("data", F.lit(1), F.length("data") - 1)
    rows.select(*by, cut.cast("string").alias("value")).write.partitionBy(*by).option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").withColumnRenamed("content", "data")


# --- operators ------------------------------------------------------------------------------------


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload an earlier page has. Digests only are moved,
    summed up before the shuffle, and joined on the few that occur more than once."""
    html = F.coalesce("html", F.lit(""))
    long_ones = pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n")).filter(F.col("n") >= MIN_REVISIT)
    digests = stored(long_ones.select("page_id", "digest"), "page-digests")
    several = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 AND refers_to IS NOT NULL").drop("n")
    again = digests.join(small(stored(several, "digest-groups")), "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return stored(again.select("page_id", "digest", "refers_to").distinct(), "revisits")


def write_monolithic(pages: DataFrame, path: str) -> None:
    """Archives of the pages, each a single gzip stream."""
    marks = small(revisits(pages).withColumnRenamed("page_id", "same_page").withColumnRenamed("digest", "same_digest"))
    rows = pages.select("page_id", "url", "html").withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    rows = rows.join(marks, F.col("page_id").eqNullSafe(F.col("same_page")) & (F.col("digest") == F.col("same_digest")), "left").select("page_id", "url", F.col("html").alias("text"), "digest", "refers_to")

    def run(batches):
        begin()
        tidy()
        out, size, gz = [], 0, None
        for batch in batches:
            for part in slices(batch, 4 << 20):
                for page, url, html, digest, to in zip(*(c.to_pylist() for c in (part.column("page_id"), part.column("url"), filled_text(part), part.column("digest"), part.column("refers_to")))):
                    gz = gz or zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    payload = html.encode()
                    whole = record(page, url, payload, digest, to)
                    out.append(gz.compress(whole))
                    size += len(whole)
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([ends_in_zero(b"".join([*out, gz.flush()]))], pa.binary())], ["data"])
                        out, size, gz = [], 0, None
        if gz:
            yield pa.RecordBatch.from_arrays([pa.array([ends_in_zero(b"".join([*out, gz.flush()]))], pa.binary())], ["data"])

    write_files(rows.mapInArrow(run, "data binary"), path, [])


INDEX = "archive string, page_id long, offset long, length long, record_type string"


def normalise_files(spark: SparkSession, source: str, path: str) -> None:
    """Rewrites all archives of a folder, which goes then: archives/folder=N/ and the sidecar index/folder=N/ under
    path. Each task reads a file in one go and holds its compressed bytes only."""

    def make():
        def f(batch):
            for k in range(batch.num_rows):
                name = "w" + hashlib.sha256(batch.column("path")[k].as_py().rpartition("/")[2].encode()).hexdigest()[:24]
                data, index = normalise(batch.column("data")[k].as_py(), name)
                cols = list(zip(*index)) if index else [[]] * 4
                entry = pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.string()])], ["page_id", "offset", "length", "record_type"])
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ends_in_zero(data)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(entry)], pa.int32()), entry)], ["archive", "data", "entries"])

        return f

    schema = "archive string, data binary, entries array<struct<page_id: long, offset: long, length: long, record_type: string>>"
    done = stored(arrow_map(read_files(spark, source), make, schema), "normalised", staging := scratch_path(spark, "normalised"))
    remove(spark, source)
    folders = max(1, -(-done.select("archive").count() // FOLDER_ARCHIVES))
    placed = done.withColumn("folder", F.pmod(F.xxhash64("archive"), F.lit(folders)).cast("int"))
    write_files(placed.select("folder", "data"), f"{path}/archives", ["folder"])
    index = placed.select("folder", "archive", F.explode("entries").alias("e")).select("folder", "archive", "e.*")
    index.repartition("folder").sortWithinPartitions("folder", "archive", "offset").write.partitionBy("folder").parquet(f"{path}/index")
    remove(spark, staging)


def places(index: str, folder: str, archive: str) -> list[tuple[int, int]]:
    """Offset and length of each record of an archive, from the index of its folder."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(index)
    found = ds.dataset(f"{root}/folder={folder}", filesystem=system, format="parquet").to_table(["offset", "length"], filter=ds.field("archive") == archive).sort_by("offset")
    return list(zip(found["offset"].to_pylist(), found["length"].to_pylist()))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, each inflated alone
    at the place the index gives; the digest of a response is made anew from its block."""
    files = read_files(spark, f"{path}/archives").select(F.regexp_extract("path", "/folder=([0-9]+)/", 1).alias("folder"), "data")
    index = f"{path}/index"

    def make():
        def f(batch):
            for data, folder in zip(batch.column("data"), batch.column("folder").to_pylist()):
                raw = memoryview(data.as_buffer())
                rows = []
                for offset, length in places(index, folder, name_of(raw)):
                    member = zlib.decompress(raw[offset : offset + length], 31)
                    head, block, _ = next(records_of([member]))
                    first = head["WARC-Type"] == "response"
                    digest = hashlib.sha256(block).hexdigest() if first else head["WARC-Payload-Digest"].rpartition(":")[2]
                    rows.append((page_of(head["WARC-Record-ID"]), len(block) if first else int(head["WARC-Payload-Length"]), digest, head["WARC-Type"], None if first else page_of(head["WARC-Refers-To"])))
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        return f

    return arrow_map(files, make, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write, normalise, index and read back all pages."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_monolithic(pages, f"{path}/monolithic")
    normalise_files(spark, f"{path}/monolithic", path)
    return read_records(spark, path)
