"""WARC archives, and their records as a table of chunks."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumloom.llm.common import prepare, stage
from forumloom.operators.skew import join_lookup
from forumloom.session import staging_path

CHUNK = 64 << 10
"""Characters encoded, and bytes read, at once."""

ARCHIVE_BYTES = 256 << 20
"""A writer starts a new archive after this much payload."""

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_text(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def with_roles(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """``pages`` with ``_response``: the largest key among the rows of equal payload, if this row is a revisit.

    Payloads are equal if length and SHA-256 are. Digests and keys alone are grouped, combined before the shuffle;
    payloads travel once, over a join that spreads a payload many rows share. Payloads under
    ``least`` bytes have no revisits. Rows that repeat the largest key are responses too.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    digest = F.sha2(F.encode(body, "UTF-8"), 256)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), body.alias("payload"), digest.alias("_digest"))
    best = stage(
        rows.where(F.octet_length("payload") >= least)
        .groupBy("_digest")
        .agg(F.max("page_id").alias("_best"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 AND _best IS NOT NULL")
        .drop("_n")
    )
    joined = join_lookup(rows, best, ["_digest"], "left")
    response = F.when(~F.col("page_id").eqNullSafe(F.col("_best")), F.col("_best"))
    return joined.select("page_id", "payload", response.alias("_response"))


def _target(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


class _Archive:
    """A gzip WARC file written record by record; each record is a gzip member of its own."""

    def __init__(self, place: fs.FileSystem, path: str):
        self.path, self.out, self.payload = path, place.open_output_stream(path, compression=None), 0

    def add(self, page_id: int | None, payload: str, response: int | None):
        """The payload is encoded, digested and deflated in chunks; its bytes are never held whole."""
        digest, size = hashlib.sha1(), 0
        for part in chunks(payload):
            digest.update(part)
            size += len(part)
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        head = [
            "WARC/1.1",
            f"WARC-Type: {'response' if response is None else 'revisit'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
            "WARC-Date: 2000-01-01T00:00:00Z",
            f"WARC-Target-URI: {_target(page_id)}",
            f"WARC-Payload-Digest: sha1:{sha1_text(digest)}",
            "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(http) + (size if response is None else 0)}",
        ]
        if response is not None:
            head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {_target(response)}"]
        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.out.write(deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http))
        if response is None:
            for part in chunks(payload):
                self.out.write(deflate.compress(part))
        self.out.write(deflate.compress(b"\r\n\r\n") + deflate.flush())
        self.payload += size


def chunks(text: str) -> Iterator[bytes]:
    for i in range(0, len(text), CHUNK):
        yield text[i : i + CHUNK].encode("utf-8", "surrogatepass")


def write_archives(rows: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows ``(page_id, payload, _response)`` as ``.warc.gz`` files; returns the list of files, ``(path, records)``.

    Each task writes its own files into ``folder`` (default: a new one below the shared folder), under names no other attempt
    uses. The list is a table that Spark commits, so files of lost or repeated attempts are in no list and
    never read.
    """
    spark = prepare(rows)
    folder = folder or staging_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = fs.FileSystem.from_uri(folder)
        place.create_dir(base, recursive=True)
        archive, done, n = None, [], 0
        for batch in batches:
            for page_id, payload, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    archive, n = _Archive(place, f"{base}/{name}"), 0
                archive.add(page_id, payload, response)
                n += 1
                if archive.payload >= archive_bytes:
                    archive.out.close()
                    done.append((archive.path, n))
                    archive = None
        if archive is not None:
            archive.out.close()
            done.append((archive.path, n))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder.rstrip('/')}/{p.rpartition('/')[2]}" for p, _ in done]), pa.array([n for _, n in done], pa.int64())],
                names=["path", "records"],
            )

    listed = rows.select("page_id", "payload", F.col("_response")).mapInArrow(run, "path string, records long")
    return stage(listed, "warc-list")


CHUNKS = (
    "page_id long, record_type string, refers_to long, payload_digest string, "
    "chunk_no long, data binary, payload_bytes long, running_digest string, is_last boolean"
)


def read_records(place: fs.FileSystem, path: str, chunk: int = CHUNK) -> Iterator[dict]:
    """The chunks of a ``.warc.gz`` file, in order; at most a chunk and the headers of one record are held."""
    source = place.open_input_stream(path, compression=None)
    raw, inflate, data, ended = b"", zlib.decompressobj(31), b"", False

    def more() -> bool:
        """Inflate a little more of the record into ``data``; False at the end of the record."""
        nonlocal raw, inflate, data, ended
        if inflate.eof:
            return False
        if not raw:
            raw = source.read(chunk)
            if not raw:
                raise ValueError(f"{path} is cut off")
        data += inflate.decompress(raw, chunk)
        raw = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        return True

    while True:
        if not raw:
            raw = source.read(chunk)
            if not raw:
                return
        inflate, data = zlib.decompressobj(31), b""

        def header() -> list[str]:
            nonlocal data
            while b"\r\n\r\n" not in data:
                if not more():
                    raise ValueError(f"{path} has a record without headers")
            found, _, data = data.partition(b"\r\n\r\n")
            return found.decode().split("\r\n")

        warc = dict(line.split(": ", 1) for line in header()[1:])
        http = header()
        fields = dict(line.split(": ", 1) for line in http[1:])
        size = int(fields["Content-Length"])
        revisit = warc["WARC-Type"] == "revisit"
        target, refers = warc["WARC-Target-URI"].rpartition(":")[2], warc.get("WARC-Refers-To-Target-URI", "").rpartition(":")[2]
        row = {
            "page_id": int(target) if target else None,
            "record_type": warc["WARC-Type"],
            "refers_to": int(refers) if refers else None,
            "payload_digest": warc["WARC-Payload-Digest"].removeprefix("sha1:"),
        }
        if revisit:
            yield row | {"chunk_no": 0, "data": b"", "payload_bytes": size, "running_digest": None, "is_last": True}
        else:
            digest, left, number = hashlib.sha1(), size, 0
            while True:
                while len(data) < min(left, chunk) and more():
                    pass
                part, data = data[: min(left, chunk)], data[min(left, chunk) :]
                if left and not part:
                    raise ValueError(f"{path} has a short record")
                left -= len(part)
                digest.update(part)
                yield row | {
                    "chunk_no": number, "data": part, "payload_bytes": size - left,
                    "running_digest": sha1_text(digest), "is_last": left == 0,
                }
                number += 1
                if left == 0:
                    break
        while more():  # the line ends after the block
            data = b""


def read_chunks(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The chunk table of the listed archives: one row per record and chunk.

    ``payload_bytes`` and ``running_digest`` cover the payload up to and with the chunk. A revisit has one empty
    chunk and the size its HTTP header states. Files are dealt out singly.
    """
    prepare(files)
    tasks = max(1, files.count())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        for batch in batches:
            for uri in batch.path:
                place, path = fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                for row in read_records(place, path):
                    rows.append(row)
                    held += len(row["data"])
                    if held >= 16 * CHUNK or len(rows) >= 4096:
                        yield _frame(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    return files.select("path").repartitionByRange(tasks, "path").mapInPandas(run, CHUNKS)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def archive_pages(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """Write a record per page, read the archives back, and give a row per record from its last chunk.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to. The digest of a response is
    the one computed from the chunks read; a record whose stored digest differs fails the job. A null
    payload is an empty one; null keys and repeated rows each have their record; an empty table gives no
    rows; other columns are ignored.
    """
    files = write_archives(with_roles(pages, key, payload, least))
    last = read_chunks(pages.sparkSession, files).where("is_last")
    computed = F.coalesce("running_digest", "payload_digest")
    sound = F.when(computed == F.col("payload_digest"), computed).otherwise(
        F.raise_error(F.concat(F.lit("damaged record of page "), F.col("page_id").cast("string")))
    )
    return last.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")
