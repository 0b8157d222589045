"""WARC archives: written a file a task, read back in byte ranges.

Writing: payload digests are grouped without the payloads; of equal payloads of at least LEAST bytes
the smallest id is the response and the others become revisits, which carry no payload but its
digest and length. Each task writes one `.warc.gz` with a gzip member per record, under a name of
its own attempt; the manifest, a table, names the files of the attempts that counted.

Reading: files are cut into byte ranges. A task scans its range for gzip magic, takes a candidate as
a record if its beginning inflates to a WARC version line, and owns the records that start inside
its range, reading past the range's end to finish the last. Neither ends of ranges nor stray magic
bytes in compressed data split or lose a record.

Nulls: a null payload is empty; a null id stays null and is the last to become a response. Rows that
repeat the smallest id and its payload are all responses. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST, RANGE, PIECE = 100, 4 << 20, 1 << 18
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def plan(df: DataFrame, id_col: str, payload_col: str, least: int = LEAST) -> DataFrame:
    """digest, size, first, copies: for each payload of at least `least` bytes the smallest id that has it, and how many
    rows do."""
    rows = df.select(F.col(id_col).alias("id"), F.sha2(F.col(payload_col), 256).alias("digest"), F.octet_length(payload_col).cast("long").alias("size"))
    return rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))


def _record(kind: str, key, uri: str | None, digest: str, size: int, refers, payload: bytes | None) -> bytes:
    http = HTTP % size
    block = http + payload if payload is not None else http
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:row:{'' if key is None else key}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {' '.join(uri.split())}"] if uri else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:row:{refers}>"]
    head += [f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(df: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url", least: int = LEAST) -> DataFrame:
    """Writes df's rows below folder, a shared one. Returns the manifest: path, n_bytes, n_records. df is read twice."""
    text = df.select(F.col(id_col).alias("id"), (F.col(uri_col) if uri_col else F.lit(None)).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    shared = plan(text, "id", "payload", least).where("copies > 1").select(F.col("digest").alias("d"), "first")
    rows = text.withColumn("digest", F.sha2("payload", 256))
    # Only rows of shared payloads look for their response; the others keep their place, so payloads aren't shuffled
    # where the shared ones fit in a broadcast, which Spark judges by size.
    rows = rows.join(shared, F.col("digest") == F.col("d"), "left").select("id", "uri", "payload", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n_bytes, n = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
        for b in batches:
            for row in b.to_pylist():
                key, first, payload = row["id"], row["first"], row["payload"]
                revisit = first is not None and first != key
                data = _member(_record("revisit" if revisit else "response", key, row["uri"], row["digest"], len(payload), first, None if revisit else payload))
                if out is None:
                    system, place = common.filesystem(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(place, compression=None)
                out.write(data)
                n_bytes, n = n_bytes + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n_bytes]), pa.array([n])], ["path", "n_bytes", "n_records"])

    return common.table(common.map_batches(rows, run, "path string, n_bytes long, n_records long"), "manifest")


class Source:
    """Bytes of a file from some place on, read in pieces."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, start: int, count: int) -> bytes:
        """Up to count bytes from start."""
        if not (self.at <= start and start + count <= self.at + len(self.data)):
            self.file.seek(start)
            self.at, self.data = start, self.file.read(min(max(count, PIECE), self.size - start))
        return self.data[start - self.at : start - self.at + count]

    def find(self, start: int, end: int) -> int:
        """The first place of MAGIC in [start, end), or -1."""
        while start < end:
            piece = self.get(start, min(PIECE, end - start + len(MAGIC) - 1))
            if (k := piece.find(MAGIC)) >= 0:
                return start + k if start + k < end else -1
            start += max(1, len(piece) - len(MAGIC) + 1)
        return -1


def _inflated(source: Source, start: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of the member that starts there, each with the file position after it once the member has ended (else 0)."""
    z, at = zlib.decompressobj(31), start
    while at < source.size:
        piece = source.get(at, PIECE // 8)
        at += len(piece)
        while piece:
            out = z.decompress(piece, PIECE)
            if z.eof:
                yield out, at - len(z.unused_data)
                return
            yield out, 0
            piece = z.unconsumed_tail
    raise zlib.error("the file ends within a member")


def _read_member(source: Source, start: int, with_payload: bool) -> tuple[dict, int] | None:
    """The record that starts there and the position after it; None if no record starts there."""
    pieces, head = _inflated(source, start), b""
    try:
        for out, end in pieces:  # noqa: B007
            head += out
            if len(head) >= len(VERSION) and not head.startswith(b"WARC/1."):
                return None
            if b"\r\n\r\n" in head or end:
                break
        if not head.startswith(b"WARC/1."):
            return None
        lines, _, block = head.partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")[1:])}
        length = int(fields["content-length"])
        while not end and len(block) < length and b"\r\n\r\n" not in block:
            out, end = next(pieces)
            block += out
        at = block.find(b"\r\n\r\n") + 4 if fields.get("content-type", "").startswith("application/http") else 0
        left, digest, size, kept = length - at, hashlib.sha256(), 0, []
        piece = block[at:]
        while True:
            piece = piece[: left - size]
            digest.update(piece)
            size += len(piece)
            if with_payload:
                kept.append(piece)
            if end:
                break
            piece, end = next(pieces)
    except (zlib.error, KeyError, ValueError, StopIteration):
        return None
    return fields | {"size": size, "digest": digest.hexdigest(), "payload": b"".join(kept) if with_payload else None}, end


def records(source: Source, start: int, end: int, with_payload: bool) -> Iterator[dict]:
    """The records that start in [start, end)."""
    at = start
    while (at := source.find(at, min(end, source.size))) >= 0:
        if found := _read_member(source, at, with_payload):
            yield found[0] | {"offset": at}
            at = found[1]
        else:
            at += 1


_OUT = "path string, offset long, record_type string, record_id string, uri string, payload_bytes long, payload_digest string, refers_to string, payload binary"
_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def read(manifest: DataFrame, with_payload: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """A row for each record of the manifest's files: path, offset, record_type, record_id, uri, payload_bytes and
    payload_digest (of the payload read, or for revisits of the payload they stand for), refers_to, payload (null for
    revisits)."""
    spark = manifest.sparkSession
    ranges = manifest.select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0).cast("long")), F.lit(range_bytes).cast("long"))).alias("start"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges.repartition(tasks, "path", "start")

    def row_id(x: str) -> str | None:
        return x.removeprefix("<urn:row:").removesuffix(">") or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.to_pylist():
                system, place = common.filesystem(part["path"])
                rows, held = [], 0
                with system.open_input_file(place) as file:
                    for r in records(Source(file, part["n_bytes"]), part["start"], part["start"] + range_bytes, with_payload):
                        kind, revisit = r.get("warc-type"), r.get("warc-type") == "revisit"
                        rows.append({
                            "path": part["path"], "offset": r["offset"], "record_type": kind, "record_id": row_id(r.get("warc-record-id", "")), "uri": r.get("warc-target-uri"),
                            "payload_bytes": int(r["x-payload-length"]) if revisit else r["size"], "payload_digest": r["warc-payload-digest"].partition(":")[2] if revisit else r["digest"],
                            "refers_to": row_id(r["warc-refers-to"]) if revisit else None, "payload": None if revisit else r["payload"],
                        })
                        held += r["size"] if with_payload else 0
                        if len(rows) >= 2000 or held > common.BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return common.map_batches(ranges, run, _OUT)


def op5_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write(pages, common.shared_dir(spark) + "/warc")
    return read(manifest, with_payload=False).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND first <> page_id THEN first END AS refers_to
FROM f
"""
