"""WARC archives: write whole-file gzip streams, normalise them to one member a record with an offset index, read back.

All files lie in a shared folder and get names of their own for each task attempt; a row names the file that its attempt
wrote. A repeated attempt therefore never disturbs what an earlier one returned.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import delete, map_batches, shared_dir, stored

GZIP, LEVEL, READ = 31, 4, 1 << 20


def open_fs(uri: str):
    """Filesystem and path of a URI (a bare path is local)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, length: int, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: response with its payload, or (refers_to) revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:] if line)}


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of one or more members."""
    unzip, fed = zlib.decompressobj(GZIP), False
    for data in chunks:
        while data:
            fed = True
            yield unzip.decompress(data, READ)
            while unzip.unconsumed_tail:
                yield unzip.decompress(unzip.unconsumed_tail, READ)
            data = unzip.unused_data
            if unzip.eof:
                unzip, fed = zlib.decompressobj(GZIP), False
    if fed:
        raise ValueError("the gzip stream is cut off")


def split_records(content: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and bytes of each record of an inflated archive; a record at a time is held."""
    held = bytearray()
    for data in content:
        held += data
        while (at := held.find(b"\r\n\r\n")) >= 0:
            head = parse_head(bytes(held[:at]))
            end = at + 4 + int(head["content-length"]) + 4
            if len(held) < end:
                break
            yield head, bytes(held[:end])
            del held[:end]
    if held:
        raise ValueError("the archive ends within a record")


def members(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return z.compress(raw) + z.flush()


def normalise_file(source: str, folder: str) -> tuple[str, str, int]:
    """Inflate source once as a stream, write each record as its own gzip member, and a sidecar index of JSON lines."""
    src, path = open_fs(source)
    out, base = open_fs(folder)
    name = uuid.uuid4().hex
    offset = n = 0
    with src.open_input_stream(path, compression=None) as f, out.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as g, out.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
        for head, raw in split_records(inflate(iter(lambda: f.read(READ), b""))):
            packed = members(raw)
            g.write(packed)
            index.write((json.dumps({"offset": offset, "length": len(packed), "id": head["warc-record-id"], "type": head["warc-type"], "digest": head["warc-payload-digest"]}) + "\n").encode())
            offset, n = offset + len(packed), n + 1
    return f"{folder}/{name}.warc.gz", f"{folder}/{name}.idx", n


def read_member(packed: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one member."""
    raw = zlib.decompress(packed, GZIP)
    at = raw.index(b"\r\n\r\n")
    head = parse_head(raw[:at])
    block = raw[at + 4 : at + 4 + int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return head, {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, payload


def lines_of(f) -> Iterator[bytes]:
    held = b""
    while data := f.read(READ):
        *lines, held = (held + data).split(b"\n")
        yield from lines
    if held:
        yield held


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_leaders(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """page_id, url, payload (null for revisits), digest, length, refers_to. Only (digest, id) is aggregated; a payload
    that many pages share meets its leader in a join that Spark may split, and revisits drop theirs."""
    data = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), data.alias("payload")).select("*", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("length"))
    leaders = rows.where(F.col("length") >= min_bytes).groupBy(F.col("sha").alias("leader_sha")).agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    joined = rows.join(leaders, (F.col("sha") == F.col("leader_sha")) & (F.col("length") >= min_bytes), "left")
    refers = F.when(F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader")), F.col("leader"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "sha", "length", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, roll_bytes: int = 256 << 20) -> DataFrame:
    """Write each partition of pages as whole-file gzip streams of about roll_bytes content; return file, n_records.

    Of pages with equal payloads of at least min_bytes the one with the largest id is the response, the others revisit it;
    rows that repeat this id are responses too. Null payload: empty. Null url: no target header. Null id: a record without
    number, never a leader unless all its copies have none (then all are responses). No rows, no files.
    """

    def run(batches):
        out, base = open_fs(folder)
        out.create_dir(base, recursive=True)
        f = z = name = None
        size = n = 0
        done = []
        for batch in batches:
            for page_id, url, payload, sha, length, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha", "length", "refers_to")), strict=True):
                if f is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    f, z, size, n = out.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0, 0
                raw = record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha)).decode(), length, refers)
                f.write(z.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= roll_bytes:
                    f.write(z.flush())
                    f.close()
                    done.append((f"{folder}/{name}", n))
                    f = None
        if f is not None:
            f.write(z.flush())
            f.close()
            done.append((f"{folder}/{name}", n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["file", "n_records"])

    return map_batches(with_leaders(pages, id_col, url_col, payload_col, min_bytes), run, "file string, n_records long")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Normalise each archive named in files.file; return warc, idx, n_records. One file is streamed at a time."""

    def run(batches):
        out, base = open_fs(folder)
        out.create_dir(base, recursive=True)
        for batch in batches:
            got = [normalise_file(x, folder) for x in batch.column("file").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int64())], names=["warc", "idx", "n_records"])

    return map_batches(files.select("file"), run, "warc string, idx string, n_records long")


def read_archives(files: DataFrame) -> DataFrame:
    """One row a record of the normalised archives (warc, idx), each opened at its offset from the index and checked
    against its digest: page_id, url, payload_bytes, payload_digest, record_type, refers_to, offset, length."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "offset", "length"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def number(uri: str | None) -> int | None:
        return int(x) if uri and (x := uri.removeprefix("<urn:page:").removesuffix(">")) else None

    def run(batches):
        for batch in batches:
            for warc, idx in zip(batch.column("warc").to_pylist(), batch.column("idx").to_pylist(), strict=True):
                (a, warc_path), (b, idx_path) = open_fs(warc), open_fs(idx)
                with a.open_input_file(warc_path) as f, b.open_input_stream(idx_path, compression=None) as g:
                    rows = []
                    for line in lines_of(g):
                        at = json.loads(line)
                        f.seek(at["offset"])
                        head, http, payload = read_member(f.read(at["length"]))
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response" and base32_sha1(payload) != digest:
                            raise ValueError(f"{warc}: digest differs at offset {at['offset']}")
                        rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), int(http["content-length"]), digest, head["warc-type"], number(head.get("warc-refers-to")), at["offset"], at["length"]))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return map_batches(files.select("warc", "idx"), run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long")


def archive_round_trip(pages: DataFrame, folder: str | None = None, keep_raw: bool = False, **columns) -> DataFrame:
    """Write, normalise and read back; the files stay under folder (the shared folder by default) for other readers. folder/manifest, a Parquet
    table (warc, idx, n_records), names the normalised archives that count; others are left over from attempts that failed or were repeated.
    The whole-file streams are deleted once all are normalised."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    raw = stored(write_archives(pages, f"{folder}/raw", **columns), "warc-raw")
    lanes = max(1, spark.sparkContext.defaultParallelism)
    normal = normalise(raw.repartition(4 * lanes, "file"), f"{folder}/normal")
    normal.write.parquet(f"{folder}/manifest")
    if not keep_raw:
        delete(spark, f"{folder}/raw")
    return read_archives(spark.read.schema(normal.schema).parquet(f"{folder}/manifest").repartition(4 * lanes, "warc"))
