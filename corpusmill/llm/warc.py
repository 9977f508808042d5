"""Operator 10: WARC archives, a gzip normaliser and an offset index.

* :func:`write_archives` writes one record per row into whole-file gzip
  streams, a new archive every ``roll_bytes`` of payload.  Among records with
  equal payloads of at least ``min_revisit`` bytes the one with the largest id
  is the response; the others are revisits that carry no payload.
* :func:`normalise` inflates each archive's stream once, front to back, and
  rewrites every record as a gzip member of its own, with a sidecar index
  (JSON lines: archive, offset, length, type).  It accepts any mix of members
  and records, so an archive that is normal already comes out the same.
* :func:`read_records` reads index entries and inflates just their members.

Files lie under a folder that all executors share (``spark.checkpoint.dir``
unless another is given) and are reached through pyarrow's file systems.
Each file is written under a temporary name and moved into place, so a task
that runs twice leaves one whole file.  A task holds one record at a time.
Equal payloads are found by digest: counts are pre-aggregated in each task,
and only digests that repeat are joined back.

Defined cases: a null html is an empty payload; a null url is an empty target;
control characters in a url are percent-encoded; rows with the same payload
and the same, largest id are all responses; null ids lose against any id, and
if all are null all are responses; an empty table writes nothing and reads
back as an empty table.  Only the named columns are read.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import text_of
from corpusmill.session import checkpoint_dir, materialize

# Fixed values of the WARC format.
VERSION, END = b"WARC/1.0", b"\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

INDEX = "archive string, offset long, length long, type string"
RECORD = ("id long, url string, type string, refers_to long, payload_bytes long, "
          "payload_digest string, payload binary")


def _store(uri: str):
    """(file system, path) of a folder or file name."""
    from pyarrow import fs
    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


class _Writer:
    """Bytes to a temporary name, moved into place on close."""

    def __init__(self, uri: str):
        self.fs, self.path = _store(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.size = self.fs.open_output_stream(self.temp), 0

    def write(self, data: bytes):
        self.out.write(data)
        self.size += len(data)

    def close(self):
        self.out.close()
        self.fs.move(self.temp, self.path)


def record_bytes(rid, url: str | None, payload: bytes, size: int, digest: str, refers_to=None) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC-Type: " + ("revisit" if revisit else "response"), f"WARC-Record-ID: <urn:page:{rid}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return VERSION + END + "\r\n".join(head).encode() + END + END + block + END + END


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(END + END)
    h = headers(head)
    block = rest[:int(h["content-length"])]
    http, _, payload = block.partition(END + END)

    def number(x):
        m = re.fullmatch(r"<urn:page:(-?\d+)>", x or "")
        return int(m[1]) if m else None

    return {"id": number(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "type": h["warc-type"],
            "refers_to": number(h.get("warc-refers-to")),
            "payload_bytes": int(headers(END + http).get("content-length", len(payload))),
            "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"),
            "payload": None if h["warc-type"] == "revisit" else payload}


def split_records(chunks):
    """Whole records from an iterator of inflated chunks."""
    buf, need = bytearray(), None
    for c in chunks:
        buf += c
        while True:
            if need is None:
                at = buf.find(END + END)
                if at < 0:
                    break
                need = at + 4 + int(headers(bytes(buf[:at]))["content-length"]) + 4
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = None
    if buf.strip():
        raise ValueError("truncated archive")


def inflate(stream, size: int = 1 << 20):
    """Inflated chunks of a gzip stream of one or more members."""
    z, fed = zlib.decompressobj(31), False
    while data := stream.read(size):
        while data:
            fed = True
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z, fed = zlib.decompressobj(31), False
    if fed and not z.eof:
        raise ValueError("truncated archive")


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _folder(spark: SparkSession, folder: str | None) -> str:
    uri = folder or f"{checkpoint_dir(spark).rstrip('/')}/corpusmill-warc-{uuid.uuid4().hex}"
    fs, path = _store(uri)
    fs.create_dir(path, recursive=True)
    return uri


def revisits(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html",
             min_revisit: int = 1000) -> DataFrame:
    """id, url, payload text, size, digest and refers_to (null: a response)."""
    p = text_of(F.col(html))
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), p.alias("payload"),
                        F.octet_length(p).cast("long").alias("size"), F.sha1(p.cast("binary")).alias("digest"))
    first = materialize(base.filter(F.col("size") >= min_revisit).groupBy("digest")
                        .agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
                        .filter("n > 1").select("digest", "first"), "repeated-payloads")
    return base.join(first, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def write_archives(records: DataFrame, folder: str, roll_bytes: int = 32 << 20) -> DataFrame:
    """Writes whole-file gzip archives; one row per archive: archive, records."""
    def write(batches):
        part, seq, out, z, raw, n = TaskContext.get().partitionId(), 0, None, None, 0, 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if out is None:
                    name = f"{folder}/part-{part:06d}-{seq:05d}.warc.gz"
                    out, z, raw, n = _Writer(name), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                data = record_bytes(r.id, r.url, r.payload.encode(), int(r.size), r.digest, r.refers_to)
                out.write(z.compress(data))
                raw, n = raw + len(data), n + 1
                if raw >= roll_bytes:
                    out.write(z.flush())
                    out.close()
                    yield pd.DataFrame({"archive": [name], "records": [n]})
                    out, seq = None, seq + 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pd.DataFrame({"archive": [name], "records": [n]})

    import pandas as pd
    # ids as text: pandas has no null in a column of plain longs
    rows = records.select(F.col("id").cast("string").alias("id"), "url", "payload", "size", "digest",
                          F.col("refers_to").cast("string").alias("refers_to"))
    return rows.mapInPandas(write, "archive string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive (column ``archive``) with one member per record;
    one row per archive: archive, index, records."""
    def run(batches):
        for pdf in batches:
            for name in pdf["archive"]:
                fs, path = _store(name)
                stem = f"{folder}/{posixpath.basename(path).removesuffix('.warc.gz')}"
                out, idx, n = _Writer(stem + ".warc.gz"), _Writer(stem + ".idx"), 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for rec in split_records(inflate(stream)):
                        member = _member(rec)
                        kind = headers(rec.partition(END + END)[0])["warc-type"]
                        idx.write((json.dumps({"archive": stem + ".warc.gz", "offset": out.size,
                                               "length": len(member), "type": kind}) + "\n").encode())
                        out.write(member)
                        n += 1
                out.close()
                idx.close()
                yield pd.DataFrame({"archive": [stem + ".warc.gz"], "index": [stem + ".idx"], "records": [n]})

    import pandas as pd
    return archives.select("archive").mapInPandas(run, "archive string, index string, records long")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(folder)


def read_records(entries: DataFrame) -> DataFrame:
    """The records behind index entries, each from its own member."""
    def run(batches):
        for pdf in batches:
            out = []
            for name, part in pdf.sort_values(["archive", "offset"]).groupby("archive", sort=False):
                fs, path = _store(name)
                with fs.open_input_file(path) as f:
                    for off, length in zip(part["offset"], part["length"], strict=True):
                        f.seek(off)
                        out.append(parse_record(zlib.decompress(f.read(length), 31)))
                        if len(out) >= 500:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    def arrow(batches):
        yield from run(b.to_pandas() for b in batches)

    import pyarrow as pa
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    return entries.select("archive", "offset", "length").mapInArrow(arrow, RECORD)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html",
                  folder: str | None = None, min_revisit: int = 1000, roll_bytes: int = 32 << 20) -> DataFrame:
    """Write, normalise and read back: the records of the archives."""
    spark = pages.sparkSession
    raw, normal = _folder(spark, folder and f"{folder}/raw"), _folder(spark, folder and f"{folder}/normal")
    written = materialize(write_archives(revisits(pages, id_col, url, html, min_revisit), raw, roll_bytes), "archives")
    n = written.count()
    if not n:
        return spark.createDataFrame([], RECORD)
    done = materialize(normalise(written.repartition(n, "archive"), normal), "normalised")
    assert done.agg(F.sum("records")).first()[0] == written.agg(F.sum("records")).first()[0]
    return read_records(read_index(spark, normal))
