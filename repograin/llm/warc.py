"""WARC archives: writing, normalising whole-file gzip, reading back by offset.

An archive whose gzip stream spans the whole file can only be read from its
start. The normaliser inflates such a stream once and writes every record as a
gzip member of its own, with a sidecar index of offsets beside the archive; any
record can then be read alone, and archives can be split among tasks. Payloads
are copied in pieces, so memory does not grow with a file or a record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograin.llm.store import hinted, new_folder, saved

ROLL_BYTES = 64 << 20  # compressed size from which on a task begins another archive
READ_BYTES = 8 << 20  # span of an archive that one task reads back
BROADCAST_ROWS = 200_000
_PIECE = 1 << 20
_GZIP = 31  # zlib's code for the gzip format
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "path string, records bigint"
_INDEX = "path string, offset bigint, length bigint, record_type string, record_id string, payload_digest string"
_RECORD = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _one_line(text: str) -> str:
    """Control characters would break a header line; they are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of another page's payload; a revisit keeps the HTTP head with the full length, not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {_one_line(url)}"] if url is not None else []), f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"] if refers_to is not None else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Named fields by lower-case name."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


class Inflated:
    """The inflated bytes of one gzip stream, or of several in a row, read in pieces."""

    def __init__(self, raw):
        self.raw, self.inflate, self.packed, self.plain = raw, zlib.decompressobj(_GZIP), b"", b""

    def _fill(self) -> bool:
        while True:
            if self.inflate.eof:
                self.packed, self.inflate = self.inflate.unused_data or self.packed, zlib.decompressobj(_GZIP)
            if not self.packed:
                self.packed = self.raw.read(_PIECE)
                if not self.packed:
                    return False
            more = self.inflate.decompress(self.packed, _PIECE)
            self.packed = self.inflate.unconsumed_tail if not self.inflate.eof else b""
            if more:
                self.plain += more
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with the mark; None at the end of the input."""
        while (at := self.plain.find(mark)) < 0:
            if not self._fill():
                if self.plain:
                    raise ValueError("the archive ends inside a record's head")
                return None
        at += len(mark)
        out, self.plain = self.plain[:at], self.plain[at:]
        return out

    def pieces(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.plain and not self._fill():
                raise ValueError("the archive ends inside a record")
            out, self.plain = self.plain[:size], self.plain[size:]
            size -= len(out)
            yield out


def normalise_stream(raw, out) -> Iterator[dict]:
    """Rewrite every record of ``raw`` as a gzip member of ``out``; one index entry for each."""
    plain, offset = Inflated(raw), 0
    while (head := plain.until(b"\r\n\r\n")) is not None:
        named, member = headers(head[:-4]), zlib.compressobj(6, zlib.DEFLATED, _GZIP)
        length = out.write(member.compress(head))
        for piece in plain.pieces(int(named["content-length"]) + 4):
            length += out.write(member.compress(piece))
        length += out.write(member.flush())
        yield {"offset": offset, "length": length, "record_type": named["warc-type"], "record_id": named["warc-record-id"], "payload_digest": named.get("warc-payload-digest", "").removeprefix("sha1:")}
        offset += length


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: of equal payloads of at least that size the page with the largest id is the response.

    Rows that share the largest id of a group are all responses; so are groups without any id.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    same = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = saved(same, "revisits")
    joined = rows.join(hinted(same, same.count(), BROADCAST_ROWS), "sha", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``page_id, url, payload, refers_to`` as whole-file gzip archives under ``folder``; ``path, records`` of each.

    Names are new in every attempt of a task, and only the archives in the
    result count, so a repeated task leaves no records twice.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        out, done = None, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, member, size, count = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, _GZIP), 0, 0
                size += out.write(member.compress(record(page_id, url, payload, refers_to)))
                count += 1
                if size >= ROLL_BYTES:
                    out.write(member.flush())
                    out.close()
                    out = done.append((f"{folder}/{name}", count))
        if out is not None:
            out.write(member.flush())
            out.close()
            done.append((f"{folder}/{name}", count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return saved(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(write, _MANIFEST), "manifest")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite the archives named in ``path``, whatever gzip layout they have, and index their records; each gets a sidecar ``.idx`` of JSON lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = _open(folder)
        target.create_dir(base, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, at = _open(path)
                name = f"{uuid.uuid4().hex}.warc.gz"
                with source.open_input_stream(at, compression=None) as raw, target.open_output_stream(f"{base}/{name}", compression=None) as out, target.open_output_stream(f"{base}/{name}.idx", compression=None) as side:
                    entries = []
                    for entry in normalise_stream(raw, out):
                        side.write(json.dumps(entry).encode() + b"\n")
                        entries.append({"path": f"{folder}/{name}", **entry})
                        if len(entries) == 10_000:
                            yield pa.RecordBatch.from_pylist(entries, _index_schema())
                            entries = []
                    if entries:
                        yield pa.RecordBatch.from_pylist(entries, _index_schema())

    count = max(1, archives.count())
    return saved(archives.select("path").repartition(count, "path").mapInArrow(run, _INDEX), "index")


def _index_schema() -> pa.Schema:
    return pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("payload_digest", pa.string())])


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found.group(1)) if found else None


def parse(data: bytes) -> dict:
    """A record's fields and payload; a revisit has the length of the payload it stands for, and no payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    named = headers(head)
    http, _, payload = rest[: int(named["content-length"])].partition(b"\r\n\r\n")
    kind, digest = named["warc-type"], named["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"{named['warc-record-id']}: the payload has changed")
    return {
        "page_id": _page(named["warc-record-id"]), "url": named.get("warc-target-uri"), "record_type": kind, "payload_digest": digest,
        "payload_bytes": int(headers(http)["content-length"]), "refers_to": _page(named.get("warc-refers-to")), "payload": payload if kind == "response" else None}


def read(index: DataFrame) -> DataFrame:
    """The indexed records, each inflated alone from its own bytes of the archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        held, source = None, None
        for batch in batches:
            rows, size = [], 0
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if path != held:
                    if source is not None:
                        source.close()
                    fs, at = _open(path)
                    held, source = path, fs.open_input_file(at)
                source.seek(offset)
                rows.append(parse(zlib.decompress(source.read(length), _GZIP)))
                size += rows[-1]["payload_bytes"]
                if size >= 16 * _PIECE:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)
        if source is not None:
            source.close()

    spans = index.select("path", "offset", "length", F.floor(F.col("offset") / READ_BYTES).alias("span"))
    number = max(1, spans.select("path", "span").distinct().count())  # stated, so that Spark does not put the small index rows into one task
    spans = spans.repartition(number, "path", "span").sortWithinPartitions("path", "offset")
    return spans.drop("span").mapInArrow(run, _RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages, normalise the archives, read them back by their index; one row per page.

    A null html is an empty payload, a null url has no target line, a null
    page_id comes back as null. Files lie in the shared folder.
    """
    spark = pages.sparkSession
    whole, single = new_folder(spark, "warc"), new_folder(spark, "warc")
    archives = write_archives(with_revisits(pages, least_bytes), whole)
    index = normalise(archives, single)
    done = spark._jvm.org.apache.hadoop.fs.Path(whole)
    done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(done, True)
    return read(index)
