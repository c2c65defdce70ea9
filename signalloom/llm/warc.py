"""WARC archives of pages, each record a Zstandard frame under the archive's dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary,
built from the archive's own first records (long ones in slices); every record after it is
one frame, so it can be read alone at its offset, and reading tasks share an archive. Tasks write archives straight to the shared folder,
a new one after `most_bytes`; only the manifest goes through Spark. File names hold
the attempt, so a task that is run again never touches an archive of the manifest.

Of records with equal payloads of at least `min_bytes`, the one with the smallest
page_id is a response, the others are revisits that name it.

Defined results: null html is an empty payload, a null url is left out, line breaks in
urls are percent-encoded. Null page_ids are archived without one, as responses only
if no page with an id has the payload. Rows that repeat the smallest page_id are all
responses, and rows that repeat page_id, url and payload have one record id. Only an
archive with less than `LEAST_SAMPLE` bytes of records goes without a dictionary. An
empty table gives no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import cut, scratch_path

MAGIC = 0x184D2A5D
#: Bytes of the first records that the dictionary of an archive is built from, and its most bytes.
SAMPLE_BYTES, DICT_BYTES = 2 << 20, 32 << 10
#: Bytes of records that make a dictionary worth its place, most bytes of a sample, and bytes of an archive that one task reads.
LEAST_SAMPLE, SLICE, READ_BYTES = 8 << 10, 16 << 10, 16 << 20
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
MANIFEST = "page_id long, record_type string, file string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(kind: str, page_id: int | None, digest: bytes, url: str | None = None) -> str:
    """A response's id follows from what a revisit knows of it."""
    told = f"{kind}/{page_id}/{base32(digest)}" + (f"/{url}" if kind == "revisit" else "")
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, told)}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit holds no payload."""
    kind = "response" if refers_to is None else "revisit"
    block = HTTP % len(payload) + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(kind, page_id, digest, url)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else "WARC-Target-URI: " + url)
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id('response', refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32(digest)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and (len(payload) != int(fields["X-Payload-Length"]) or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError("a payload does not fit its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_bytes": int(fields["X-Payload-Length"]),
            "payload_digest": digest, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload}


def build_dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary from slices of records, or nothing where they are too few bytes for one."""
    import zstandard

    samples, held = [], 0
    for r in records:
        for k in range(0, len(r), SLICE):
            if held < SAMPLE_BYTES:
                samples.append(r[k : k + SLICE])
                held += len(samples[-1])
    if held < LEAST_SAMPLE:
        return b""
    if len(samples) < 8:  # the builder wants some samples, however short
        samples = [x[k : k + held // 16] for x in samples for k in range(0, len(x), held // 16)]
    for segment in (512, 64):  # long segments suit pages, short ones suit a few short records
        try:
            return zstandard.train_dictionary(min(DICT_BYTES, held // 8), samples, k=segment, d=8).as_bytes()
        except zstandard.ZstdError:
            continue
    return b""


class _Archive:
    """One archive: holds the first records until the dictionary is built, then writes."""

    def __init__(self, filesystem, folder: str, name: str, level: int):
        self.name, self.level, self.held, self.waiting, self.at, self.raw = name, level, 0, [], 0, 0
        self.out, self.compressor = filesystem.open_output_stream(f"{folder}/{name}", compression=None), None

    def add(self, key: tuple, record: bytes) -> list[tuple]:
        self.raw += len(record)
        if self.compressor is not None:
            return [self._write(key, record)]
        self.waiting.append((key, record))
        self.held += len(record)
        return self.begin() if self.held >= SAMPLE_BYTES else []

    def begin(self) -> list[tuple]:
        import zstandard

        made = build_dictionary([r for _, r in self.waiting])
        if made:
            self.at += self.out.write(struct.pack("<II", MAGIC, len(made)) + made)
        options = {"dict_data": zstandard.ZstdCompressionDict(made)} if made else {}
        self.compressor = zstandard.ZstdCompressor(level=self.level, write_checksum=True, write_content_size=True, **options)
        waiting, self.waiting = self.waiting, []
        return [self._write(key, record) for key, record in waiting]

    def _write(self, key: tuple, record: bytes) -> tuple:
        frame = self.compressor.compress(record)
        self.out.write(frame)
        self.at += len(frame)
        return (*key, self.name, self.at - len(frame), len(frame))

    def close(self) -> list[tuple]:
        rest = self.begin() if self.compressor is None else []
        self.out.close()
        return rest


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def _writer(folder: str, level: int, most_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, archive, made = TaskContext.get(), None, 0
        filesystem, path = _open(folder)
        filesystem.create_dir(path, recursive=True)
        names = [f.split()[0] for f in MANIFEST.split(", ")]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names)

        for batch in batches:
            found = []
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to")]
            for k in range(batch.num_rows):
                page_id, url, payload, refers_to = (c[k].as_py() for c in columns)
                if archive is None:
                    archive, made = _Archive(filesystem, path, f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{made:04d}.warc.zst", level), made + 1
                key = (page_id, "response" if refers_to is None else "revisit")
                found += archive.add(key, record_bytes(page_id, url, payload, hashlib.sha1(payload).digest(), refers_to))
                if archive.raw >= most_bytes:
                    found, archive = found + archive.close(), None
            yield rows(found)
        if archive is not None:
            yield rows(archive.close())

    return write


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, level: int = 3, most_bytes: int = 256 << 20) -> tuple[str, DataFrame]:
    """Archive `pages` (page_id, url, html); returns the folder and the manifest, a row per record."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("bytes", F.octet_length("payload"))
    firsts = rows.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = cut(firsts.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "firsts")
    rows = rows.join(firsts, "digest", "left")
    rows = rows.select("page_id", "url", "payload", F.when((F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return folder, cut(rows.mapInArrow(_writer(folder, level, most_bytes), MANIFEST), "manifest")


def _dictionary(stream) -> bytes:
    """What the skippable frame at the start of an archive holds, if there is one."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != MAGIC:
        return b""
    return stream.read(struct.unpack("<I", head[4:8])[0])


def read_frames(stream, chunk: int = 1 << 20, start: int | None = None, stop: int | None = None) -> Iterator[bytes]:
    """The records of an archive from offset `start` to `stop`, one after the other, with no more of it in memory than one."""
    import zstandard

    stream.seek(0)
    made = _dictionary(stream)
    options = {"dict_data": zstandard.ZstdCompressionDict(made)} if made else {}
    decompressor = zstandard.ZstdDecompressor(**options)
    at = start if start is not None else 8 + len(made) if made else 0
    stream.seek(at)
    data = b""
    while (stop is None or at < stop) and (data := data or stream.read(chunk)):
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not data and not (data := stream.read(chunk)):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(data))
            rest = frame.unused_data if frame.eof else b""
            at, data = at + len(data) - len(rest), rest
        yield b"".join(parts)


def _reader(folder: str, payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = _open(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop")), strict=True):
                with filesystem.open_input_file(f"{path}/{name}") as stream:
                    found, held = [], 0
                    for data in read_frames(stream, start=start, stop=stop):
                        record = parse_record(data)
                        held += len(record["payload"] or b"")
                        found.append(record if payloads else record | {"payload": None})
                        if held >= 8 << 20 or len(found) >= 10_000:
                            yield pa.RecordBatch.from_pylist(found, schema)
                            found, held = [], 0
                    yield pa.RecordBatch.from_pylist(found, schema)

    return read


def read_archives(folder: str, manifest: DataFrame, payloads: bool = True, read_bytes: int = READ_BYTES, most_tasks: int = 10_000) -> DataFrame:
    """The records of the archives that `manifest` names, read from the archives; every payload is held against its digest.

    Archives are dealt in ranges of whole records that begin within `read_bytes` of each other, one task a range up to `most_tasks`.
    """
    ends = F.col("offset") + F.col("length")
    ranges = manifest.groupBy("file", F.floor(F.col("offset") / read_bytes).alias("cell")).agg(F.min("offset").alias("start"), F.max(ends).alias("stop"))
    ranges = cut(ranges.select("file", "start", "stop"), "ranges")
    return ranges.repartition(max(1, min(ranges.count(), most_tasks))).mapInArrow(_reader(folder, payloads), RECORDS)
