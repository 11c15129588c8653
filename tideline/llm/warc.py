"""WARC archives with a Zstandard dictionary: records compressed one by one, the dictionary in a leading skippable frame.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, built from the archive's first records; every record after it is a
frame of its own, so that an archive can be read as a stream or at a record's
offset. Of pages with equal payloads the one with the smallest page_id is
written as response and the others as revisit records without the payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import new_path, saved, sliced, text_of
from tideline.llm.files import created, opened, own_name

SKIPPABLE, LEVEL = 0x184D2A5D, 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "path string, n_records long, n_bytes long"
#: Record ids hold the page_id in their last 64 bits.
_ID_BASE = 0x7D1E11AE_57A8_4C0D << 64


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_ID_BASE | page_id % (1 << 64))}>" if page_id is not None else "<urn:uuid:00000000-0000-0000-0000-000000000000>"


def page_of(found: str) -> int | None:
    n = uuid.UUID(found.strip("<>").removeprefix("urn:uuid:")).int
    return None if n == 0 else (n & (1 << 63) - 1) - (n & 1 << 63)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """A whole response record, or a revisit record if it refers to another page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = " ".join((url or "").split())
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": uri or f"urn:page:{page_id}",
        "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "WARC-Refers-To-Target-URI": " ".join((refers_url or "").split()) or f"urn:page:{refers_to}"}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary built from records; where they are too few to train one, their own content."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8, steps=1, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _as_dict(data: bytes):
    import zstandard

    trained = data[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes one archive: the first `sample` bytes of records are held to build the dictionary."""

    def __init__(self, path: str, sample: int = 4 << 20, dictionary_bytes: int = 64 << 10):
        self.path, self.sample, self.dictionary_bytes = path, sample, dictionary_bytes
        self.held: list[bytes] = []
        self.held_bytes = self.n_records = self.n_bytes = self.raw = 0
        self.file = self.compressor = None

    def add(self, data: bytes) -> None:
        self.raw += len(data)
        self.n_records += 1
        if self.compressor:
            self._write(self.compressor.compress(data))
        else:
            self.held.append(data)
            self.held_bytes += len(data)
            if self.held_bytes >= self.sample:
                self._begin()

    def _write(self, data: bytes) -> None:
        self.file.write(data)
        self.n_bytes += len(data)

    def _begin(self) -> None:
        import zstandard

        known = dictionary(self.held, self.dictionary_bytes)
        self.file = created(self.path)
        self._write(struct.pack("<II", SKIPPABLE, len(known)) + known)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_as_dict(known), write_checksum=True)
        for data in self.held:
            self._write(self.compressor.compress(data))
        self.held = []

    def close(self) -> tuple[str, int, int]:
        if not self.compressor:
            self._begin()
        self.file.close()
        return self.path, self.n_records, self.n_bytes


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open archive, as a stream."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    reader = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=_as_dict(stream.read(size))).stream_reader(stream, read_across_frames=True), 1 << 20)
    while line := reader.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := reader.readline()) != b"\r\n":
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            head[name] = value.strip()
        yield head, reader.read(int(head["Content-Length"]))
        reader.read(4)


def first_of_equal(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, refers_to, refers_url of each page whose payload (of least_bytes at least) a smaller page_id has too."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html")).where("page_id is not null")
    keys = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "url", F.sha2("html", 256).alias("payload"))
    first = keys.groupBy("payload").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").select("payload", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    return keys.select("page_id", "payload").join(first, "payload").where("page_id <> refers_to").select("page_id", "refers_to", "refers_url").dropDuplicates(["page_id", "refers_to"])


def written(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 256 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page: a row for each archive.

    Null html is an empty payload; a null url gives a urn made of the page_id;
    pages without page_id are always responses; rows that repeat a page_id get
    a record each, of which only those with another page's payload are
    revisits; other columns are not read.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    joined = rows.join(first_of_equal(pages, least_bytes), "page_id", "left").select("page_id", "url", "html", "refers_to", "refers_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done, k = None, [], 0
        for batch in sliced(batches, "html", 8 << 20):
            for page_id, url, html, refers_to, refers_url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "refers_url")), strict=True):
                if archive is None:
                    archive, k = Archive(own_name(folder, "pages", f"-{k:05d}.warc.zst")), k + 1
                archive.add(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, refers_url, date))
                if archive.raw >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        cols = list(zip(*done, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "n_records", "n_bytes"])

    return saved(joined.mapInArrow(write, FILES), "warc-files")


def read_back(files: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each record in the archives."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                out = []
                with opened(path) as f:
                    for head, block in records(f):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and (len(payload), sha1_base32(payload)) != (length, digest):
                            raise ValueError(f"{path}: {head['WARC-Record-ID']} is damaged")
                        out.append({"page_id": page_of(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": page_of(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path").repartition(tasks).mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
