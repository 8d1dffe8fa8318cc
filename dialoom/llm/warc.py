"""WARC archives with a Zstandard dictionary.

Writing: each page becomes a WARC record. Of pages with equal payloads the one with the largest page_id is a
``response`` with the payload, the others ``revisit`` records that refer to it by its record id, target and date. Each file begins
with a ``warcinfo`` record. Each record is
compressed on its own as one Zstandard frame with a dictionary, so records can be read singly; the dictionary, trained
on archived records, stands at the head of each file in a skippable frame (magic 0x184D2A5D), as the WARC Zstandard
specification asks.

The files come from Spark's own text writer, which commits them whole and redoes the tasks of lost executors, on
any file system: it writes the bytes as they are, and its line separator is an empty skippable frame
(``P*M\\x18`` and four zero bytes), which readers of Zstandard pass over. Pages are dealt to files of about
``FILE_BYTES`` of payload by a hash of the payload's digest and page_id. The writer names files ``part-*.txt``; their content is
that of ``.warc.zst`` files.

Reading: each file is one row, its frames are walked from the dictionary on; revisit records take length and digest from
their own headers.

The dictionary is trained on a bounded sample (``SAMPLE_RECORDS`` records of at most ``SAMPLE_BYTES`` each, by hash of
page_id): a codec's parameter, not a result. With too few records for training it is the records' plain text.

Defined cases: null html is an empty payload; empty payloads equal each other; rows that repeat page_id and payload
are each a response if theirs is the largest page_id; a null page_id is smaller than any and a group of nulls alone
has only responses; a null url is written as an empty target; of rows with the same largest page_id the greatest url is referred
to; other columns are not archived, so none clashes. A very long payload is one record and is held whole by one task.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import table_path

FILE_BYTES = 32 << 20
SAMPLE_RECORDS = 1_000
SAMPLE_BYTES = 16 << 10
DICTIONARY_BYTES = 112 << 10
# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVED = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None, url: str, digest: str) -> str:
    """A fixed name for the same page: reruns write the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"


def _target(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def info_record() -> bytes:
    """The warcinfo record that begins a file."""
    block = b"software: dialoom\r\nformat: WARC File Format 1.1\r\n"
    head = [
        "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'warcinfo')}>", f"WARC-Date: {ARCHIVED}",
        "Content-Type: application/warc-fields", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One WARC record. refers_to, refers_url: page_id and url of the response that a revisit stands for."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    url = _target(url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}",
        f"WARC-Date: {ARCHIVED}", f"WARC-Target-URI: {url}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        target = _target(refers_url)
        head += [
            f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, target, digest)}", f"WARC-Refers-To-Target-URI: {target}",
            f"WARC-Refers-To-Date: {ARCHIVED}", f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(headers["content-length"])
    if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return headers, rest[:size]


def train_dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples; any bytes may serve as a dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:] or record(None, None, b"", None)


def frames(data: bytes) -> Iterator[bytes]:
    """Records of one archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive begins with its dictionary")
    held = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    view, at = memoryview(data), 8 + size
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            at += 8 + size
            continue
        reader = zstandard.ZstdDecompressor(dict_data=held).decompressobj()
        out = [reader.decompress(view[at : at + 65536])]
        at += 65536
        while not reader.eof:
            out.append(reader.decompress(view[at : at + 65536]))
            at += 65536
        at = min(at, len(data)) - len(reader.unused_data)
        yield b"".join(out)


def write_archives(pages: DataFrame, path: str) -> str:
    """Writes (page_id, url, html) as .warc.zst content under path; returns path."""
    ship(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    own = own.withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    # Which pages revisit which is found among digests alone; payloads move once, to the file they are written to.
    top = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("top")
    shared = own.groupBy("digest").agg(top, F.count("*").alias("n")).filter("n > 1")
    shared = shared.select("digest", F.col("top.page_id").alias("response"), F.col("top.url").alias("response_url"))
    revisits = own.select("digest", "key", "page_id").join(shared, "digest").filter("NOT page_id <=> response")
    revisits = revisits.select("digest", "key", F.col("response").alias("refers_to"), F.col("response_url").alias("refers_url")).distinct()
    size, count = pages.agg(F.sum(F.octet_length(payload)), F.count("*")).first()
    files = max(1, -(-(size or 0) // FILE_BYTES))
    chosen = own.filter(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) / float(1 << 20) < min(1.0, SAMPLE_RECORDS / max(count, 1)))
    sample = chosen.select("page_id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload")).orderBy("page_id", "payload").limit(2 * SAMPLE_RECORDS)
    samples = [record(r.page_id, r.url, bytes(r.payload), None) for r in sample.collect()]  # bounded: records x bytes
    dictionary = train_dictionary(samples)

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary))
        first = [struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary, writer.compress(info_record())]
        for batch in batches:
            own_frames = first
            first = []
            for page_id, url, body, refers, refers_url in zip(batch.page_id, batch.url, batch.payload, batch.refers_to, batch.refers_url):
                data = record(None if pd.isna(page_id) else int(page_id), url, bytes(body), None if pd.isna(refers) else int(refers), refers_url)
                own_frames.append(writer.compress(data))
            yield pd.DataFrame({"frame": own_frames})

    dealt = own.repartition(files, "digest", "key").join(revisits.repartition(files, "digest", "key"), ["digest", "key"], "left")
    plain = dealt.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    archived = plain.select("page_id", "url", "payload", "refers_to", "refers_url").mapInPandas(compress, "frame binary")
    archived.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html) of every record; html of responses only."""

    ship(spark)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch.content:
                rows = []
                for data in frames(content):
                    headers, block = parse(data)
                    if headers["warc-type"] == "warcinfo":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    revisit = headers["warc-type"] == "revisit"
                    rows.append((
                        int(headers["x-page-id"]) if "x-page-id" in headers else None, headers["warc-target-uri"], length,
                        headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"],
                        int(headers["x-refers-to-page-id"]) if revisit else None, None if revisit else body.decode("utf-8", "surrogatepass"),
                    ))
                    if len(rows) == 256:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("content")
    return files.mapInPandas(unpack, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def _rows(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])
    return frame.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes pages into the shared folder and reads the archives back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, table_path(spark, "warc")))
