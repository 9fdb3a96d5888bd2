"""Zstandard web archives: one frame per record, with a dictionary in a leading skippable frame.

Writing goes through Spark's text sink, so that any file system that Spark writes to will do and a lost task leaves no half
archive: the rows of a task are raw frames, and the line separator is itself an empty skippable frame. The first row
of each file is the skippable frame with that file's dictionary, trained on the file's first records.

Reading takes the dictionary from the leading frame, decodes one frame per record, and checks the record: version line,
named headers, Content-Length against the block, the payload's length and digest.

Equal payloads from MIN_REVISIT bytes on are stored once: the record with the smallest id is the response, the
others are revisits that name it. Rows that repeat the smallest id are all responses.

Results for odd input: a null payload is empty; a null id is stored as an empty id, is read as null, and is a response only
if no row of the group has an id; null or multi-line targets are escaped; payloads of any length make one record;
empty tables make no records; only the named columns are stored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import bounded_broadcast, counted

#: Fixed values of the formats: magic numbers of skippable frames, of the dictionary frame, of a Zstandard frame.
SKIPPABLE, DICTIONARY, FRAME = 0x184D2A50, 0x184D2A5D, 0xFD2FB528
#: An empty skippable frame; all its bytes are ASCII, so it can stand as a line separator.
SEPARATOR = SKIPPABLE.to_bytes(4, "little") + bytes(4)
MIN_REVISIT = 100          # bytes of a payload from which an equal one is a revisit
DICTIONARY_SAMPLE = 400    # first records of a file that train its dictionary
DICTIONARY_BYTES = 16_384
PIECE = 16_384             # bytes of a frame fed to the decoder at once
BROADCAST_ROWS = 100_000   # repeated payloads are broadcast up to this count


class DamagedArchive(ValueError):
    pass


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, payload: bytes, size: int, digest: str) -> bytes:
    """One record: version line, headers, blank line, block, two line ends. A revisit has an empty block."""
    block = payload if kind == "response" else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one decoded record; raises DamagedArchive when a header or a length is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != b"WARC/1.1":
        raise DamagedArchive("no version line or no end of the headers")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(": ")
        if not colon or name.lower() in fields:
            raise DamagedArchive(f"bad header {line[:60]!r}")
        fields[name.lower()] = value
    missing = {"warc-type", "warc-record-id", "content-length", "warc-payload-digest", "warc-payload-length"} - set(fields)
    if missing or fields["warc-type"] not in ("response", "revisit"):
        raise DamagedArchive(f"missing {sorted(missing)} or type {fields.get('warc-type')}")
    if not fields["content-length"].isdigit() or len(rest) != (size := int(fields["content-length"])) + 4 or rest[size:] != b"\r\n\r\n":
        raise DamagedArchive("Content-Length does not fit the block")
    payload, digest = rest[:size], fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response":
        if int(fields["warc-payload-length"]) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise DamagedArchive("the payload does not fit its length or digest")
    elif size or "warc-refers-to" not in fields:
        raise DamagedArchive("a revisit with a block, or without its response")
    own = fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
    other = fields.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
    return {"page_id": int(own) if own else None, "url": fields.get("warc-target-uri"), "payload": payload, "payload_bytes": int(fields["warc-payload-length"]),
            "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": int(other) if other else None}


def frames(rows: Iterator[bytes]) -> Iterator[bytes]:
    """The dictionary frame, then a compressed frame for each record. Only the sample is held."""
    import zstandard

    sample = []
    for raw in rows:
        sample.append(raw)
        if len(sample) == DICTIONARY_SAMPLE:
            break
    if not sample:
        return
    try:
        words = zstandard.train_dictionary(DICTIONARY_BYTES, [s[:65_536] for s in sample])
    except zstandard.ZstdError:  # too little to learn from: the plain bytes of the sample serve as they are
        words = zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    body = words.as_bytes()
    yield DICTIONARY.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body
    packer = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True, write_content_size=True)
    for raw in sample:
        yield packer.compress(raw)
    for raw in rows:
        yield packer.compress(raw)


def read_archive(raw: bytes | memoryview) -> Iterator[dict]:
    """Records of one archive, decoded frame by frame. A frame is fed in pieces, so what lies behind it is never copied."""
    import zstandard

    if not len(raw):  # a task without rows
        return
    view = memoryview(raw)
    if int.from_bytes(view[:4], "little") != DICTIONARY:
        raise DamagedArchive("no leading dictionary frame")
    size = int.from_bytes(view[4:8], "little")
    body = bytes(view[8:8 + size])
    if len(body) != size:
        raise DamagedArchive("the dictionary frame is cut off")
    kind = zstandard.DICT_TYPE_FULLDICT if body[:4] == (0xEC30A437).to_bytes(4, "little") else zstandard.DICT_TYPE_RAWCONTENT
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=kind))
    at = 8 + size
    while at < len(view):
        magic = int.from_bytes(view[at:at + 4], "little")
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            at += 8 + int.from_bytes(view[at + 4:at + 8], "little")
            if at > len(view):
                raise DamagedArchive("a skippable frame is cut off")
            continue
        if magic != FRAME:
            raise DamagedArchive(f"no frame at byte {at}")
        one, text, start = opener.decompressobj(), [], at
        while not one.eof:
            if at >= len(view):
                raise DamagedArchive("a frame is cut off")
            piece = view[at:at + PIECE]
            try:
                text.append(one.decompress(piece))
            except zstandard.ZstdError as error:
                raise DamagedArchive(f"frame at byte {start}: {error}") from error
            at += len(piece)
        at -= len(one.unused_data)
        yield parse_record(b"".join(text))


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to): refers_to is set for revisits. The payloads are not shuffled while
    the repeated digests stay under BROADCAST_ROWS; beyond it Spark joins by digest and splits hot ones."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"))
    again = (rows.where(F.col("size") >= MIN_REVISIT).groupBy(F.col("digest").alias("d_digest"))
             .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    again, n = counted(again)
    joined = rows.join(bounded_broadcast(again, n, BROADCAST_ROWS), rows["digest"] == again["d_digest"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "size", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_archives(planned: DataFrame, path: str) -> None:
    """One archive per task. Revisit payloads are dropped before Python sees them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[bytes]:
            for batch in batches:
                for x in batch.to_pylist():
                    kind = "response" if x["refers_to"] is None else "revisit"
                    yield record(x["page_id"], x["url"], kind, x["refers_to"], (x["payload"] or "").encode(), x["size"], x["digest"])

        held, size = [], 0
        for frame in frames(rows()):
            held.append(frame)
            size += len(frame)
            if size > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    slim = planned.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    (slim.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.mode("overwrite").option("lineSep", SEPARATOR.decode()).option("compression", "none").text(path))


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of all archives below path. An archive is one task's work, so its size is bounded by the writer's split."""
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    if not with_payload:
        kinds.pop(2)
        names.remove("payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                held, size = [], 0
                for x in read_archive(memoryview(raw.as_buffer())):
                    held.append(x)
                    size += len(x["payload"])
                    if not with_payload:
                        x["payload"] = b""
                    if len(held) == 2_000 or size > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], k) for n, k in zip(names, kinds, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], k) for n, k in zip(names, kinds, strict=True)], names=names)

    schema = "page_id bigint, url string" + ", payload binary" * with_payload + ", payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, schema)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as archives and read them back. Without a path they go to the shared checkpoint folder."""
    spark = pages.sparkSession
    if path is None:
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext.getCheckpointDir()}/archives-{uuid.uuid4().hex}"
    write_archives(plan_records(pages), path)
    return read_archives(spark, path)
