"""WARC archives of Zstandard frames: one frame per record, the dictionary in front.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself compressed or not; then each record is one frame.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwarden.llm.common import each_batch, prepared, stored
from fieldwarden.session import shared_dir

MIN_REVISIT = 1000  # bytes from which an equal payload is only referred to
SAMPLES = 2000  # payloads the dictionary is trained on
SAMPLE_BYTES = 8192  # of each at most
DICTIONARY = 65536
LEVEL = 3

# ---- Fixed values: the formats' magic numbers --------------------------------
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528
RAW_DICTIONARY = 0xEC30A437

VERSION = b"WARC/1.1"
FEED = 0x0A


class WarcError(ValueError):
    """An archive that breaks the format."""


# ---- frames ------------------------------------------------------------------


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame ends that begins at ``at``, by its block headers."""
    try:
        descriptor = data[at + 4]
        single = descriptor >> 5 & 1
        size = descriptor >> 6
        at += 5 + (not single) + (0, 1, 2, 4)[descriptor & 3] + ((single, 2, 4, 8)[size])
        last = 0
        while not last:
            head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
            last, kind, length = head & 1, head >> 1 & 3, head >> 3
            if kind == 3:
                raise WarcError("reserved block type")
            at += 3 + (1 if kind == 1 else length)
        at += 4 * (descriptor >> 2 & 1)
    except IndexError:
        raise WarcError("frame is cut off") from None
    if at > len(data):
        raise WarcError("frame is cut off")
    return at


def frames(data: memoryview):
    """``magic, content`` of each frame; the content of a skippable frame is what it holds."""
    at = 0
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError("frame is cut off")
        magic, length = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            end = at + 8 + length
            if end > len(data):
                raise WarcError("skippable frame is cut off")
            yield magic, data[at + 8 : end]
        elif magic == FRAME:
            end = frame_end(data, at)
            yield magic, data[at:end]
        else:
            raise WarcError(f"no frame at byte {at}")
        at = end


def read_dictionary(content: memoryview) -> bytes:
    """The dictionary of a leading frame, which may be compressed."""
    magic = struct.unpack_from("<I", content)[0] if len(content) >= 4 else 0
    if magic == FRAME:
        return zstandard.ZstdDecompressor().decompress(bytes(content))
    if magic == RAW_DICTIONARY:
        return bytes(content)
    raise WarcError("the leading frame holds no dictionary")


# ---- records -----------------------------------------------------------------


def header(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}".encode()]
    lines += [f"{k}: {v}".encode() for k, v in fields]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def page_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A response, or a revisit whose block has the HTTP headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Record-ID", record_id(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        # line breaks and other control bytes cannot stand in a header
        clean = "".join(c if c.isprintable() and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        fields.append(("WARC-Target-URI", clean))
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is None:
        return header("response", fields, http + payload)
    fields += [
        ("WARC-Refers-To", record_id(refers_to)),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
    ]
    return header("revisit", fields, http)


def parse_record(data: bytes) -> dict:
    """Fields of one record; headers, lengths and the digest of the payload are checked."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/1."):
        raise WarcError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"header line {line!r}")
        fields[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(fields)
    if missing:
        raise WarcError(f"no {sorted(missing)[0]}")
    if not fields["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, {length} announced")
    block = rest[:length]
    kind = fields["warc-type"]
    record = {"type": kind, "id": fields["warc-record-id"], "uri": fields.get("warc-target-uri"), "payload": None}
    record |= {"bytes": None, "digest": None, "refers_to": fields.get("warc-refers-to")}
    if not fields.get("content-type", "").startswith("application/http"):
        return record
    http, found, payload = block.partition(b"\r\n\r\n")
    sizes = [x.split(b":", 1)[1] for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not found or not http.startswith(b"HTTP/") or len(sizes) != 1 or not sizes[0].strip().isdigit():
        raise WarcError("no HTTP header")
    record["bytes"] = int(sizes[0])
    record["digest"] = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if len(payload) != record["bytes"]:
            raise WarcError(f"payload of {len(payload)} bytes, {record['bytes']} announced")
        if hashlib.sha1(payload).hexdigest() != record["digest"]:
            raise WarcError("payload does not match its digest")
        record["payload"] = payload
    elif kind == "revisit" and (payload or not record["refers_to"]):
        raise WarcError("a revisit refers to its payload")
    return record


def read_archive(data: bytes):
    """All records of one file, in order."""
    unpack = zstandard.ZstdDecompressor()
    for number, (magic, content) in enumerate(frames(memoryview(data))):
        if magic == DICTIONARY_FRAME:
            if number:
                raise WarcError("a dictionary that is not in front")
            unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(read_dictionary(content)))
        elif magic == FRAME:
            try:
                with unpack.stream_reader(content) as stream:
                    record = stream.read()
            except zstandard.ZstdError as error:
                raise WarcError(str(error)) from None
            announced = zstandard.frame_content_size(content)
            if announced not in (-1, len(record)):
                raise WarcError(f"frame of {len(record)} bytes, {announced} announced")
            yield parse_record(record)


# ---- Spark jobs --------------------------------------------------------------


def train_dictionary(pages: DataFrame, samples: int = SAMPLES, each: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from the first bytes of some payloads; empty if they are too few.

    Rows are drawn by a hash at a rate that leaves about ``samples``, so no task
    sends more than its share and at most ``2 * samples * each`` characters come
    to the driver.
    """
    space = 1 << 40
    share = min(space, space * samples // max(pages.count(), 1))
    place = F.xxhash64("page_id", "url")
    drawn = pages.filter((F.length("html") > 0) & (F.pmod(place, F.lit(space)) < share))
    html = drawn.select(F.substring("html", 1, each).alias("html"), place.alias("place"))
    rows = html.orderBy("place", "html").limit(2 * samples).collect()
    texts = [r.html.encode() for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY, texts).as_bytes() if len(texts) >= 16 else b""
    except zstandard.ZstdError:  # too little text
        return b""


def with_originals(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, html, refers_to``: the page whose payload an equal one is referred to.

    That is the largest page_id with the payload; rows of that id stay whole, as
    do payloads under ``least`` bytes. Null page_ids rank lowest. Payloads are
    counted by sha1 and length before the pages meet them; only payloads that
    occur again are written, so the join stays small and can be split.
    """
    size = F.octet_length(F.coalesce("html", F.lit("")))
    rows = pages.select("page_id", "url", "html").withColumn(
        "_sha", F.when(size >= least, F.sha1(F.encode("html", "UTF-8")))
    )
    last = (
        rows.filter(F.col("_sha").isNotNull())
        .groupBy("_sha")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("_last"))
        .filter((F.col("n") > 1) & F.col("_last").isNotNull())
        .select("_sha", "_last")
    )
    joined = rows.join(stored(last, "repeated-payloads"), "_sha", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("_last")) & F.col("_last").isNotNull()
    return joined.select("page_id", "url", "html", F.when(other, F.col("_last")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = MIN_REVISIT) -> None:
    """One archive per task: a record for each page, null html as an empty payload.

    Spark's text writer puts the frames into files and commits them, so a lost
    task leaves nothing and any file system will do. It ends each value with a
    line feed; to that end every frame is followed by the head of a skippable
    frame of one byte, which that line feed is. Readers skip such frames.
    """
    spark = prepared(pages.sparkSession)
    dictionary = train_dictionary(pages)
    opening = b""
    if dictionary:
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        opening = struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
    filler = struct.pack("<II", SKIPPABLE[0], 1)
    shared = spark.sparkContext.broadcast((dictionary, opening))

    def run(batches):
        dictionary, opening = shared.value
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True)
        name = f"<urn:uuid:{uuid.UUID(int=0)}>"
        info = [("WARC-Record-ID", name), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")]
        first = opening + pack.compress(header("warcinfo", info, b"format: WARC File Format 1.1\r\n"))
        for batch in batches:
            out = []
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for k in range(batch.num_rows):
                page, url, html, refers_to = (c[k].as_py() for c in columns)
                payload = (html or "").encode()
                digest = hashlib.sha1(payload).hexdigest()
                record = pack.compress(page_record(page, url, payload, digest, refers_to))
                out.append(first + record + filler)
                first = b""
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    pages = with_originals(pages, least)
    pages.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.text(path)


def page_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every record of the archives in a folder; a broken archive raises ``WarcError``.

    ``record_type, record_id, uri, payload_bytes, payload_digest, refers_to_id,
    payload`` (null for revisits, left out on request). A file is read whole by
    one task; the writer's are as large as its tasks' shares.
    """
    prepared(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    names = ["record_type", "record_id", "uri", "payload_bytes", "payload_digest", "refers_to_id"]
    fields = ["type", "id", "uri", "bytes", "digest", "refers_to"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    if payload:
        names, fields, types = [*names, "payload"], [*fields, "payload"], [*types, pa.binary()]

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for record in read_archive(content.as_py()):
                    rows.append(record)
                    held += len(record["payload"] or b"") if payload else 100
                    if held > 4 << 20:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    def table(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[f] for r in rows], t) for f, t in zip(fields, types, strict=True)], names
        )

    schema = "record_type string, record_id string, uri string, payload_bytes long, payload_digest string, refers_to_id string"
    return files.mapInArrow(run, schema + (", payload binary" if payload else ""))


def archived_pages(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """Pages written to archives and read back: one row per page record.

    Empty tables give archives without pages and no rows.
    """
    spark = pages.sparkSession
    path = os.path.join(shared_dir(spark, "archives"), "warc")
    write_archives(pages, path, least)
    records = read_archives(spark, path, payload=False).filter(F.col("record_type") != "warcinfo")
    return records.select(
        page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of(F.col("refers_to_id")).alias("refers_to"),
        "uri",
    )
