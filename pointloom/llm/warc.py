"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

Archives are files in the shared folder, each of bounded size and complete in itself. Writers name them anew for each
attempt and report them in a manifest that only finished tasks get into, so a lost task leaves at most an orphan that no
reader looks at. Readers take the dictionary from the first frame, decode one frame at a time and check each record: the
version line, the header fields that must be there, the lengths, the digests and that nothing follows the block.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.plans.storage import materialize, scratch_path

#: Fixed values of the formats: skippable frame of a dictionary, frame, dictionary; profile of revisits with equal payload.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Bytes of payload after which a writer begins its next archive; bytes and records a dictionary is trained on.
ROLL, SAMPLE_BYTES, SAMPLE_RECORDS, DICT_BYTES = 16 << 20, 1 << 20, 400, 32 << 10
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None, salt: str = "") -> str:
    return f"urn:page:{page_id}" if page_id is not None else f"urn:page:null:{salt}"


def record(page_id: int | None, url: str | None, payload: bytes, refers: int | None, date: str, salt: str = "") -> bytes:
    """One record: a response with its payload, or where refers names another page a revisit without it."""
    revisit = refers is not None
    block = HTTP if revisit else HTTP + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{record_uri(page_id, salt)}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(url.split())))
    if revisit:
        head += [("WARC-Refers-To", f"<{record_uri(refers)}>"), ("WARC-Profile", IDENTICAL)]
    head += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary from some records; none if they are too few or too small to train on."""
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack(records: list[bytes], dictionary: bytes, level: int = 3) -> bytes:
    """An archive of some records."""
    out = []
    made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if dictionary:
        body = zstandard.ZstdCompressor(level=level).compress(dictionary)
        out.append(struct.pack("<II", SKIPPABLE, len(body)) + body)
    press = zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=True, write_content_size=True)
    out += [press.compress(r) for r in records]
    return b"".join(out)


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that begins at a byte ends, by the sizes in its header and before its blocks. Raises ValueError."""
    if data[at : at + 4] != FRAME:
        raise ValueError(f"no frame at byte {at}")
    try:
        head = zstandard.get_frame_parameters(data[at : at + 18])
        end = at + zstandard.frame_header_size(data[at : at + 18])
    except zstandard.ZstdError as e:
        raise ValueError(f"no frame at byte {at}: {e}") from e
    last = False
    while not last:
        block = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
        if len(data) < end + 3 or kind == 3:
            raise ValueError(f"the frame at byte {at} is broken or cut off")
        end += 3 + (1 if kind == 1 else size)  # a run's only byte stands for all of it
    end += 4 * bool(head.has_checksum)
    if end > len(data):
        raise ValueError(f"the frame at byte {at} is cut off")
    return end


def skippable_end(data: bytes, at: int) -> int:
    """Where the skippable frame that begins at a byte ends; at itself if none begins there. Raises ValueError if it is cut off."""
    if len(data) < at + 4 or not 0x184D2A50 <= struct.unpack_from("<I", data, at)[0] <= 0x184D2A5F:
        return at
    if len(data) < at + 8 or len(data) < at + 8 + struct.unpack_from("<I", data, at + 4)[0]:
        raise ValueError(f"the skippable frame at byte {at} is cut off")
    return at + 8 + struct.unpack_from("<I", data, at + 4)[0]


def unpack(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each. Raises ValueError on anything else, cut off frames of any kind included."""
    at, made = 0, None
    if data[:4] == struct.pack("<I", SKIPPABLE):
        at = skippable_end(data, 0)
        body = data[8:at]
        if body[:4] == FRAME:
            try:
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body[: frame_end(body, 0)])
            except zstandard.ZstdError as e:
                raise ValueError(f"the dictionary's frame is broken: {e}") from e
        if body[:4] != DICTIONARY:
            raise ValueError("the leading frame holds no dictionary")
        made = zstandard.ZstdCompressionDict(body)
    press = zstandard.ZstdDecompressor(dict_data=made)
    while at < len(data):
        if (end := skippable_end(data, at)) > at:
            at = end
            continue
        end, one = frame_end(data, at), press.decompressobj()
        try:
            out = one.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise ValueError(f"the frame at byte {at} is broken: {e}") from e
        if not one.eof:
            raise ValueError(f"the frame at byte {at} is cut off")
        at = end
        yield out


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record, checked. Raises ValueError."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError(f"header line without a colon: {line[:60]!r}")
        fields[name.strip()] = value.strip()
    if lost := [k for k in NEEDED if k not in fields]:
        raise ValueError(f"header lacks {lost}")
    if not fields["Content-Length"].isdigit():
        raise ValueError("Content-Length is no number")
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the block's length differs from Content-Length")
    return fields, rest[:n]


def payload_of(fields: dict[str, str], block: bytes) -> bytes | None:
    """The payload of a response, held against its digest and length; None for a revisit."""
    if fields["WARC-Type"] == "revisit":
        return None
    body = block.partition(b"\r\n\r\n")[2]
    if "X-Payload-Length" in fields and int(fields["X-Payload-Length"]) != len(body):
        raise ValueError("the payload's length differs from X-Payload-Length")
    if fields.get("WARC-Payload-Digest", f"sha1:{digest(body)}") != f"sha1:{digest(body)}":
        raise ValueError("the payload's digest differs from WARC-Payload-Digest")
    return body


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, payload) with refers: of equal payloads of at least so many bytes, the largest page_id is kept whole.

    Payloads are compared by SHA-256 and length. Only ids and digests are aggregated, which combines before the shuffle;
    most payloads occur once, and only groups of two or more are joined back.
    """
    p = pages.withColumn("size", F.length("payload")).withColumn("key", F.sha2("payload", 256))
    groups = p.where(F.col("size") >= least).groupBy("key", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    groups = materialize(groups.select(F.col("key").alias("gkey"), F.col("size").alias("gsize"), "first"), "warc-groups")
    both = p.join(groups, (F.col("key") == F.col("gkey")) & (F.col("size") == F.col("gsize")), "left")
    return both.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))


def write(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll: int = ROLL) -> DataFrame:
    """Writes an archive record per row and returns the manifest: path, records, bytes.

    Nulls: a null html is an empty payload; a null url leaves the target out; a null id is never referred to. Rows that
    share id and payload are all responses. An empty table gives an empty manifest. Other columns are not looked at.
    """
    spark = pages.sparkSession
    base = scratch_path(spark, "warc")
    where, folder = pafs.FileSystem.from_uri(base)
    where.create_dir(folder, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, to = pafs.FileSystem.from_uri(base)
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            samples, n = [], 0
            for r in held[:SAMPLE_RECORDS]:
                samples.append(r[:65536])
                n += len(samples[-1])
                if n > SAMPLE_BYTES:
                    break
            data = pack(held, train(samples))
            name = f"{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{to}/{name}", compression=None) as f:  # the name would have it compressed once more
                f.write(data)
            out = pa.RecordBatch.from_pydict({"path": [f"{base}/{name}"], "records": [len(held)], "bytes": [len(data)]}, schema=schema)
            held.clear()
            return out

        for batch in batches:
            for page_id, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page_id, url, payload, refers, date, uuid.uuid4().hex if page_id is None else ""))
                size += len(held[-1])
                if size >= roll:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return materialize(revisits(rows, least).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


READ = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType())])


def _page_of(uri: str | None) -> int | None:
    tail = (uri or "").strip("<>").removeprefix("urn:page:")
    return int(tail) if tail.lstrip("-").isdigit() else None


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all archives in the manifest. A revisit has the digest and length of the payload it points to, and no payload.

    An archive that breaks a rule of the format fails the job with its path and the rule. Digest and payload length are no
    needed fields: where a response lacks them they are reckoned from its payload, where a revisit does they are null.
    """
    spark = manifest.sparkSession
    deals = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(at, compression=None) as f:
                    data = f.read()
                cols: dict[str, list] = {k: [] for k in READ.names}
                try:
                    for raw in unpack(data):
                        fields, block = parse(raw)
                        body = payload_of(fields, block)
                        cols["page_id"].append(_page_of(fields["WARC-Record-ID"]))
                        cols["url"].append(fields.get("WARC-Target-URI"))
                        cols["record_type"].append(fields["WARC-Type"])
                        told, length = fields.get("WARC-Payload-Digest"), fields.get("X-Payload-Length")
                        cols["payload_digest"].append(told.removeprefix("sha1:") if told is not None else None if body is None else digest(body))
                        cols["payload_bytes"].append(len(body) if body is not None else None if length is None else int(length))
                        cols["refers_to"].append(_page_of(fields.get("WARC-Refers-To")))
                        cols["payload"].append(body if payloads else None)
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                yield pa.RecordBatch.from_pydict(cols, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]))

    return manifest.select("path").repartition(deals).mapInArrow(run, READ)
