"""Dictionary-compressed web archives: ``.warc.zst`` files written and read by Spark tasks.

A file starts with a skippable frame that holds a Zstandard dictionary, trained on archived records; each
record after it is a frame of its own, compressed with that dictionary, so records can be read one by one.
Where there are too few records to train on, the sample itself is the dictionary, as raw content.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

#: Fixed values of the format: magic numbers of the dictionary frame, of a dictionary, of a frame.
DICT_FRAME, DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
#: Payloads shorter than this are written again instead of referred to.
LEAST_REVISIT = 1000
#: Bounds of the sample that the dictionary is trained on, its size, and the size at which a new file begins.
SAMPLE_RECORDS, SAMPLE_CHARS, DICT_BYTES, FILE_BYTES = 1000, 8192, 65_536, 64 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str):
    """(file system, path) for a folder that Spark names; tasks write there without a JVM."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


# -- records --


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, name: str = "0", refers_url: str | None = None) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP head of the full payload and leaves the payload out.

    ``name`` tells records with one page_id, or none, apart; a revisit names its response by target and date, as the standard
    proposes for equal payloads, and both carry page ids in fields of their own.
    """
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}:{name}>", f"X-Page-ID: {page_id}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_target(url, page_id)}"]
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is None:
        body += payload
    else:
        head += [f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Refers-To-Target-URI: {_target(refers_url, refers_to)}", f"WARC-Refers-To-Date: {DATE}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _target(url: str | None, page_id: int | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:x-page:{page_id}")


def parse(data: bytes) -> dict:
    """The fields of a record: page_id, url, payload (None for a revisit), payload_bytes, payload_digest, record_type, refers_to."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8").split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(head["Content-Length"])]
    if not lines[0].startswith("WARC/") or len(block) < int(head["Content-Length"]):
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    number = lambda field: None if head.get(field, "None") == "None" else int(head[field])
    revisit = head["WARC-Type"] == "revisit"
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not fit its digest")
    return {
        "page_id": number("X-Page-ID"),
        "url": head["WARC-Target-URI"],
        "payload": None if revisit else payload,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": head["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
    }


# -- files --


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; of too few, or too much alike, to train on, their bytes as raw content."""
    size = min(DICT_BYTES, sum(map(len, samples)) // 8)
    if size >= 1024 and len(samples) >= 8:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:  # samples too uniform
            pass
    return b"".join(samples)[:DICT_BYTES]


def dictionary_frame(dictionary: bytes) -> bytes:
    held = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
    return struct.pack("<II", DICT_FRAME, len(held)) + held


def frame_length(data, at: int) -> int:
    """Bytes of the frame that starts at ``at``: its header, its blocks, its checksum."""
    params = zstandard.get_frame_parameters(data[at : at + 18])
    end = at + zstandard.frame_header_size(data[at : at + 18])
    last = 0
    while not last:
        word = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = word & 1, word >> 1 & 3, word >> 3
        end += 3 + (1 if kind == 1 else size)
    return end + 4 * params.has_checksum - at


def records(data: bytes):
    """Uncompressed records of a file."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICT_FRAME:
        raise ValueError("the file does not start with a dictionary frame")
    held, at, view = data[8 : 8 + size], 8 + size, memoryview(data)
    if held[:4] == struct.pack("<I", FRAME_MAGIC):
        held = zstandard.ZstdDecompressor().decompress(held)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)
    while at < len(data):
        n = frame_length(view, at)
        yield reader.decompress(view[at : at + n])
        at += n


_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def with_digests(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    payload = F.coalesce(F.encode(pages[html_col].cast("string"), "UTF-8"), F.lit(b""))
    out = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    return out.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha1("payload")})


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Write a record per row into files under ``folder``; returns (path, records, bytes) of each file.

    Of rows with equal payloads (same SHA-1 and length) of at least LEAST_REVISIT bytes, that with the largest page_id is
    the response and the others revisit it; repeated rows with that very id are responses too.  Rows without an id are
    responses.  Each record has an id of its own.  A null html is an empty payload, a null url is replaced by a name made of the page's id.
    An empty table writes nothing.  The dictionary is trained on the first SAMPLE_CHARS bytes of up to SAMPLE_RECORDS distinct
    payloads, chosen by a hash; rows without an id are not among them.  A task that is run again writes files of another name; only files in the result count.
    """
    spark = pages.sparkSession
    rows = with_digests(pages, id_col, url_col, html_col)
    hashed = rows.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n"), F.count("page_id").alias("named"))
    # tables of their own: Spark can then split the rows of one hot payload in the join
    hashed = scratch.write(hashed.select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), F.col("top.page_id").alias("target"), F.col("top.url").alias("target_url"), "n", "named"), "payloads")
    groups = scratch.write(hashed.where(f"b >= {LEAST_REVISIT} and target is not null and n > 1").drop("n", "named"), "groups")
    joined = rows.join(groups, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    refers = F.when(F.col("target") != F.col("page_id"), F.col("target"))
    plan = joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", refers.alias("refers_to"), "target_url")
    # payloads for the sample are picked by their digest, so that only these are read out
    n = hashed.where("target is not null").count()
    share = F.lit(min(1.0, 2 * SAMPLE_RECORDS / max(1, n)))
    few = hashed.where("target is not null").where((F.pmod(F.xxhash64("d"), F.lit(1_000_003)) / 1_000_003) < share).orderBy(F.xxhash64("d"), "b").limit(SAMPLE_RECORDS).select("d", "target").collect()
    dictionary = b""
    if few:
        picked = F.broadcast(spark.createDataFrame(few, "pd string, pid bigint"))  # SAMPLE_RECORDS at most
        sample = rows.join(picked, (F.col("payload_digest") == F.col("pd")) & (F.col("page_id") == F.col("pid")))
        sample = sample.groupBy("pd").agg(F.min(F.struct("page_id", "url", F.substring("payload", 1, SAMPLE_CHARS).alias("part"))).alias("r"))
        sample = scratch.write(sample.select("r.*", "pd"), "sample").orderBy(F.xxhash64("pd"), "pd").collect()
        dictionary = train([record(r["page_id"], r["url"], bytes(r["part"]), None, r["pd"]) for r in sample])

    def write(batches):
        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if held:
            held.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=True)
        task, out, done = TaskContext.get(), None, []
        name, n, size, part = "", 0, 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, n, size))
                out = None

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name = f"{base}/{task.partitionId():06d}-{part:03d}-{uuid.uuid4().hex[:8]}.warc.zst"
                    out, part, n, size = files.open_output_stream(name, compression=None), part + 1, 0, 0
                    size += out.write(dictionary_frame(dictionary))
                payload = _Length(r["payload_bytes"]) if r["refers_to"] is not None else r["payload"]
                data = record(r["page_id"], r["url"], payload, r["refers_to"], r["payload_digest"], f"{task.partitionId()}-{part}-{n}", r["target_url"])
                size += out.write(packer.compress(data))
                n += 1
                if size >= FILE_BYTES:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*done, strict=True), _MANIFEST, strict=True)], schema=_MANIFEST)

    return scratch.write(plan.mapInArrow(write, "path string, records bigint, bytes bigint"), "manifest")


class _Length:
    """Stands for a payload of which only the length is written."""

    def __init__(self, n: int):
        self.n = n

    def __len__(self) -> int:
        return self.n


_READ = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the files in ``manifest`` (path); payload is null for revisits, and left out if not wanted.

    Digests of responses are recomputed from what was read; one that does not fit is an error.
    """
    schema = pa.schema([f for f in _READ if payloads or f.name != "payload"])

    def read(batches):
        files, _ = file_system(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(path, compression=None) as f:
                    data = f.read()
                rows, size = [], 0
                for raw in records(data):
                    rows.append(parse(raw))
                    size += len(raw) if payloads else 100
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    # a file is read by one task; files are dealt out evenly
    spread = manifest.select("path").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(read, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))
