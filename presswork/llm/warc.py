"""WARC: archives whose records are compressed one by one with a Zstandard dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, marked_bits, materialize, scratch_path, shared_bits, text_or_empty

#: Fixed value of the format: the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: Fixed value of the format: how a trained dictionary begins.
TRAINED_MAGIC = struct.pack("<I", 0xEC30A437)
DATE = "2024-01-01T00:00:00Z"
PIECE = 4096


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, kind: str) -> bytes:
    """A WARC/1.1 record. A revisit keeps the HTTP headers, and so the length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    target = "".join(c if c.isprintable() else " " for c in url or "").strip() or "urn:none"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_dictionary(pieces: list[bytes], size: int) -> bytes:
    """A dictionary trained on the pieces. Too few or too even pieces cannot train one; then it is their own last bytes,
    taken as raw content."""
    try:
        return zstandard.train_dictionary(size, pieces, k=256, d=8, f=18, accel=4).as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(pieces)[-size:]
        # Raw content must not begin like a trained dictionary, and the reader takes no empty one.
        return b"\n" + raw if raw.startswith(TRAINED_MAGIC) or not raw else raw


def pack_archive(records: list[bytes], dictionary_bytes: int = 1 << 16, level: int = 6) -> bytes:
    """One archive: a skippable frame with the dictionary built from all its records, cut into pieces, and then each
    record as a frame of its own."""
    pieces = [r[i : i + PIECE] for r in records for i in range(0, len(r), PIECE)]
    raw = archive_dictionary(pieces, min(dictionary_bytes, max(256, sum(map(len, pieces)) // 10)))
    head = zstandard.ZstdCompressor(level=12).compress(raw)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(head)), head, *(packer.compress(r) for r in records)])


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one by one."""
    at, trained = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        trained, at = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + n])), 8 + n
    view = memoryview(data)
    unpacker = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    while at < len(data):
        one = unpacker.decompressobj()
        whole = one.decompress(view[at:])
        if not one.eof:
            raise ValueError("the archive ends inside a record")
        yield whole
        at = len(data) - len(one.unused_data)


def parse_record(data: bytes) -> dict:
    """Headers by lower-case name, and http, payload: the two parts of the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    out: dict = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.lower()] = value.strip()
    block = rest[: int(out["content-length"])]
    out["http"], _, out["payload"] = block.partition(b"\r\n\r\n")
    return out


def _page(text: str) -> int | None:
    text = text.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "None" else int(text)


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, record_type, refers_to: of equal payloads the smallest page_id is the response.

    Only digests are counted in a shuffle. A bitmap of the repeated ones is broadcast, and of the pages only those that it
    lets through shuffle with their bodies to meet their group; hot payloads do not.
    """
    html = text_or_empty("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    groups = materialize(rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "payloads")
    marked = marked_bits(rows, "sha1", shared_bits(groups.select("sha1"), "sha1"))
    revisit = (F.octet_length("html") >= least_bytes) & F.coalesce(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))), F.lit(False))
    several = join_groups(marked.where("maybe"), groups, "sha1", "n", how="left")
    several = several.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))
    single = marked.where("not maybe").select("page_id", "url", "html", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return single.unionByName(several)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = 8 << 20, least_bytes: int = 0) -> DataFrame:
    """Write the archives beneath path; a table with the name and number of records of each.

    A task starts a new archive after archive_bytes of records. Names are unique to the attempt, and only those in
    the returned table count, so what a lost or repeated task leaves behind is never read.
    """
    where = path if "://" in path or path.startswith("file:") else f"file://{path}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(where)
        store.create_dir(root, recursive=True)
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            name = f"part-{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(pack_archive(held))
            row = pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([len(held)], pa.int64())})
            held.clear()
            size = 0
            return row

        for batch in batches:
            for row in batch.to_pylist():
                held.append(record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"], row["record_type"]))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return materialize(decide(pages, least_bytes).mapInArrow(write, "name string, records long"), "archives")


def read_archives(names: DataFrame, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload of every record of the archives
    named. A response whose payload does not have its digest raises."""
    spark = names.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    if files.select("name").hint("merge").join(names, "name", "left_anti").count():  # left by lost tasks
        files = files.hint("merge").join(names.select("name"), "name", "left_semi")
    files = files.select("content")
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for data in read_archive(content.as_py()):
                    r = parse_record(data)
                    kind, digest = r["warc-type"], r["warc-payload-digest"].removeprefix("sha1:")
                    length = next(int(x.partition(b":")[2]) for x in r["http"].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    if kind == "response" and (digest_of(r["payload"]) != digest or len(r["payload"]) != length):
                        raise ValueError(f"damaged record {r['warc-record-id']}")
                    rows.append({"page_id": _page(r["warc-record-id"]), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": _page(r["warc-refers-to"]) if kind == "revisit" else None, "url": r["warc-target-uri"], "payload": r["payload"] if kind == "response" else None})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def archive_round_trip(pages: DataFrame, archive_bytes: int = 8 << 20, least_bytes: int = 0) -> DataFrame:
    """Write every row of pages into archives in the shared folder and read them back.

    A null html is an empty payload. A null page_id comes after all others, and is a response only where no equal
    payload has a page_id. Rows that repeat the smallest page_id of a payload are all responses. An empty table
    writes no archive and gives an empty table. Other columns are not read.
    """
    path = scratch_path(pages.sparkSession, "warc")
    names = write_archives(pages, path, archive_bytes, least_bytes)
    if not names.count():
        return pages.sparkSession.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")
    return read_archives(names, path)
