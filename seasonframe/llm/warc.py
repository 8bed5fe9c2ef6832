"""WARC archives: records sorted into id ranges, files rolled by compressed size, committed through a manifest."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyarrow import fs as arrow_fs

from seasonframe.llm.common import partitions, written

# Payload bytes aimed at per shard, shards at most before the aim grows, and parts of a shard that holds more.
SHARD_BYTES = 16_000_000
SHARDS = 4096
PARTS = 1024

# Compressed size from which a new file begins.
FILE_BYTES = 64_000_000

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page")

MANIFEST = "name string, temporary string, records long, bytes long, sha256 string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{payload_digest}')}>"


def _headers(fields: list[tuple[str, str | None]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode()


def _uri(url: str | None) -> str | None:
    """The URL without characters that could end a header."""
    return None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None) -> bytes:
    """One record; a revisit keeps the HTTP headers of the payload and leaves the payload out."""
    own = digest(payload)
    http = b"HTTP/1.1 200 OK\r\n" + _headers(
        [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = b"WARC/1.1\r\n" + _headers([
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, own)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)),
        ("X-Page-Id", None if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha1:{own}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", _record_id(refers_to, own) if revisit else None),
        ("WARC-Refers-To-Target-URI", _uri(refers_url) if revisit else None),
        ("X-Refers-To-Page-Id", str(refers_to) if revisit else None),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))])
    return head + b"\r\n" + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    block = b"software: seasonframe\r\nformat: WARC File Format 1.1\r\n"
    return b"WARC/1.1\r\n" + _headers([
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", DATE),
        ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]) \
        + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """One gzip member without time or name, so equal records give equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _File:
    """One archive under its temporary name."""

    def __init__(self, fs: arrow_fs.FileSystem, folder: str, name: str, attempt: int) -> None:
        self.name, self.temporary = name, f"_temporary/{name}.{attempt}"
        fs.create_dir(f"{folder}/_temporary", recursive=True)
        self._out, self._sum = fs.open_output_stream(f"{folder}/{self.temporary}", compression=None), hashlib.sha256()
        self.size = self.records = 0
        self.add(_info(name))
        self.records = 0

    def add(self, data: bytes) -> None:
        packed = _member(data)
        self._out.write(packed)
        self._sum.update(packed)
        self.size += len(packed)
        self.records += 1

    def close(self) -> tuple[str, str, int, int, str]:
        self._out.close()
        return self.name, self.temporary, self.records, self.size, self._sum.hexdigest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pages in order, each with what the row before it says about its first copy."""
    known = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            bin_, part, page_id, own, kind, url, payload, refers_to = row
            if kind == 0:
                known = (page_id, own, refers_to, url)
            else:
                first = known if known and known[:2] == (page_id, own) else (None, None, None, None)
                yield f"pages-{bin_ + 1:05d}-{part:04d}", page_id, url, payload or b"", first[2], first[3]


def _shards(sizes: DataFrame, shard_bytes: int) -> Column:
    """(bin, part) of a page_id: equal id ranges, and equal parts of the ranges that hold much more than the
    aim. Only at most `SHARDS` sums come to the driver; the split depends on the data alone."""
    low, high, total = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum(F.col("n") + 512)).first()
    n = max(1, min(SHARDS, -(-(total or 0) // shard_bytes)))
    aim = max(shard_bytes, (total or 0) // n)
    if low is None:
        return F.struct(F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("part"))
    place = (F.col("page_id").cast("double") - float(low)) / (float(high) - float(low) + 1) * n
    bin_ = F.coalesce(F.least(F.floor(place), F.lit(n - 1)), F.lit(-1)).cast("long")
    heavy = sizes.groupBy(bin_.alias("bin")).agg(F.sum(F.col("n") + 512).alias("n")).where(F.col("n") > 4 * aim).collect()
    parts = F.lit(1)
    if heavy:
        many = F.create_map(*[F.lit(x) for r in heavy for x in (r["bin"], min(PARTS, -(-r["n"] // aim)))])
        parts = F.coalesce(F.try_element_at(many, bin_), F.lit(1))
    part = F.coalesce(F.least(F.floor((place - bin_) * parts), parts - 1), F.lit(0)).cast("long")
    return F.struct(bin_.alias("bin"), part.alias("part"))


def write_archives(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES,
                   min_revisit: int = 0) -> None:
    """Write one record per row of (page_id, url, html) to `path`; the folder is readable once its manifest is.

    Of equal payloads of at least `min_revisit` bytes the smallest page_id is a response and the others
    revisit it. Rows go to shards, each a range of ids; a task sorts its shards and streams them to files, so
    it holds one record at a time however many rows share a payload or a range. What is known of first copies
    travels as rows of its own beside the pages: the payloads are shuffled once. Names, order, dates and
    compression depend on the rows alone.

    Tasks write under temporary names that hold the attempt; the manifest names the attempts that succeeded;
    a second job, safe to repeat, renames them; the manifest's own commit makes the archive visible. A lost
    executor costs the files it was writing.

    A null html is an empty payload and equals other empty ones; a null page_id is written first, without an id,
    and always as a response; a null url has no header; rows that repeat the smallest id of a payload are all
    responses; an empty table gives an empty manifest; other columns are ignored.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    narrow = written(base.select("page_id", "url", F.sha1("payload").alias("digest"), F.length("payload").alias("n")))
    shard = _shards(narrow, shard_bytes)
    ided = narrow.where("page_id is not null")
    first = ided.where(F.col("n") >= min_revisit).groupBy("digest", "n").agg(
        F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    urls = ided.select("digest", "n", F.col("page_id").alias("refers_to"), F.col("url").alias("refers_url"))
    first = first.join(urls, ["digest", "n", "refers_to"]).groupBy("digest", "n", "refers_to").agg(
        F.min("refers_url").alias("refers_url"))
    again = ided.join(first, ["digest", "n"]).where("page_id > refers_to").select(
        "page_id", "digest", F.lit(0).alias("kind"), F.col("refers_url").alias("url"), F.lit(None).cast("binary").alias("payload"),
        "refers_to").distinct()
    rows = base.select("page_id", F.sha1("payload").alias("digest"), F.lit(1).alias("kind"), "url", "payload",
                       F.lit(None).cast("long").alias("refers_to")).unionByName(again)
    placed = rows.select(shard["bin"].alias("bin"), shard["part"].alias("part"), "*")
    ordered = placed.repartition("bin", "part").sortWithinPartitions("bin", "part", "page_id", "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = arrow_fs.FileSystem.from_uri(path)
        attempt, done, file, number = TaskContext.get().taskAttemptId(), [], None, 0
        for shard_name, *fields in _rows(batches):
            if file and (not file.name.startswith(shard_name) or file.size >= file_bytes):
                number = number + 1 if file.name.startswith(shard_name) else 0
                done.append(file.close())
                file = None
            if file is None:
                file = _File(fs, folder, f"{shard_name}-{number:05d}.warc.gz", attempt)
            file.add(record(*fields))
        if file:
            done.append(file.close())
        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done)] if done else [
            pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64()),
            pa.array([], pa.string())], names=["name", "temporary", "records", "bytes", "sha256"])

    manifest = written(ordered.mapInArrow(write, MANIFEST))

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = arrow_fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, temporary, size in zip(*(batch.column(c).to_pylist() for c in ("name", "temporary", "bytes"))):
                if fs.get_file_info(f"{folder}/{temporary}").type != arrow_fs.FileType.NotFound:
                    fs.move(f"{folder}/{temporary}", f"{folder}/{name}")
                if fs.get_file_info(f"{folder}/{name}").size != size:
                    raise OSError(f"{name} has not its {size} bytes")
            yield batch

    manifest.repartition("name").mapInArrow(commit, MANIFEST).drop("temporary").write.parquet(f"{path.rstrip('/')}/manifest")
    fs, folder = arrow_fs.FileSystem.from_uri(path)
    if fs.get_file_info(f"{folder}/_temporary").type != arrow_fs.FileType.NotFound:
        fs.delete_dir(f"{folder}/_temporary")


def _members(stream: pa.NativeFile, check: hashlib._Hash) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpacker, out = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        check.update(data)
        while data:
            out.append(unpacker.decompress(data))
            data = b""
            if unpacker.eof:
                yield b"".join(out)
                data, unpacker, out = unpacker.unused_data, zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the last record is cut off")


def parse(data: bytes) -> dict | None:
    """One record with its digests checked; nothing for the file's own description."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    if fields["WARC-Type"] == "warcinfo":
        return None
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError("a block's digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    own, response = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "response"
    if response and (len(payload) != length or digest(payload) != own):
        raise ValueError("a payload's digest or length is wrong")
    page_id, refers_to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return {
        "page_id": None if page_id is None else int(page_id), "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"], "payload": payload if response else None, "payload_bytes": length,
        "payload_digest": own, "refers_to": None if refers_to is None else int(refers_to)}


_READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of a committed archive, files checked against the manifest and records against their digests."""
    files = spark.read.parquet(f"{path.rstrip('/')}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = arrow_fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, expected in zip(batch.column("name").to_pylist(), batch.column("sha256").to_pylist()):
                check, held, size = hashlib.sha256(), [], 0
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for member in _members(stream, check):
                        if found := parse(member):
                            held.append(found)
                            size += len(member)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist(held, schema=_READ)
                            held, size = [], 0
                if check.hexdigest() != expected:
                    raise ValueError(f"{name} differs from its manifest")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_READ)

    return files.repartition(partitions(files), "name").mapInArrow(
        run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, "
             "refers_to long")
