"""Web archives (WARC) of pages, with a two-level capture index over them.

Every page becomes a record of a ``.warc.gz`` file (one gzip member a record); a payload that another
page holds too is written once and revisited by the others. The index sorts all captures by
reversed-host URL key: each sorted part is a file of compressed blocks of lines, followed by a sparse
directory with the first line's key of each block. Finding a capture is a binary search over the files'
first keys (one a file, which is all that workers are sent), one over a file's directory and one in a block, then a
range read of the archive. Archives and index are written by tasks under names of their own and count
only once their rows are in a written table, so lost and repeated tasks leave nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from revloom.llm.common import slices
from revloom.session import pin, scratch_path

LEAST_BYTES = 1000  # payloads from this size on are revisited
FILE_BYTES = 256_000_000  # an archive is closed at this size
BLOCK_LINES = 1000
READ_BYTES = 4_000_000  # neighbouring records are read together up to this size
DATE = "1970-01-01T00:00:00Z"  # pages have no date of their own
LINE = "key string, id bigint, digest string, kind string, file string, offset bigint, length bigint, refers bigint, refers_key string"
NAMES = [part.split()[0] for part in LINE.split(", ")]
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def surt(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then port, path and query; no scheme, user or fragment."""
    parts = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^#]*)"
    host = F.lower(F.regexp_extract(url, parts, 1))
    port, rest = F.regexp_extract(url, parts, 2), F.regexp_extract(url, parts, 3)
    port = F.when(port.isin(":", ":80", ":443"), "").otherwise(port)
    rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), rest)
    return F.coalesce(F.when(F.rlike(url, F.lit(parts)), key).otherwise(url), F.lit(""))


# --- files in the shared folder -----------------------------------------------------------------


def _system(path: str):
    """File system and path; tasks use the store of the checkpoint folder, never their own disk."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


def _create(folder: str, name: str):
    """A new file of this task: its path and an open stream."""
    path = f"{folder.rstrip('/')}/{name}"
    system, place = _system(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    return path, system.open_output_stream(place, compression=None)


class Files:
    """Open files, the last few used."""

    def __init__(self, most: int = 16):
        self.most, self.open = most, OrderedDict()

    def get(self, path: str):
        if path not in self.open:
            system, place = _system(path)
            self.open[path] = system.open_input_file(place)
            if len(self.open) > self.most:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(path)
        return self.open[path]

    def read(self, path: str, offset: int, length: int) -> bytes:
        return self.get(path).read_at(length, offset)


# --- records ------------------------------------------------------------------------------------


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def _uri(url: str | None) -> str | None:
    """The URL as a header may hold it."""
    return None if url is None else quote(url, safe="%:/?#[]@!$&'()*+,;=~")


def record(kind: str, fields: list[tuple[str, str | None]], block: bytes, date: str = DATE) -> bytes:
    """One gzip member; fields without a value are left out."""
    head = [("WARC-Type", kind), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def response(page_id: int | None, url: str | None, digest: str, payload: bytes) -> bytes:
    fields = [
        ("WARC-Record-ID", _name(page_id, digest)), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", _digest_field(digest)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return record("response", fields, HTTP.format(len(payload)).encode() + payload)


def revisit(page_id: int | None, url: str | None, digest: str, size: int, target: int, target_url: str | None) -> bytes:
    fields = [
        ("WARC-Record-ID", _name(page_id, digest)), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", _digest_field(digest)),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(target, digest)),
        ("WARC-Refers-To-Target-URI", _uri(target_url)), ("WARC-Refers-To-Date", DATE), ("Content-Type", "application/http; msgtype=response"),
    ]
    return record("revisit", fields, HTTP.format(size).encode())


def _digest_field(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record. A record that is cut short or has another length ends the job."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    return fields, block


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header of a block."""
    return block.partition(b"\r\n\r\n")[2]


def page_of(name: str) -> int | None:
    """The page id in a record's name."""
    text = name.split(":")[2]
    return int(text) if text else None


# --- writing ------------------------------------------------------------------------------------


def _write(folder: str, kind: str, file_bytes: int):
    """Records of all rows to archives of this task; one line per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = stream = None
        at = 0
        try:
            for part in slices(batches, "payload" if kind == "response" else "key"):
                lines = []
                for row in part.to_pylist():
                    if stream is None:
                        path, stream = _create(folder, f"{kind}-{uuid.uuid4().hex}.warc.gz")
                        at = stream.write(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"software: revloom\r\n"))
                    if kind == "response":
                        data = response(row["id"], row["url"], row["digest"], row["payload"])
                    else:
                        data = revisit(row["id"], row["url"], row["digest"], row["size"], row["refers"], row["refers_url"])
                    stream.write(data)
                    lines.append((row["key"], row["id"], row["digest"], kind, path, at, len(data), row.get("refers"), row.get("refers_key")))
                    at += len(data)
                    if at >= file_bytes:
                        stream.close()
                        stream = None
                yield _lines(lines)
        finally:
            if stream is not None:
                stream.close()

    return run


TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def _lines(lines: list[tuple]) -> pa.RecordBatch:
    columns = zip(*lines) if lines else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], NAMES)


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record per row; gives the written table of captures (``LINE``).

    Of equal payloads (SHA-1 and length) of ``least`` bytes or more the one with the largest id is a
    response, others are revisits of it; a null id is smaller than any other, and where all are null all are
    responses, as are rows that repeat the id and payload of a response. A null payload is empty. Only ids,
    URLs and digests are grouped; payloads are shuffled at most once, by id and digest.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("id", "url", surt(F.col("url")).alias("key"), F.sha1("payload").alias("digest"), F.octet_length("payload").cast("bigint").alias("size"), "payload")
    facts = rows.drop("payload").where(F.col("size") >= least)
    shared = facts.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("id", "key", "url")).alias("target"))
    shared = shared.where("copies > 1 and target.id is not null").drop("copies")
    again = facts.join(shared, ["digest", "size"]).where("id is null or id <> target.id")
    again = pin(
        again.select("id", "url", "key", "digest", "size", F.col("target.id").alias("refers"), F.col("target.key").alias("refers_key"), F.col("target.url").alias("refers_url"))
    )
    known = again.select(F.col("id").alias("again_id"), F.col("digest").alias("again_digest"))
    first = rows.join(known, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left_anti")
    written = first.mapInArrow(_write(folder, "response", file_bytes), LINE).unionByName(again.mapInArrow(_write(folder, "revisit", file_bytes), LINE))
    return pin(written)


# --- index --------------------------------------------------------------------------------------


def _place(line: tuple | list) -> tuple:
    """What lines are sorted by: key, id (null first), digest."""
    return (line[0], line[1] is not None, line[1] or 0, line[2])


def _write_index(folder: str, block_lines: int):
    """The sorted lines of a task as one file of blocks with its directory; its path, first place and bytes of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = stream = None
        held: list[list] = []
        directory: list[list] = []
        at = size = 0

        def flush() -> None:
            nonlocal at
            data = zlib.compress("\n".join(json.dumps(line) for line in held).encode())
            directory.append([*held[0][:3], at, len(data)])
            at += stream.write(data)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None:
                    path, stream = _create(folder, f"index-{uuid.uuid4().hex}.cdx")
                held.append(list(row))
                size += row[6]
                if len(held) == block_lines:
                    flush()
        if stream is None:
            return
        if held:
            flush()
        data = zlib.compress("\n".join(json.dumps(entry) for entry in directory).encode())
        stream.write(data + struct.pack("<qq", at, len(data)))
        stream.close()
        key, page, digest = directory[0][:3]
        yield pa.RecordBatch.from_arrays(
            [pa.array([key]), pa.array([page], pa.int64()), pa.array([digest]), pa.array([path]), pa.array([size], pa.int64())],
            ["key", "id", "digest", "path", "size"],
        )

    return run


class Lookup:
    """Binary search in index files whose first places and paths are given in order."""

    def __init__(self, files: list[tuple]):
        self.files, self.firsts = files, [_place(f) for f in files]
        self.opened, self.directories, self.block = Files(), OrderedDict(), (None, None)

    def directory(self, path: str) -> tuple[list[tuple], list[list]]:
        if path not in self.directories:
            file = self.opened.get(path)
            end = file.size()
            at, length = struct.unpack("<qq", file.read_at(16, end - 16))
            entries = [json.loads(x) for x in zlib.decompress(file.read_at(length, at)).split(b"\n")]
            self.directories[path] = ([_place(e) for e in entries], entries)
            if len(self.directories) > 4:
                self.directories.popitem(last=False)
        return self.directories[path]

    def lines(self, path: str, entry: list) -> list[list]:
        """The lines of a block; the last one read is kept."""
        offset, length = entry[3:5]
        if self.block[0] != (path, offset):
            data = zlib.decompress(self.opened.read(path, offset, length))
            self.block = ((path, offset), [json.loads(x) for x in data.split(b"\n")])
        return self.block[1]

    def find(self, wanted: tuple) -> Iterator[list]:
        """All lines whose place begins with ``wanted``, wherever blocks and files are cut."""
        n = len(wanted)
        for f in range(max(bisect_left(self.firsts, wanted) - 1, 0), len(self.files)):
            if self.firsts[f][:n] > wanted:
                return
            path = self.files[f][3]
            places, entries = self.directory(path)
            for b in range(max(bisect_left(places, wanted) - 1, 0), len(entries)):
                if places[b][:n] > wanted:
                    return
                lines = self.lines(path, entries[b])
                for i in range(bisect_left(lines, wanted, key=_place), len(lines)):
                    if _place(lines[i])[:n] != wanted:
                        break
                    yield lines[i]


@dataclass
class CaptureIndex:
    """``files``: ``(key, id, digest, path)`` of each index file's first line, in order; ``size``: bytes of all records."""

    spark: SparkSession
    files: list[tuple]
    size: int

    def tasks(self) -> int:
        """As many as reading all records should be dealt to: lines are small, what they stand for is not."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.size // (16 * READ_BYTES)))

    def captures(self) -> DataFrame:
        """All lines, read block by block."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column("path").to_pylist():
                    look = Lookup([])
                    for entry in look.directory(path)[1]:
                        yield _lines([tuple(x) for x in look.lines(path, entry)])

        paths = self.spark.createDataFrame([(f[3],) for f in self.files], "path string")
        return paths.repartition(max(len(self.files), 1), "path").mapInArrow(run, LINE)

    def find(self, wanted: DataFrame, exact: bool = True) -> DataFrame:
        """Lines of ``wanted (key, id, digest)`` or, if not ``exact``, all captures of ``wanted (key)``.

        What is looked for is sorted like the index, so that a task reads each block once.
        """
        files = self.files
        order = ["key", F.asc_nulls_first("id"), "digest"] if exact else ["key"]
        cols = ["key", "id", "digest"] if exact else ["key"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look, held = Lookup(files), []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    for line in look.find(_place(row) if exact else row):
                        held.append(tuple(line))
                        if len(held) == BLOCK_LINES:
                            yield _lines(held)
                            held = []
            yield _lines(held)

        ranged = wanted.select(*cols).where("key is not null").distinct()
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return ranged.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, LINE)


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sort captures and write the index; one file per range partition. Only the files' first lines reach the driver."""
    spark = captures.sparkSession
    order = ["key", F.asc_nulls_first("id"), "digest"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.select(*NAMES).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    files = pin(ranged.mapInArrow(_write_index(folder, block_lines), "key string, id bigint, digest string, path string, size bigint")).collect()
    return CaptureIndex(spark, sorted(((r["key"], r["id"], r["digest"], r["path"]) for r in files), key=_place), sum(r["size"] for r in files))


# --- reading ------------------------------------------------------------------------------------


def _ranges(rows: list[dict]) -> Iterator[tuple[dict, bytes]]:
    """The record of each line; lines that follow each other in a file are read together."""
    files, i = Files(), 0
    while i < len(rows):
        first, j = rows[i], i + 1
        end = first["offset"] + first["length"]
        while j < len(rows) and rows[j]["file"] == first["file"] and rows[j]["offset"] == end and end - first["offset"] < READ_BYTES:
            end += rows[j]["length"]
            j += 1
        data = files.read(first["file"], first["offset"], end - first["offset"])
        for row in rows[i:j]:
            at = row["offset"] - first["offset"]
            yield row, data[at : at + row["length"]]
        i = j


def _records(keep: bool):
    """Records of lines: with payload, or with its length and digest only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for row, member in _ranges(batch.to_pylist()):
                fields, block = parse(member)
                kind, payload = fields["WARC-Type"], payload_of(block)
                refers = fields.get("WARC-Refers-To")
                size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                if kind == "revisit":
                    size, digest = None, base64.b32decode(fields["WARC-Payload-Digest"].split(":")[1]).hex()
                out.append((page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, payload if keep and kind == "response" else None,
                            size, digest, page_of(refers) if refers else None, row["refers_key"]))
                held += len(payload) if keep else 0
                if held > READ_BYTES or len(out) >= 10_000:
                    yield _read_batch(out)
                    out, held = [], 0
            yield _read_batch(out)

    return run


READ = "page_id bigint, url string, kind string, payload binary, size bigint, digest string, refers_to bigint, refers_key string"
READ_TYPES = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]
READ_NAMES = [part.split()[0] for part in READ.split(", ")]


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(READ_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, READ_TYPES)], READ_NAMES)


def read_records(lines: DataFrame, tasks: int, keep: bool = True) -> DataFrame:
    """The records (``READ``) of index lines by range reads, dealt by part of an archive and in its order.

    ``size`` and ``digest`` are those of the payload as read; a revisit has no size and the digest of its header.
    """
    part = F.floor(F.col("offset") / (4 * READ_BYTES))
    dealt = lines.repartition(tasks, "file", part).sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length", "refers_key").mapInArrow(_records(keep), READ)


def read_back(index: CaptureIndex) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every record of the archives.

    All captures of the index are read. What a revisit refers to is looked up in the index, every different one
    once, and its size and digest are those of the payload found there.
    """
    read = pin(read_records(index.captures(), index.tasks(), keep=False).drop("payload"))
    again = read.where("kind = 'revisit'")
    targets = index.find(again.select(F.col("refers_key").alias("key"), F.col("refers_to").alias("id"), "digest"))
    found = read_records(targets.where("kind = 'response'"), index.tasks(), keep=False)
    found = found.groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("size").alias("full"))
    # Many pages may revisit one: adaptive execution splits such a key on the left.
    again = again.join(found, ["refers_to", "digest"])
    whole = read.where("kind = 'response'").withColumn("full", F.col("size"))
    rows = whole.unionByName(again.select(*whole.columns))
    return rows.select("page_id", F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def archive(pages: DataFrame, **options) -> CaptureIndex:
    """Archives and their index in a new folder of the shared checkpoint folder; options as ``write_archives``.

    URLs need not be well formed: one without a host is its own key, a null one has an empty key and no header.
    Other columns are ignored; an empty table gives an empty index.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    return build_index(write_archives(pages, folder, **options), folder)
