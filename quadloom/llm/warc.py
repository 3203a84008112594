"""WARC: normaliser of monolithic gzip files.

Archives are often one gzip stream over the whole file, which can only be read from its start. Each
such file is inflated once, as a stream; every record is written as a gzip member of its own, and a
sidecar index lists where each member lies, so that a record can be read by seeking to it. Files of
several members, aligned with records or not, are read the same way.

A file is one task's work, since its stream can't be entered midway; memory is bounded by a copy
buffer and the longest header allowed, not by the record or file. Outputs are written beside their place and moved there when
complete, and equal inputs give equal bytes, so a task that is run again does no harm; what a failed one leaves it removes.
An output is named after its file and a hash of the whole path, so files of one name in several folders keep apart.

A damaged file (cut short, bad checksum, malformed record, a header line above ``LINE`` bytes or a header above ``HEADER``)
yields its records up to the damage, and one
row of record_type "error" that says what was wrong; other files go on. An empty file yields no
record. A record without a target URI has a null uri. A null path gives nothing; a path that is listed again
is rewritten and indexed again, with the same rows. Other columns of the table of files, of any name, are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.arrowtext import mapped
from quadloom.llm.storage import new_folder, written

LEVEL = 6
CHUNK = 1 << 18
LINE, HEADER = 1 << 16, 1 << 20
INDEX = "file string, source string, record_no int, offset long, length long, record_type string, record_id string, uri string, content_length long, digest string, problem string"
_NAMES = [c.split()[0] for c in INDEX.split(", ")]


class _Counted:
    """A file that members are appended to, with the place reached."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)


def _line(stream) -> bytes:
    line = stream.readline(LINE + 1)
    if len(line) > LINE:
        raise ValueError("header line too long")
    return line


def _header(stream) -> tuple[bytes, dict[str, str]] | None:
    """Header block up to and including its empty line, and its fields; None at the end of the file."""
    line = _line(stream)
    while line in (b"\r\n", b"\n"):
        line = _line(stream)
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record at {line[:40]!r}")
    block, fields, name, size = [line], {}, None, len(line)
    while True:
        line = _line(stream)
        if not line:
            raise EOFError("header cut short")
        block.append(line)
        size += len(line)
        if size > HEADER:
            raise ValueError("header too long")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            return b"".join(block), fields
        if text[0] in " \t" and name:
            fields[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()


def _length(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not value.isdigit():
        raise ValueError(f"bad Content-Length {value[:40]!r}")
    return int(value)


def normalise_stream(source, sink, level: int = LEVEL) -> Iterator[tuple]:
    """Copies records from source to sink, one member each; (offset, length, type, id, uri, content length, digest, problem) of each.

    A record's member is begun only with its header and ended before the next; where the source is damaged
    within a record, the sink ends with that unfinished member, which the index does not list.
    """
    stream, sink = io.BufferedReader(gzip.GzipFile(fileobj=source, mode="rb"), CHUNK), _Counted(sink)
    try:
        while (head := _header(stream)) is not None:
            block, fields = head
            left = size = _length(fields)
            begin, digest = sink.at, hashlib.sha1()
            member = zlib.compressobj(level, zlib.DEFLATED, 31)
            sink.write(member.compress(block))
            while left:
                data = stream.read(min(left, CHUNK))
                if not data:
                    raise EOFError("content cut short")
                digest.update(data)
                sink.write(member.compress(data))
                left -= len(data)
            sink.write(member.compress(b"\r\n\r\n"))
            sink.write(member.flush())
            yield begin, sink.at - begin, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), size, "sha1:" + digest.hexdigest(), None
    except (EOFError, ValueError, OSError, zlib.error) as e:
        yield None, None, "error", None, None, None, None, f"{type(e).__name__}: {e}"[:300]


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _discard(fs: pafs.FileSystem, *paths: str) -> None:
    for info in fs.get_file_info(list(paths)):
        if info.type == pafs.FileType.File:
            fs.delete_file(info.path)


def normalise(files: DataFrame, out_dir: str, path: str = "path", level: int = LEVEL) -> DataFrame:
    """Index rows of the files named in files.path, rewritten into out_dir as <file> and <file>.idx.

    The rewriting happens when the rows are computed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if name is not None:
                    yield from rewrite(name)

    def rewrite(name: str) -> Iterator[pa.RecordBatch]:
        fs, at = _place(name)
        to, folder = _place(out_dir)
        base = f"{hashlib.sha1(at.encode()).hexdigest()[:12]}-{posixpath.basename(at)}"
        mark = f".{uuid.uuid4().hex[:8]}.tmp"
        final = posixpath.join(folder, base)
        rows: list[tuple] = []
        try:
            with fs.open_input_stream(at, compression=None) as source, to.open_output_stream(final + mark, compression=None) as sink, to.open_output_stream(final + ".idx" + mark, compression=None) as index:
                for no, row in enumerate(normalise_stream(source, sink, level)):
                    rows.append((base, name, no, *row))
                    index.write((json.dumps(dict(zip(_NAMES[2:], rows[-1][2:]))) + "\n").encode())
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
            to.move(final + mark, final)
            to.move(final + ".idx" + mark, final + ".idx")
        except BaseException:
            _discard(to, final + mark, final + ".idx" + mark)
            raise
        if rows:
            yield _batch(rows)

    n = files.count()
    spark = files.sparkSession
    to, folder = _place(out_dir)
    to.create_dir(folder, recursive=True)
    # A file to a task: a number that is given is not merged by adaptive execution.
    spread = files.select(path).repartition(max(1, n)) if n > 1 else files.select(path)
    return spread.transform(mapped, run, INDEX) if n else spark.createDataFrame([], INDEX)


_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]]) for c in INDEX.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def read_record(path: str, offset: int, length: int) -> bytes:
    """The record at a place that the index names: header, content and end."""
    fs, at = _place(path)
    with fs.open_input_file(at) as f:
        return zlib.decompress(f.read_at(length, offset), 31)


def checked(index: DataFrame, out_dir: str) -> DataFrame:
    """index with readable: whether the bytes at the place named are one member that holds the record with this digest; null for errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _place(out_dir)
        name = f = None
        for batch in batches:
            good = []
            for file, offset, length, digest in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "digest"))):
                if offset is None:
                    good.append(None)
                    continue
                if file != name:
                    name, f = file, fs.open_input_file(posixpath.join(folder, file))
                good.append(_is_record(f, offset, length, digest))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good, pa.bool_())], names=[*_NAMES, "readable"])

    return index.select(*_NAMES).transform(mapped, run, INDEX + ", readable boolean")


def _is_record(f, offset: int, length: int, digest: str) -> bool:
    """Inflates the member piece by piece."""
    f.seek(offset)
    member, sha, head, tail = zlib.decompressobj(31), hashlib.sha1(), b"", b""
    while length:
        data = f.read(min(length, CHUNK))
        if not data:
            return False
        length -= len(data)
        while data:
            out = member.decompress(data, CHUNK)
            data = member.unconsumed_tail
            if head is not None:
                head += out
                if b"\r\n\r\n" not in head:
                    continue
                out, head = head.partition(b"\r\n\r\n")[2], None
            tail += out
            sha.update(tail[:-4])
            tail = tail[-4:]
    return member.eof and not member.unused_data and tail == b"\r\n\r\n" and "sha1:" + sha.hexdigest() == digest


def pack(pages: DataFrame, out_dir: str, html: str = "html", url: str = "url", key: str = "page_id", level: int = 1) -> DataFrame:
    """path, n_records: pages as monolithic WARC files, one gzip stream per partition, with a warcinfo record first.

    Null html is an empty content; a null url leaves the target URI out; a null key has an empty id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        to, folder = _place(out_dir)
        base = f"pages-{TaskContext.get().partitionId():05d}.warc.gz"
        mark = f".{uuid.uuid4().hex[:8]}.tmp"
        n = 0
        with to.open_output_stream(posixpath.join(folder, base) + mark, compression=None) as sink:
            stream = zlib.compressobj(level, zlib.DEFLATED, 31)
            info = b"software: quadloom\r\n"
            sink.write(stream.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:info>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(info), info)))
            for batch in batches:
                for k, u, h in zip(*(c.to_pylist() for c in batch.columns)):
                    content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (h or "").encode()
                    target = f"WARC-Target-URI: {' '.join(u.split())}\r\n" if u is not None else ""
                    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if k is None else k}>\r\n{target}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(content)}\r\n\r\n"
                    sink.write(stream.compress(head.encode() + content + b"\r\n\r\n"))
                    n += 1
            sink.write(stream.flush())
        to.move(posixpath.join(folder, base) + mark, posixpath.join(folder, base))
        yield pa.RecordBatch.from_arrays([pa.array([out_dir + "/" + base]), pa.array([n], pa.int64())], names=["path", "n_records"])

    to, folder = _place(out_dir)
    to.create_dir(folder, recursive=True)
    return pages.select(F.col(key).cast("string"), F.col(url).cast("string"), F.col(html).cast("string")).transform(mapped, run, "path string, n_records long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages packed into monolithic WARC files, these normalised, and a row per page from the index, its record read back by its place.

    The index itself (file, offset, length, record_no, and the info record of each file) lies beside the files; it
    depends on how many files the pages were packed into, and so is not in these rows.
    """
    manifest = written(pack(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark, "warc")), "manifest")
    members = new_folder(spark, "members")
    index = checked(written(normalise(manifest, members), "index"), members)
    page = F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(.*)>$', 1) as bigint)").alias("page_id")
    return index.where("record_type <> 'warcinfo'").select(page, "record_type", "uri", "content_length", "digest", "problem", "readable")


SQL = r"""
WITH contents AS (
  SELECT page_id, trim(regexp_replace(url, '\s+', ' ', 'g')) AS uri,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS content
  FROM pages)
SELECT page_id, 'response' AS record_type, uri, octet_length(encode(content)) AS content_length, 'sha1:' || sha1(content) AS digest, CAST(NULL AS VARCHAR) AS problem, TRUE AS readable
FROM contents"""
