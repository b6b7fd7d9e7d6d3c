"""File sources: repository archives, landed trees, ignore files."""

from __future__ import annotations

import bz2
import io
import re
import struct
import sys
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposieve import fixed
from reposieve.functions.text import decode_utf8
from reposieve.operators.select import path_selected

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Opens a URI as a seekable binary file, in a task.
Opener = Callable[[str], BinaryIO]
#: Lists what is below a URI, in a task.
Lister = Callable[[str], Iterable[tuple[str, bool, int]]]
ARCHIVE_FILE = "archive string, path string, length bigint, content string, error string"
_ARROW = pa.schema([
    ("archive", pa.string()), ("path", pa.string()), ("length", pa.int64()),
    ("content", pa.string()), ("error", pa.string()),
])
# Members are handed on in batches of about this many bytes.
_BATCH_BYTES = 16 << 20


def members(body: bytes, max_bytes: int | None) -> Iterator[tuple[str, int, str | None, str | None]]:
    """``(path, length, text, error)`` of the files of a zip; the first path component goes.

    Members over ``max_bytes`` are listed with their length, but not unpacked. A damaged
    member has an error and costs no other one.
    """
    with zipfile.ZipFile(io.BytesIO(body)) as zf:
        for info in zf.infolist():
            path = info.filename.split("/", 1)[-1]
            if info.is_dir() or not path:
                continue
            if max_bytes is not None and info.file_size > max_bytes:
                yield path, info.file_size, None, None
                continue
            try:
                raw = zf.read(info)
            except Exception as e:
                yield path, info.file_size, None, f"{type(e).__name__}: {e}"
                continue
            yield path, len(raw), raw.decode("utf-8", "ignore"), None


def _unzip(max_bytes: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for archive, body in zip(batch.column("archive"), batch.column("body")):
                name = archive.as_py()
                try:
                    for path, n, text, error in members(body.as_py(), max_bytes):
                        rows.append({"archive": name, "path": path, "length": n, "content": text, "error": error})
                        held += n if text is not None else 0
                        if held >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, held = [], 0
                except Exception as e:
                    rows.append({"archive": name, "error": f"{type(e).__name__}: {e}"})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def _archive_parts(archive: Column) -> list[Column]:
    """Owner and name from ``owner__name.zip`` or ``.../owner/name.zip``."""
    stem = F.regexp_replace(archive, r"\.zip$", "")
    base = F.element_at(F.split(stem, "/"), -1)
    folder = F.try_element_at(F.split(stem, "/"), F.lit(-2))
    joined = F.contains(base, F.lit("__"))
    return [
        F.when(joined, F.substring_index(base, "__", 1)).otherwise(folder).alias("owner"),
        F.when(joined, F.substr(base, F.locate("__", base) + 2)).otherwise(base).alias("name"),
    ]


def unpack_archives(archives: DataFrame, max_bytes: int | None = fixed.MAX_BYTES) -> DataFrame:
    """Files of ``archives(archive, body)``; an unreadable archive gives one row with ``error``."""
    return archives.select("archive", "body").mapInArrow(_unzip(max_bytes), ARCHIVE_FILE)


#: Compressed bytes of one archive that one task fetches.
RANGE = 64 << 20
_MEMBER = "archive string, path string, length long, start long, packed long, method int, crc long, error string"
_LOCAL = "<4s22xHH"  # local header: signature, lengths of name and extra field


def open_uri(uri: str):
    """A seekable file of any store that pyarrow knows; others need an opener of their own."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(_encoded(uri))
    return store.open_input_file(path)


def _encoded(uri: str) -> str:
    uri = uri if ":" in uri.split("/", 1)[0] else f"file://{uri}"
    return re.sub(r"^file:/+", "file:///", quote(uri, safe="/:@+,=~&;!$'()"))


def _directories(open_file: Opener):
    """Members of archives from their central directories; no body is read."""
    names = [f.split()[0] for f in _MEMBER.split(", ")]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                try:
                    with open_file(archive) as f, zipfile.ZipFile(f) as zf:
                        for info in zf.infolist():
                            path = info.filename.split("/", 1)[-1]
                            if not info.is_dir() and path:
                                locked = "encrypted" if info.flag_bits & 1 else None
                                rows.append((archive, path, info.file_size, info.header_offset, info.compress_size,
                                             info.compress_type, info.CRC, locked))
                except Exception as e:
                    rows = [(archive, *[None] * 6, f"{type(e).__name__}: {e}")]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k:k + 10_000]), kinds)], names=names)

    return run


def _unpacked(packed: bytes, method: int, size: int, crc: int) -> bytes:
    if method == zipfile.ZIP_STORED:
        raw = packed
    elif method == zipfile.ZIP_DEFLATED:
        raw = zlib.decompressobj(-15).decompress(packed, size + 1)  # never more than one byte beyond what is announced
    elif method == zipfile.ZIP_BZIP2:
        raw = bz2.BZ2Decompressor().decompress(packed, size + 1)
    else:
        raise NotImplementedError(f"compression method {method}")
    if len(raw) != size or zlib.crc32(raw) != crc:
        raise zipfile.BadZipFile("size or checksum does not fit")
    return raw


def _fetched(open_file: Opener):
    """Bodies of members by ranged reads; a damaged member has an error and costs no other one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, rows, held = None, None, [], 0
        for batch in batches:
            for m in batch.to_pylist():
                row = {"archive": m["archive"], "path": m["path"], "length": m["length"], "error": m["error"]}
                try:
                    if m["start"] is not None and m["error"] is None:
                        if m["archive"] != name:
                            if file:
                                file.close()
                            name, file = m["archive"], open_file(m["archive"])
                        file.seek(m["start"])
                        signature, *lengths = struct.unpack(_LOCAL, file.read(struct.calcsize(_LOCAL)))
                        if signature != b"PK\x03\x04":
                            raise zipfile.BadZipFile("no member where the directory has one")
                        file.seek(m["start"] + struct.calcsize(_LOCAL) + sum(lengths))
                        raw = _unpacked(file.read(m["packed"]), m["method"], m["length"], m["crc"])
                        row["content"] = raw.decode("utf-8", "ignore")
                        held += len(raw)
                except Exception as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
                if held >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if file:
            file.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def read_archives(
    spark: SparkSession, glob: str, max_bytes: int | None = fixed.MAX_BYTES,
    wanted: Callable[[Column], Column] | None = None, open_file: Opener = open_uri,
) -> tuple[DataFrame, DataFrame]:
    """``files`` and ``errors(owner, name, message)`` of zip archives of any size.

    Archives are listed without their bodies, then their central directories are read, then the members
    ``wanted`` by path are fetched by ranges: an archive is spread over as many tasks as it has ranges of ``RANGE``
    bytes. Other members are never read; those over ``max_bytes`` keep their length and have no content.
    """
    listed = spark.read.format("binaryFile").load(glob).select(F.col("path").alias("archive"), "length")
    count, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    # A fixed number of partitions, since rows without bodies look small to the optimizer.
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // RANGE))
    found = listed.select("archive").repartition(max(1, min(count, tasks)), "archive").mapInArrow(_directories(open_file), _MEMBER)
    chosen = found.filter(F.col("error").isNotNull() | wanted(F.col("path"))) if wanted else found
    if max_bytes is not None:
        chosen = chosen.withColumn("start", F.when(F.col("length") <= max_bytes, F.col("start")))
    part = F.floor(F.col("start") / RANGE)
    rows = chosen.repartition(tasks, "archive", part).sortWithinPartitions("archive", "start").mapInArrow(_fetched(open_file), ARCHIVE_FILE)
    owner, name = _archive_parts(F.col("archive"))
    files = rows.filter(F.col("error").isNull()).select(owner, name, "path", "length", "content")
    errors = rows.filter(F.col("error").isNotNull()).select(owner, name, F.col("error").alias("message"))
    return files, errors


def select_blobs(
    listing: DataFrame,
    max_bytes: int = fixed.MAX_BYTES,
    include: tuple[str, ...] = (),
    exclude: tuple[str, ...] = (),
) -> DataFrame:
    """Files of a tree listing ``(type, length, path)`` whose bodies are worth reading."""
    return listing.filter(
        (F.col("type") == "blob") & (F.col("length") <= max_bytes)
    ).filter(path_selected(F.col("path"), include, exclude))


def list_uri(uri: str) -> Iterator[tuple[str, bool, int]]:
    """``(path below, is a file, bytes)`` of everything in a folder of any store that pyarrow knows."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(_encoded(uri))
    for info in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        yield info.path[len(base.rstrip("/")) + 1:], info.is_file, info.size


def _listed(list_files: Lister):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, uri in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(owner, *path.split("/", 1), size, f"{uri}/{path}")
                        for path, is_file, size in list_files(uri) if is_file and "/" in path]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k:k + 10_000])], names=["owner", "name", "path", "length", "uri"])

    return run


def _opened(open_file: Opener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["owner", "name", "path", "length", "content"])

        rows, held = [], 0
        for batch in batches:
            for *key, uri in zip(*(c.to_pylist() for c in batch.columns)):
                with open_file(uri) as f:
                    body = f.read()
                rows.append((*key, len(body), body))
                held += len(body)
                if held >= _BATCH_BYTES:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    return run


def read_tree(
    spark: SparkSession,
    root: str,
    max_bytes: int = fixed.MAX_BYTES,
    include: tuple[str, ...] = (),
    exclude: tuple[str, ...] = (),
    list_files: Lister = list_uri,
    open_file: Opener = open_uri,
) -> DataFrame:
    """Files under ``root/owner/name/...``, hidden ones and those with leading underscores too.

    Tasks list the folders of owners; size and path are tested on the listing, and only what is
    selected is opened, spread over all tasks.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    owners = [s.getPath() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if s.isDirectory()]
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folders = spark.createDataFrame([(p.getName(), p.toString()) for p in owners], "owner string, uri string")
    listing = folders.repartition(min(n, max(1, len(owners))), "owner").mapInArrow(
        _listed(list_files), "owner string, name string, path string, length long, uri string")
    chosen = select_blobs(listing.withColumn("type", F.lit("blob")), max_bytes, include, exclude)
    # A number of partitions is given, since a listing looks too small to be spread.
    bodies = chosen.select("owner", "name", "path", "uri").repartition(n, "owner", "name", "path").mapInArrow(
        _opened(open_file), "owner string, name string, path string, length long, content binary")
    return bodies.withColumn("content", decode_utf8(F.col("content")))


def read_ignore(spark: SparkSession, path: str) -> list[str]:
    """Globs of an ignore file: trimmed, without blanks and comments. A missing file has none."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    glob = F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("glob")
    kept = lines.select(glob).filter((F.col("glob") != "") & ~F.col("glob").startswith("#"))
    # A configuration file: its lines become literals of the plan.
    return [r["glob"] for r in kept.toLocalIterator()]
