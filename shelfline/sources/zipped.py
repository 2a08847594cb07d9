"""Lines of zipped text files.

An archive's directory says where each member lies, so members are read one by
one by seeking: any number of tasks works on one archive, none holds its bytes,
and no size is too large.  File systems that only Spark reaches hand over whole
archives instead, up to Spark's limit for binary files.
"""

from __future__ import annotations

import hashlib
import io
import lzma
import re
import struct
import sys
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.catalog import SIDECAR_SUFFIXES
from shelfline.session import written


def ship_with_job(module: str) -> None:
    """Send the functions of a module along with the job that uses them.

    Executors then need no copy of this package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship_with_job(__name__)

MEMBER_SCHEMA = ("file_id string, nth int, member string, layout long, header string, "
                 "packed long, error string")
LINE_SCHEMA = ("file_id string, nth int, member string, layout long, line_no long, line string, "
               "error string")

_CHARS = 4_000_000
#: Packed bytes that one task reads, about; a larger member is one task.
TASK_BYTES = 32 << 20
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: File systems whose files are opened by seeking.
SEEKABLE = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_UNREADABLE = (
    zipfile.BadZipFile, zlib.error, lzma.LZMAError, struct.error, EOFError,
    NotImplementedError, RuntimeError, OSError, ValueError, pa.ArrowException,
)


# -- files ---------------------------------------------------------------------


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark spells it, and the path within."""
    scheme = re.match(_SCHEME, path)
    if scheme is None or scheme[1] == "file":
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return pafs.FileSystem.from_uri(quote(re.sub("^s3a:", "s3:", path), safe=":/@%"))


def open_by_seek(path: str) -> BinaryIO:
    files, inner = _file_system(path)
    return files.open_input_file(inner)


@contextmanager
def _archive(source: BinaryIO) -> Iterator[zipfile.ZipFile]:
    with source, zipfile.ZipFile(source) as archive:
        yield archive


def data_members(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """All files that are no checksum or signature, else the first file."""
    files = [m for m in archive.infolist() if not m.is_dir()]
    if not files:
        raise zipfile.BadZipFile("the archive holds no file")
    data = [m for m in files if not m.filename.lower().endswith(SIDECAR_SUFFIXES)]
    return data or files[:1]


def _chunks(archive: zipfile.ZipFile, member: zipfile.ZipInfo, size: int = _CHARS) -> Iterator[list[str]]:
    """The non-blank lines of a member in pieces, inflated as they are read."""
    with archive.open(member) as raw:
        text = io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline=None)
        rest = ""
        while piece := text.read(size):
            *whole, rest = (rest + piece).split("\n")
            yield [x for x in whole if x.strip(" ")]
        if rest.strip(" "):
            yield [rest]


def _layout(header: str) -> int:
    """Number of a header line.

    With it, rows of equally headed files can be read alike without joining
    every row to its header.
    """
    digest = hashlib.blake2b(header.encode("utf-8"), digest_size=8).digest()
    return int.from_bytes(digest, "big") >> 1


# -- tasks ---------------------------------------------------------------------


def _listed(file_id: str, source: Callable[[], BinaryIO]) -> list[tuple]:
    """A row of MEMBER_SCHEMA for every member that has a line; one row for a broken archive."""
    out = []
    try:
        with _archive(source()) as archive:
            for nth, member in enumerate(data_members(archive)):
                # A header is read in small pieces; most lie in the first.
                header = next((x[0] for x in _chunks(archive, member, 1 << 14) if x), None)
                if header is not None:
                    out.append((file_id, nth, member.filename, _layout(header), header, member.compress_size, None))
    except _UNREADABLE as e:
        return [(file_id, None, None, None, None, None, f"{type(e).__name__}: {e}")]
    return out or [(file_id, None, None, None, None, None, "the file holds no line")]


def _lines(batch_of: tuple, source: Callable[[], BinaryIO]) -> Iterator[pa.RecordBatch]:
    """Batches of LINE_SCHEMA with the data lines of one member; its header is line 0 and left out."""
    file_id, nth, name, layout = batch_of
    names = ["file_id", "nth", "member", "layout", "line_no", "line", "error"]

    def rows(first, lines, error=None) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([
            pa.repeat(pa.scalar(file_id, pa.string()), n),
            pa.repeat(pa.scalar(nth, pa.int32()), n),
            pa.repeat(pa.scalar(name, pa.string()), n),
            pa.repeat(pa.scalar(layout, pa.int64()), n),
            pa.array(range(first, first + n), pa.int64()),
            pa.array(lines, pa.string()),
            pa.repeat(pa.scalar(error, pa.string()), n),
        ], names=names)

    number = 0
    try:
        with _archive(source()) as archive:
            for lines in _chunks(archive, data_members(archive)[nth]):
                if not lines:
                    continue
                yield rows(max(number, 1), lines[1:] if number == 0 else lines)
                number += len(lines)
    except _UNREADABLE as e:
        yield rows(-1, [None], f"{type(e).__name__}: {e}")


def _member_batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = ["file_id", "nth", "member", "layout", "header", "packed", "error"]
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*found), kinds)], names=names)


def _list_by_seek(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file_id in batch.column("file_id").to_pylist():
            yield _member_batch(_listed(file_id, lambda: open_by_seek(file_id)))


def _read_by_seek(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one in zip(*[batch.column(c).to_pylist() for c in ("file_id", "nth", "member", "layout")]):
            yield from _lines(one, lambda: open_by_seek(one[0]))


def _decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of whole archives at hand, headers among them as line 0."""
    for batch in batches:
        for file_id, content in zip(batch.column("file_id"), batch.column("content")):
            source = lambda: io.BytesIO(content.as_py())  # noqa: B023, E731
            for one in _listed(file_id.as_py(), source):
                broken, header = one[6] is not None, one[4]
                yield pa.RecordBatch.from_arrays([
                    pa.array([v], k) for v, k in zip(
                        (*one[:4], -1 if broken else 0, header, one[6]),
                        (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))
                ], names=["file_id", "nth", "member", "layout", "line_no", "line", "error"])
                if not broken:
                    yield from _lines(one[:4], source)


# -- frames --------------------------------------------------------------------


@dataclass(frozen=True)
class Archives:
    """Delivered archives: a written table of their members, and the way to the lines.

    ``members`` has file_id, nth (place among the data members), member, layout,
    header and packed bytes; a broken archive is one row with ``error``.
    """

    members: DataFrame
    staged: DataFrame | None = None

    def lines(self, members: DataFrame) -> DataFrame:
        """The data lines of some of the members, with their number from 1.

        A member that breaks gives a row with ``error`` and line number -1.
        """
        picked = members.where("error IS NULL").select("file_id", "nth", "member", "layout", "packed")
        if self.staged is not None:
            wanted = picked.select("file_id", "nth")
            return self.staged.where("line_no <> 0").join(wanted, ["file_id", "nth"], "left_semi")
        n, packed = picked.agg(F.count(F.lit(1)), F.coalesce(F.sum("packed"), F.lit(0))).first()
        tasks = min(max(n, 1), max(1 + packed // TASK_BYTES, int(picked.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        # By ranges, as hashes would give some tasks several of a few large members.
        spread = picked.select("file_id", "nth", "member", "layout").repartitionByRange(tasks, "file_id", "nth")
        return spread.mapInArrow(_read_by_seek, LINE_SCHEMA)


def open_archives(files: DataFrame) -> Archives:
    """Members of the archives in ``files`` (file_id: a path), none of which comes to the driver."""
    spark = files.sparkSession
    files = files.select("file_id")
    scheme = F.regexp_extract("file_id", _SCHEME, 1)
    schemes = [r[0] for r in files.select(scheme.alias("scheme")).distinct().collect()]
    if all(s in ("", *SEEKABLE) for s in schemes):
        found = files.repartition("file_id").mapInArrow(_list_by_seek, MEMBER_SCHEMA)
        return Archives(written(found, "members"))
    # Spark alone can read these: whole archives, decoded once.
    paths = [r[0] for r in files.collect()]
    with one_file_per_batch(spark):
        staged = written(read_zip_lines(read_files(spark, paths)), "lines")
    return Archives(members_of(staged), staged)


def members_of(lines: DataFrame) -> DataFrame:
    """The members behind decoded lines, from their headers."""
    return lines.where("line_no <= 0").select(
        "file_id", "nth", "member", "layout", F.when(F.col("line_no") == 0, F.col("line")).alias("header"),
        F.lit(0).cast("long").alias("packed"), "error")


def read_zip_lines(files: DataFrame) -> DataFrame:
    """Lines of the data members of every archive in ``(file_id, content)``.

    Line 0 of each member is its header.  An unreadable archive gives one row
    with ``error`` and line number -1.
    """
    return files.select("file_id", "content").mapInArrow(_decode, LINE_SCHEMA)


class one_file_per_batch:
    """Hands archives to the decoder one at a time while the block runs.

    Arrow batches are cut by rows before they are cut by bytes, and a batch of
    whole archives would not fit in memory.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark

    def __enter__(self):
        self._before = self._spark.conf.get(_ARROW_ROWS)
        self._spark.conf.set(_ARROW_ROWS, "1")

    def __exit__(self, *exc):
        self._spark.conf.set(_ARROW_ROWS, self._before)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Content of the named archives."""
    return spark.read.format("binaryFile").load(paths).select(
        F.col("path").alias("file_id"), "content"
    )


# -- writing -------------------------------------------------------------------


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, str, memoryview]]:
    """File, member and the text of the lines that follow each other in one member."""
    lines, n = batch.column("line"), batch.num_rows
    if lines.null_count or batch.column("file").null_count or batch.column("member").null_count:
        raise ValueError("a line, its file or its member is null")
    if not n:
        return
    ended = pc.binary_join_element_wise(lines.cast(pa.large_binary()), pa.scalar(b"\r\n", pa.large_binary()),
                                        pa.scalar(b"", pa.large_binary()))
    places = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset:ended.offset + n + 1]
    text = memoryview(ended.buffers()[2])
    codes = [np.asarray(batch.column(c).dictionary_encode().indices) for c in ("file", "member")]
    starts = [0, *(1 + np.flatnonzero((codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1]))).tolist()]
    for start, end in zip(starts, [*starts[1:], n]):
        yield batch.column("file")[start].as_py(), batch.column("member")[start].as_py(), text[places[start]:places[end]]


def _pack(folder: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(folder)
        out, archive, member, name, done = None, None, None, (None, None), []

        def close() -> None:
            if member is not None:
                member.close()

        def finish() -> None:
            close()
            if archive is not None:
                archive.close()
                out.close()
                # Seen whole or not at all; a task that runs again replaces it.
                files.move(f"{root}/_{name[0]}.part", f"{root}/{name[0]}")

        for batch in batches:
            for file, inner, lines in _runs(batch):
                if file != name[0]:
                    finish()
                    out = files.open_output_stream(f"{root}/_{file}.part")
                    archive, member, name = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), None, (file, None)
                    done.append(file)
                if inner != name[1]:
                    close()
                    # A fixed date, so that equal lines make equal archives.
                    info = zipfile.ZipInfo(inner)
                    info.compress_type = zipfile.ZIP_DEFLATED
                    member = archive.open(info, "w", force_zip64=True)
                    name = (file, inner)
                member.write(lines)
        finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])

    return run


def write_archives(lines: DataFrame, folder: str) -> DataFrame:
    """Zip archives in ``folder``, each made by one task as a stream; returns their names.

    ``lines`` has file (a name), member, line_no (unique in its member) and line
    (text or bytes).  A file of the same name is replaced.
    """
    files, root = _file_system(folder)
    files.create_dir(root, recursive=True)
    ordered = lines.select("file", "member", "line_no", F.col("line").cast("binary").alias("line")).repartition(
        "file").sortWithinPartitions("file", "member", "line_no")
    return written(ordered.mapInArrow(_pack(folder), "file string"), "archives")
