"""Files of a store by offset and by name, as Python Data Sources: entries of archives in, files out.

Both run in Spark's Python workers, which open the store themselves (pyarrow's file systems: local folders, HDFS and
object stores by their URIs); nothing passes through the driver but names.

`archive` reads ZIP archives. A partition is a range of entries of one archive, planned from the archive's central
directory at its end (of very many ranges, several are a partition), so an archive is read where its entries lie and by as many tasks as it has bytes for. An entry
comes in pieces of bounded size. `files` writes rows as files with a commit: tasks write into a staging folder beside
the target, the job's commit renames it, an aborted job leaves nothing.
"""

from __future__ import annotations

import contextlib
import io
import os
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Bytes of an entry in one row, and packed bytes of a partition.
PIECE, SPLIT = 4 << 20, 64 << 20
#: Partitions that `split` may make; beyond, a partition takes several ranges, of some SPLIT bytes at most. What opening an archive costs, in bytes.
TASKS, OPEN = 200, 16 << 10
#: Rows of one Arrow batch, whose contents together have PIECE bytes and an entry's piece at most.
BATCH = 1000


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def safe(name: str) -> bool:
    """Whether a relative name stays below its folder."""
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in name.replace("\\", "/").split("/")


class Seekable(io.RawIOBase):
    """A stored file as zipfile reads it: a place before the file's start is an OSError."""

    def __init__(self, store: fs.FileSystem, path: str) -> None:
        self.file = store.open_input_file(path)
        self.at, self.end = 0, self.file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        to = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.end}[whence]
        if to < 0:
            raise OSError("before the start of the file")
        self.at = to
        return to

    def readinto(self, buffer) -> int:
        data = self.file.read_at(max(0, min(len(buffer), self.end - self.at)), self.at)
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


@contextlib.contextmanager
def archive_at(store: fs.FileSystem, path: str) -> Iterator[zipfile.ZipFile]:
    with io.BufferedReader(Seekable(store, path), 1 << 20) as raw, zipfile.ZipFile(raw) as archive:
        yield archive


@dataclass
class Entries(InputPartition):
    """Ranges (archive, start, end) of entries by the central directory, which follow each other; end None: to the last one."""

    ranges: list[tuple[str, int, int | None]]
    names: list[str] | None = field(default=None)
    prefix: str = ""

    def __init__(self, ranges: list[tuple[str, int, int | None]], names: list[str] | None = None, prefix: str = "") -> None:
        super().__init__(ranges)
        self.ranges, self.names, self.prefix = ranges, names, prefix

    def wants(self, name: str) -> bool:
        return safe(name) and (self.names is None or name in self.names) and name.startswith(self.prefix)


class ArchiveSource(DataSource):
    """spark.read.format("archive").load(folder or file): a row for each entry, or for each piece of its content.

    Options: content (true: the bytes too), entry (that one alone), pattern (a glob of archive names),
    split (packed bytes of a partition, as long as that makes no more than TASKS of them), mode (FAILFAST, the default, or PERMISSIVE: a broken archive gives one row
    with `error`). Entries whose names leave the archive's folder are dropped. Filters on entry_name (=, IN, LIKE 'x%')
    reach the source: other entries aren't read.
    """

    SCHEMA = "archive string, entry_no int, entry_name string, is_dir boolean, size long, packed_size long, crc32 long, piece int, content binary, error string"

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return self.SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.content = options.get("content", "false").lower() == "true"
        self.names = [options["entry"]] if "entry" in options else None
        self.prefix = ""
        self.pattern = options.get("pattern", "*")
        self.split = int(options.get("split", SPLIT))
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case EqualTo(("entry_name",), str(name)):
                    self._only([name])
                case In(("entry_name",), names) if all(isinstance(n, str) for n in names):
                    self._only(list(names))
                case StringStartsWith(("entry_name",), str(prefix)) if not self.prefix:
                    self.prefix = prefix
                case _:
                    yield f

    def _only(self, names: list[str]) -> None:
        self.names = names if self.names is None else [n for n in self.names if n in names]

    def partitions(self) -> list[Entries]:
        """One for a small archive or for names alone; of a large one, whose directory is read here, one for each `split` bytes.

        Where these would be more than TASKS, larger ranges are planned and several of them, of several archives, are one partition.
        """
        import fnmatch

        store, path = opened(self.root)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [info] if info.is_file else sorted((i for i in store.get_file_info(fs.FileSelector(path, recursive=True)) if i.is_file), key=lambda i: i.path)
        found = [i for i in found if info.is_file or fnmatch.fnmatch(i.base_name, self.pattern)]
        split, ranges = max(self.split, min(SPLIT, sum(i.size for i in found) // TASKS)), []
        for i in found:
            whole = not self.content or self.names is not None
            ranges += [(i.path, 0, None, 0 if whole else i.size)] if whole or i.size <= split else self._ranges(store, i, split)
        return [Entries(r, self.names, self.prefix) for r in self._dealt(ranges)]

    @staticmethod
    def _dealt(ranges: list[tuple[str, int, int | None, int]]) -> list[list[tuple[str, int, int | None]]]:
        """The ranges (with their bytes) of each partition."""
        if len(ranges) <= TASKS:
            return [[r[:3]] for r in ranges]
        total, out, held = sum(r[3] + OPEN for r in ranges), {}, 0
        tasks = max(TASKS, -(-total // SPLIT))
        for *r, size in ranges:
            out.setdefault(held * tasks // total, []).append(tuple(r))
            held += size + OPEN
        return list(out.values())

    def _ranges(self, store: fs.FileSystem, info: fs.FileInfo, split: int) -> list[tuple[str, int, int | None, int]]:
        out, start, held = [], 0, 0
        try:
            with archive_at(store, info.path) as archive:
                for k, x in enumerate(archive.infolist()):
                    if held and held + x.compress_size > split:
                        out.append((info.path, start, k, held))
                        start, held = k, 0
                    held += x.compress_size
        except zipfile.BadZipFile:
            return [(info.path, 0, None, info.size)]  # read() tells it
        return [*out, (info.path, start, None, held)]

    def read(self, partition: Entries | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # of a folder without archives
            return
        store, _ = opened(self.root)
        rows, size = [], 0
        for path, start, end in partition.ranges:
            try:
                with archive_at(store, path) as archive:
                    for k, x in enumerate(archive.infolist()[start:end], start):
                        for row in self._rows(path, k, archive, x) if partition.wants(x.filename) else ():
                            rows.append(row)
                            size += len(row[-2] or b"")
                            if len(rows) == BATCH or size >= PIECE:
                                yield self._batch(rows)
                                rows, size = [], 0
            except (zipfile.BadZipFile, EOFError, OSError, NotImplementedError, RuntimeError) as e:
                if not self.permissive:
                    raise
                rows.append((path, *[None] * 8, f"{type(e).__name__}: {e}"))
        if rows:
            yield self._batch(rows)

    def _rows(self, path: str, k: int, archive: zipfile.ZipFile, x: zipfile.ZipInfo) -> Iterator[tuple]:
        facts = (path, k, x.filename, x.is_dir(), x.file_size, x.compress_size, x.CRC)
        if not self.content or x.is_dir():
            yield (*facts, 0, None, None)
            return
        with archive.open(x) as body:  # checks the CRC at the end
            piece, data = 0, body.read(PIECE)
            while data or piece == 0:
                yield (*facts, piece, data, None)
                piece, data = piece + 1, body.read(PIECE)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string())
        names = [c.split()[0] for c in ArchiveSource.SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


@dataclass
class Written(WriterCommitMessage):
    """How many files and bytes a task has put into the staging folder."""

    files: int
    bytes: int


class FileSink(DataSource):
    """rows.write.format("files").mode(...).save(folder): a file for each row (path, content string or binary[, piece int]).

    Rows of one path that follow each other in a partition, piece after piece, are one file. Null contents make empty
    files. mode("overwrite") puts the new tree in the place of the old one, mode("append") adds to it and replaces files
    of the same names. Paths that would leave the folder fail the job.
    """

    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], self.options.get("job") or uuid.uuid4().hex, overwrite, schema.names)


class FileWriter(DataSourceWriter):
    def __init__(self, root: str, job: str, overwrite: bool, names: list[str]) -> None:
        if "path" not in names or "content" not in names:
            raise ValueError("files are written of rows with path and content")
        self.root, self.overwrite, self.job, self.names = root, overwrite, job, names
        _, path = opened(root)
        self.target = path.rstrip("/")
        self.staging = posixpath.join(posixpath.dirname(self.target), f".{posixpath.basename(self.target)}.staging-{job}")

    def write(self, rows: Iterator[Row]) -> Written:
        """Each file is written under a name of this attempt's own and then moved into the tree, so no part of one is ever there."""
        store, _ = opened(self.root)
        attempt = posixpath.join(self.staging, "attempts", uuid.uuid4().hex)
        store.create_dir(attempt, recursive=True)
        own, now, out, n, size = posixpath.join(attempt, "file"), None, None, 0, 0
        made: set[str] = set()

        def close() -> None:
            out.close()
            goal = posixpath.join(self.staging, "tree", now)
            folder = posixpath.dirname(goal)
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            store.move(own, goal)

        for r in rows:
            if r.path != now:
                if out is not None:
                    close()
                if r.path is None or not safe(r.path):
                    raise ValueError(f"paths must stay below the root: {r.path}")
                now, out, n = r.path, store.open_output_stream(own), n + 1
            data = r.content.encode() if isinstance(r.content, str) else bytes(r.content or b"")
            out.write(data)
            size += len(data)
        if out is not None:
            close()
        store.delete_dir(attempt)
        return Written(n, size)

    def commit(self, messages: list[Written | None]) -> None:
        """Puts the staged tree into its place: by one rename of a new or replaced folder, else by one of each file."""
        store, _ = opened(self.root)
        tree = posixpath.join(self.staging, "tree")
        store.create_dir(tree, recursive=True)
        there = store.get_file_info(self.target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            for info in store.get_file_info(fs.FileSelector(tree, recursive=True)):
                goal = self.target + info.path.removeprefix(tree)
                if info.is_file:
                    store.create_dir(posixpath.dirname(goal), recursive=True)
                    store.move(info.path, goal)
        else:
            old = posixpath.join(self.staging, "old")
            if there:
                store.move(self.target, old)
            else:
                store.create_dir(posixpath.dirname(self.target), recursive=True)
            store.move(tree, self.target)
        store.delete_dir(self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        """Leaves the target as it was."""
        store, _ = opened(self.root)
        if store.get_file_info(self.staging).type != fs.FileType.NotFound:
            store.delete_dir(self.staging)


def register(spark) -> None:
    """Makes both sources known to a session."""
    for source in (ArchiveSource, FileSink):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

