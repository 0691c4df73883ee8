"""SRC11 as a data source: the files of zip archives in a folder, one row each.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("archives").load(folder)

Partitions are stretches of about equal size: small archives together, and a large archive dealt to several tasks, each of which reads the
archive's directory and then its own members, one at a time. Nothing holds an archive, and the driver sees names and sizes only. An archive that is broken or
has too many files is one row with that status; the job goes on."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairnlake.sources.readers import TooManyFiles, archive_plan

#: Bytes of archives that one task reads.
STRETCH = 16 << 20
SCHEMA = "archive string, nth int, title string, status string, size long, content binary"


class _Seekable(io.RawIOBase):
    """A file of the store as Python's zip reader expects it: a seek before the start is an OSError."""

    def __init__(self, file) -> None:
        self.file, self.size = file, file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.file.tell(), io.SEEK_END: self.size}[whence]
        if at < 0:
            raise OSError("seek before the start")
        self.file.seek(min(at, self.size))
        return at

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)


def seekable(file) -> io.BufferedReader:
    """A file of the store as the zip reader takes it."""
    return io.BufferedReader(_Seekable(file), 1 << 20)


@dataclass
class Stretch(InputPartition):
    pieces: list[tuple[str, int, int]]  # path, which part, of how many


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, stretch: int) -> None:
        self.folder, self.stretch = folder, stretch

    def partitions(self) -> list[Stretch]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        pieces = []
        for f in sorted((f for f in found if f.is_file and f.path.lower().endswith(".zip")), key=lambda f: f.path):
            parts = max(1, -(-f.size // self.stretch))
            pieces += [(f.size // parts, (f.path, p, parts)) for p in range(parts)]
        out, size = [Stretch([])], 0  # a source needs a partition, also without archives
        for n, piece in pieces:
            if out[-1].pieces and size + n > self.stretch:
                out.append(Stretch([]))
                size = 0
            out[-1].pieces.append(piece)
            size += n
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for path, part, of in partition.pieces:
            yield from self._members(path, part, of)

    def _members(self, path: str, part: int, of: int) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        name = path.rsplit("/", 1)[-1]
        with fs.open_input_file(path) as file:
            try:
                z = zipfile.ZipFile(seekable(file))
                plan = archive_plan(z)
            except (zipfile.BadZipFile, TooManyFiles) as e:
                if part == 0:
                    yield name, None, None, "too_many_files" if isinstance(e, TooManyFiles) else "broken", None, None
                return
            for nth, (info, title, status) in enumerate(plan):
                if nth % of != part:
                    continue
                content = None
                if status == "ok":
                    try:
                        content = z.read(info)
                    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                        status = "broken"  # its checksum or coding is wrong, or it is encrypted
                yield name, nth, title, status, info.file_size, content


class ArchiveSource(DataSource):
    """Options: path (a folder), stretch (bytes of an archive for one task)."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("stretch", STRETCH)))
