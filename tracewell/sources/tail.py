"""A data source of the complete lines of growing log files, for batches and streams: format `tailed_lines`.

    spark.dataSource.register(TailedLines)
    spark.readStream.format("tailed_lines").option("path", folder).load()

Rows are (path, offset, length, modified, fresh, value): offset is the line's first byte, length its bytes with the line
end. Files come by time of change, then name. A stream's offset says for each file how far it has been read and two
checksums of what was read; a file that grew goes on there, one that was truncated or rewritten starts anew. The first
row of a file that starts (anew) has fresh set, no value and a length of 0, so that its old rows can be replaced even
where it has no line now. A line that has no end yet waits for it; in a batch it is a line.

Files are read through pyarrow's file systems, so paths may be local, hdfs:// or s3://. A large file is read in ranges.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a range, and bytes at the head and before the end of what was read that are checked.
RANGE, CHECKED = 64 << 20, 1024

SCHEMA = "path string, offset long, length int, modified timestamp, fresh boolean, value string"


class Range(InputPartition):
    """Lines whose first byte lies from start to end; `whole` takes a last line without an end too."""

    def __init__(self, path: str, start: int, end: int, modified: float, fresh: bool, whole: bool):
        self.path, self.start, self.end, self.modified, self.fresh, self.whole = path, start, end, modified, fresh, whole


class File(NamedTuple):
    path: str
    size: int
    modified: float


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def listed(paths: Sequence[str], suffix: str) -> list[File]:
    """Files and the files of folders (not of folders in them) with the suffix, by time of change, then name."""
    out = {}
    for path in paths:
        system, at = _system(path)
        info = system.get_file_info(at)
        found = system.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
        for f in found:
            if f.type == fs.FileType.File and (f.path == at or f.path.endswith(suffix)):
                name = path if f.path == at else f"{path.rstrip('/')}/{f.base_name}"
                out[name] = File(name, f.size, f.mtime.timestamp() if f.mtime else 0.0)
    return sorted(out.values(), key=lambda f: (f.modified, f.path))


def _bytes(f, start: int, end: int) -> bytes:
    f.seek(start)
    return f.read(end - start)


def _checks(f, end: int) -> list[int]:
    return [zlib.crc32(_bytes(f, 0, min(end, CHECKED))), zlib.crc32(_bytes(f, max(0, end - CHECKED), end))]


def _line_end(f, size: int) -> int:
    """Where the last complete line ends."""
    at = size
    while at > 0:
        start = max(0, at - (64 << 10))
        found = _bytes(f, start, at).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


def ranges(file: File, start: int, end: int, fresh: bool, whole: bool, size: int = RANGE) -> list[Range]:
    cuts = list(range(start, end, size)) or [start]
    return [Range(file.path, a, min(a + size, end), file.modified, fresh and a == start, whole) for a in cuts if a < end or fresh]


class _Raw(io.RawIOBase):
    """What io needs to read lines of an Arrow file in large steps."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def lines(part: Range) -> Iterator[tuple]:
    system, at = _system(part.path)
    modified = datetime.fromtimestamp(part.modified, timezone.utc)
    if part.fresh and not part.whole:
        yield part.path, 0, 0, modified, True, None
    with system.open_input_file(at) as raw:
        raw.seek(max(0, part.start - 1))
        f = io.BufferedReader(_Raw(raw), 1 << 20)
        offset = part.start
        if part.start and (skipped := f.readline()) != b"\n":
            offset += len(skipped) - 1  # the rest of a line that starts in the range before
        while offset < part.end:
            line = f.readline()
            if not line or (not line.endswith(b"\n") and not part.whole):
                break
            yield part.path, offset, len(line), modified, False, line.rstrip(b"\r\n").decode("utf-8", "replace")
            offset += len(line)


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.suffix = _paths(options), options.get("suffix", ".jsonl")

    def partitions(self) -> Sequence[Range]:
        return [r for f in listed(self.paths, self.suffix) for r in ranges(f, 0, f.size, False, True)]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        return lines(partition) if partition else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.suffix = _paths(options), options.get("suffix", ".jsonl")
        self.seen: dict[str, tuple[File, list]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """For each file [where its last complete line ends, checksums of what is before, time of change]."""
        out = {}
        for f in listed(self.paths, self.suffix):
            if f.path not in self.seen or self.seen[f.path][0] != f:
                system, at = _system(f.path)
                with system.open_input_file(at) as raw:
                    end = _line_end(raw, f.size)
                    self.seen[f.path] = f, [end, *_checks(raw, end), f.modified]
            out[f.path] = self.seen[f.path][1]
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        out = []
        for path, (upto, *checks) in sorted(end.items(), key=lambda x: (x[1][3], x[0])):
            before = start.get(path)
            if before and before[:3] == [upto, *checks[:2]]:
                continue
            at, fresh = (before[0], False) if before and self._grown(path, before, upto) else (0, True)
            out += ranges(File(path, upto, checks[2]), at, upto, fresh, False)
        return out

    def _grown(self, path: str, before: list, upto: int) -> bool:
        """Whether what was read of the file is still there."""
        if upto < before[0]:
            return False
        system, at = _system(path)
        with system.open_input_file(at) as raw:
            return _checks(raw, before[0]) == before[1:3]

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines(partition)


def _paths(options: dict[str, str]) -> list[str]:
    """One path, or a JSON list of paths."""
    given = options["path"]
    return json.loads(given) if given.startswith("[") else [given]


class TailedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)
