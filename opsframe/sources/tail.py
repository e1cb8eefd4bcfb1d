"""A stream source of the lines that are appended to growing files: `spark.readStream.format("tail_lines")`.

An offset holds, for each file below the folder, how many of its bytes have been read and the checksums of its first 1, 2,
4, ... bytes up to HEAD. The checksums tell a file that grew from one that took its name, so

  * appended lines are read from where the offset ends, also after a restart from the checkpoint;
  * a file that was cut to less than was read, or begins otherwise, is read from its start;
  * a file that was renamed (rotated) goes on under its new name, so its last lines aren't lost and none come twice;
  * a line without its line end waits until it has one.

What a batch reads follows from its two offsets alone, so a batch that is run again reads the same bytes. Byte ranges are
dealt to tasks in parts of `partBytes`; a line belongs to the part in which it begins. Files are reached through
pyarrow's file systems (local, S3, HDFS, ...); the folder must be one that the driver and all executors see.

Two files of one name that agree in their first HEAD bytes, the later at least as long as what was read, can't be told
apart. A folder may hold many files, but each takes some two hundred bytes in every offset.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD = 1024
PART_BYTES = 64 << 20
CHUNK = 1 << 20
SCHEMA = "value string, file string, at long"


@dataclass
class Part(InputPartition):
    """The lines of `file` that begin in [begin, end); `stop` is where the batch's last line of the file ends."""

    file: str
    begin: int
    end: int
    stop: int
    heads: list


def sizes(files: fs.FileSystem, root: str, wanted: re.Pattern) -> dict[str, int]:
    """Files below `root` and their sizes; names that begin with a dot or an underscore are other programs' own."""
    found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    inner = {f.path: f.path[len(root):] for f in found if f.type == fs.FileType.File}
    return {f.path: f.size for f in found if f.path in inner and wanted.search(f.path)
            and not any(x[:1] in "._" for x in inner[f.path].split("/") if x)}


def line_end(file: pa.NativeFile, low: int, high: int) -> int:
    """Where the last whole line of [low, high) ends; low if there is none."""
    while high > low:
        begin = max(low, high - CHUNK)
        file.seek(begin)
        found = file.read(high - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        high = begin
    return low


def next_line_end(file: pa.NativeFile, low: int, high: int) -> int:
    """Where the first whole line of [low, high) ends; low if there is none."""
    file.seek(low)
    at = low
    while at < high and (data := file.read(min(CHUNK, high - at))):
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(data)
    return low


def heads(file: pa.NativeFile, at: int) -> list[int]:
    """Checksums of the first 1, 2, 4, ... bytes, up to HEAD and `at`."""
    file.seek(0)
    data = file.read(min(HEAD, at))
    return [zlib.crc32(data[:1 << i]) for i in range(len(data).bit_length())]


def continues(before: dict | None, now: dict) -> bool:
    """Whether a file of the later offset is the earlier one, grown or unchanged."""
    return bool(before) and before["at"] <= now["at"] and now["heads"][:len(before["heads"])] == before["heads"]


def ranges(start: dict, end: dict) -> Iterator[tuple[str, int, int]]:
    """(file, from, to): the bytes between two offsets."""
    moved = {f: now for f, now in start.items() if now["at"] and not continues(now, end[f] if f in end else {"at": -1, "heads": []})}
    for file, now in sorted(end.items()):
        begin = 0
        if continues(start.get(file), now):
            begin = start[file]["at"]
        elif len(now["heads"]):
            old = [f for f, x in moved.items() if continues(x, now)]
            if old:
                best = max(old, key=lambda f: (len(moved[f]["heads"]), moved[f]["at"]))
                begin = moved.pop(best)["at"]
        if begin < now["at"]:
            yield file, begin, now["at"]


def same_file(files: fs.FileSystem, path: str, stop: int, wanted: list[int]) -> bool:
    info = files.get_file_info(path)
    if info.type != fs.FileType.File or info.size < stop:
        return False
    with files.open_input_file(path) as file:
        return heads(file, stop)[:len(wanted)] == wanted


def lines_of(file: pa.NativeFile, part: Part) -> Iterator[tuple[list[bytes], list[int]]]:
    """Lines and where they begin, about CHUNK bytes at a time."""
    at = part.begin
    if at:  # unless a line ends right before the part, its first line belongs to the part before
        file.seek(at - 1)
        if file.read(1) != b"\n":
            at = next_line_end(file, at, part.stop)
            if at == part.begin:
                return
    rest, begin = b"", at
    file.seek(at)
    while begin < part.end:
        data = file.read(min(CHUNK, part.stop - at))
        if not data:
            break
        at += len(data)
        whole = (rest + data).split(b"\n")
        rest = whole.pop()
        lines, places = [], []
        for line in whole:
            if begin >= part.end:
                break
            lines.append(line)
            places.append(begin)
            begin += len(line) + 1
        yield lines, places


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("tail_lines needs a path")
        self.options = dict(options)
        self.known: dict = {}

    def _place(self) -> tuple[fs.FileSystem, str]:
        path = self.options["path"]
        path = re.sub(r"^file:/+", "/", path)
        files, root = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
        return files, root.rstrip("/")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Each file up to its last whole line, or, with maxBytes, some lines on from where this reader knows it to be."""
        files, root = self._place()
        limit = int(self.options.get("maxbytes", 0))
        out = {}
        for path, size in sorted(sizes(files, root, re.compile(self.options.get("files", ""))).items()):
            before = self.known.get(path)
            try:
                with files.open_input_file(path) as file:
                    low = before["at"] if before and before["at"] <= size and heads(file, before["at"]) == before["heads"] else 0
                    high = size
                    if limit and size - low > limit:
                        high = line_end(file, low, low + limit)
                        at = high if high > low else next_line_end(file, low, size)
                    else:
                        at = line_end(file, low, high)
                    out[path] = {"at": at, "heads": heads(file, at)}
            except FileNotFoundError:
                continue  # gone since it was listed
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Part]:
        size = int(self.options.get("partbytes", PART_BYTES))
        self.known = self.known or end
        return [Part(file, a, min(a + size, to), to, end[file]["heads"]) for file, begin, to in ranges(start, end) for a in range(begin, to, size)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, root = self._place()
        path = partition.file
        if not same_file(files, path, partition.stop, partition.heads):  # renamed since the batch was planned
            path = next((f for f, size in sorted(sizes(files, root, re.compile("")).items())
                         if size >= partition.stop and same_file(files, f, partition.stop, partition.heads)), "")
        if not path:
            if self.options.get("failonloss", "true") == "true":
                raise FileNotFoundError(f"{partition.file} was removed or cut before its bytes up to {partition.stop} were read")
            return
        with files.open_input_file(path) as file:
            for lines, places in lines_of(file, partition):
                text = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array([partition.file] * len(text), pa.string()),
                                                  pa.array(places, pa.int64())], ["value", "file", "at"])


class TailLines(DataSource):
    """Options: path; files (a pattern that paths must contain); partBytes; maxBytes of a file in a batch; failOnLoss.

    maxBytes counts from what this run of the query has seen. The first batch after a restart, and a trigger that stops
    when it has caught up, take all there is.
    """

    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)
