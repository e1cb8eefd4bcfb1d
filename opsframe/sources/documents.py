"""One document from many tasks: sinks whose parts, read in the order of their names, are one JSON array or one INI file.

`df.write.format("json_array")` takes JSON texts, `df.write.format("one_text")` lines, in a single string column. Each task
writes its part to a staging folder below the target. Only a commit, when all tasks have ended well, moves the parts to
their places, in the order of the partitions; for an array it adds brackets and commas as small files of their own. So no
row passes through the driver, and `cat folder/*` is the document. A failed job leaves no part of a document; a task that
outlives it can leave a staged one, below a folder whose name begins with an underscore, which readers pass over. A task
that runs twice has two staged parts, of which only the committed one is moved.

The folder must be one that the driver and all executors see; it is reached through pyarrow's file systems.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from opsframe.plans.session import ship_package


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    rows: int


class PartWriter(DataSourceArrowWriter):
    """Rows joined by `between`; the document begins with `opening` and ends with `closing`."""

    def __init__(self, path: str, opening: bytes, between: bytes, closing: bytes, overwrite: bool):
        self.path, self.opening, self.between, self.closing, self.overwrite = path, opening, between, closing, overwrite
        self.stage = f"_staged-{uuid.uuid4().hex}"

    def _place(self) -> tuple[fs.FileSystem, str]:
        path = re.sub(r"^file:/+", "/", self.path)
        files, root = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
        return files, root.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = self._place()
        task = TaskContext.get()
        name = f"{root}/{self.stage}/{task.partitionId():08d}-{task.taskAttemptId()}"
        files.create_dir(f"{root}/{self.stage}", recursive=True)
        rows = 0
        with files.open_output_stream(name) as out:
            for batch in iterator:
                texts = [t.encode() for t in batch.column(0).to_pylist() if t is not None]
                if texts:
                    out.write((self.between if rows else b"") + self.between.join(texts))
                    rows += len(texts)
        return Written(task.partitionId(), name, rows)

    def _here(self, files: fs.FileSystem, root: str) -> list[str]:
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [f.path for f in found if f.type == fs.FileType.File]

    def commit(self, messages: list) -> None:
        files, root = self._place()
        files.create_dir(root, recursive=True)
        here = self._here(files, root)
        if here and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{root} holds files already")
        for old in here:
            files.delete_file(old)

        def small(name: str, data: bytes) -> None:
            if data:
                with files.open_output_stream(f"{root}/{name}") as out:
                    out.write(data)

        small("part-00000000-0", self.opening)
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.partition)
        for i, part in enumerate(parts, 1):
            files.move(part.file, f"{root}/part-{i:08d}-0")
            if i < len(parts):
                small(f"part-{i:08d}-1", self.between)
        small(f"part-{len(parts) + 1:08d}-0", self.closing)
        self._unstage(files, root)

    def abort(self, messages: list) -> None:
        self._unstage(*self._place())

    def _unstage(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.stage}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.stage}")


class OneText(DataSource):
    """Lines of one text."""

    ends = (b"", b"\n", b"\n")

    @classmethod
    def name(cls) -> str:
        return "one_text"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> PartWriter:
        if len(schema) != 1 or schema[0].dataType.simpleString() != "string":
            raise ValueError("one column of text is wanted")
        return PartWriter(self.options["path"], *self.ends, overwrite)


class JsonArray(OneText):
    """JSON texts as the elements of one array, a line each."""

    ends = (b"[\n", b",\n", b"\n]\n")

    @classmethod
    def name(cls) -> str:
        return "json_array"


def write_document(rows: DataFrame, path: str, kind: type[OneText], overwrite: bool = False) -> None:
    """Write a single column of text as one document; rows keep their order if they are sorted."""
    spark = rows.sparkSession
    ship_package(spark)
    spark.dataSource.register(kind)
    rows.write.format(kind.name()).mode("overwrite" if overwrite else "append").option("path", path).save()
