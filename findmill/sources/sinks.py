"""Sinks that are written whole or not at all: one file a row, and one HTML document.

Tasks write into a staging folder beside the place; a job that succeeds moves it there in one step, a job that
fails removes it. A task that runs again writes the same files again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from findmill.sources.shared import Shared

COPY_BYTES = 1 << 20


@dataclass
class _Written(WriterCommitMessage):
    rows: int
    part: str | None = None


class _Staged(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.place, self.overwrite = options["path"].rstrip("/"), overwrite
        parent, _, name = self.place.rpartition("/")
        self.staging = Shared(f"{parent}/.{name}-{uuid.uuid4().hex}")

        store, path = self.staging._at()
        store.create_dir(path, recursive=True)

    def _open(self, name: str) -> fs.NativeFile:
        """A new file in staging. A task that outlives its job finds the folder gone, and does not make it again."""
        store, root = self.staging._at()
        *folders, _ = name.split("/")
        for i in range(len(folders)):
            store.create_dir("/".join([root, *folders[: i + 1]]), recursive=False)
        return store.open_output_stream(f"{root}/{name}")

    def _move(self, source: str) -> None:
        store, to = fs.FileSystem.from_uri(self.place)
        old = store.get_file_info(to).type
        if old != fs.FileType.NotFound:
            if not self.overwrite:
                raise FileExistsError(self.place)
            (store.delete_dir if old == fs.FileType.Directory else store.delete_file)(to)
        store.move(fs.FileSystem.from_uri(source)[1], to)

    def abort(self, messages: list) -> None:
        store, path = self.staging._at()
        for _ in range(5):  # other tasks of the job may be writing yet
            try:
                if store.get_file_info(path).type != fs.FileType.NotFound:
                    store.delete_dir(path)
                return
            except OSError:
                time.sleep(0.2)


class _FilesWriter(_Staged):
    def write(self, rows: Iterator[Row]) -> _Written:
        n = 0
        for n, row in enumerate(rows, 1):
            with self._open(row["name"]) as out:
                out.write((row["content"] or "").encode())
        return _Written(n)

    def commit(self, messages: list) -> None:
        """All files at once; names that repeat are an error, as one would hide the other."""
        store, path = self.staging._at()
        found = sum(x.is_file for x in store.get_file_info(fs.FileSelector(path, recursive=True)))
        if found != sum(m.rows for m in messages if m):
            self.abort(messages)
            raise ValueError(f"names repeat: {found} files")
        self._move(self.staging.folder)


class _DocumentWriter(_Staged):
    def write(self, rows: Iterator[Row]) -> _Written:
        """One part of the document: the task's rows, which come in order; the part is named by its first."""
        first, n, out = None, 0, None
        try:
            for n, row in enumerate(rows, 1):
                if out is None:
                    first = f"{int(row['id']):020}-{TaskContext.get().partitionId():08}"
                    out = self._open(first)
                out.write(f"{row['html']}\n".encode())
        finally:
            if out is not None:
                out.close()
        return _Written(n, first)

    def commit(self, messages: list) -> None:
        store, _ = self.staging._at()
        with self._open("document") as out:
            out.write(b'<!DOCTYPE html>\n<html><head><meta charset="utf-8"></head><body>\n')
            for part in sorted(m.part for m in messages if m and m.part):
                with store.open_input_stream(self.staging._at(part)[1]) as f:
                    while data := f.read(COPY_BYTES):
                        out.write(data)
            out.write(b"</body></html>\n")
        self._move(f"{self.staging.folder}/document")
        self.abort(messages)


class FileSink(DataSource):
    """``df.write.format("filesink").save(folder)``: (name, content), a file each."""

    @classmethod
    def name(cls) -> str:
        return "filesink"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FilesWriter(self.options, overwrite)


class DocumentSink(DataSource):
    """``df.write.format("documentsink").save(file)``: (id, html), one document; rows come in ranges of id, sorted."""

    @classmethod
    def name(cls) -> str:
        return "documentsink"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _DocumentWriter(self.options, overwrite)


def _save(rows: DataFrame, sink: type[DataSource], path: str, overwrite: bool) -> None:
    rows.sparkSession.dataSource.register(sink)
    rows.write.format(sink.name()).mode("overwrite" if overwrite else "append").save(path)


def write_files(rows: DataFrame, path: str, overwrite: bool = True) -> None:
    """(name, content) as files below ``path``: all of them, or, if anything fails, none."""
    _save(rows.select("name", "content"), FileSink, path, overwrite)


def write_document(rows: DataFrame, path: str, overwrite: bool = True) -> None:
    """(id, html) as one file in order of id. Its parts are written by tasks, and copied together as they are."""
    _save(rows.select("id", "html").repartitionByRange("id").sortWithinPartitions("id"), DocumentSink, path, overwrite)
