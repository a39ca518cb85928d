"""Sources: a source tree, and saved model responses."""

from __future__ import annotations

import os
import shutil
import subprocess
import time
import zlib
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)
from pyspark.sql.types import StructType

from findmill.functions.rules import PRUNED_DIRS
from findmill.sources.store import small_batches, work_path

class _Files(InputPartition):
    """Files, or a folder to walk; of a wide folder the names with one remainder by ``parts``."""

    def __init__(self, paths: list[str], folder: str | None = None, part: int = 0, parts: int = 1):
        super().__init__(None)
        self.paths, self.folder, self.part, self.parts = paths, folder, part, parts


class _Wanted:
    """What pushed filters ask of a file, and of a folder on the way to it."""

    TESTS = {
        EqualTo: lambda have, value: have == value, EqualNullSafe: lambda have, value: have == value, In: lambda have, value: have in value,
        StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda have, value: value in have,
    }

    def __init__(self):
        self.tests: list[tuple[str, type, object, bool]] = []

    def take(self, asked: Filter) -> bool:
        """Whether the filter is looked after here; else Spark applies it to the rows."""
        if isinstance(asked, IsNotNull):
            return True  # no column is ever null
        yes = not isinstance(asked, Not)
        test = asked if yes else asked.child
        kind, name = type(test), ".".join(getattr(test, "attribute", ()))
        if kind not in self.TESTS or name not in ("path", "file", "ext"):
            return False
        value = test.value
        if not all(isinstance(x, str) for x in (value if kind is In else (value,))):
            return False
        self.tests.append((name, kind, value, yes))
        return True

    def file(self, path: str, name: str) -> bool:
        have = {"path": path, "file": name, "ext": ext_of(name)}
        return all(self.TESTS[kind](have[column], value) is yes for column, kind, value, yes in self.tests)

    def folder(self, path: str) -> bool:
        """Whether a wanted file can lie below."""
        inside = f"{path}/"
        for column, kind, value, yes in self.tests:
            if column == "path" and yes:
                if kind is StringStartsWith and not (inside.startswith(value) or value.startswith(inside)):
                    return False
                if kind in (EqualTo, EqualNullSafe, In) and not any(x.startswith(inside) for x in (value if kind is In else (value,))):
                    return False
        return True


def ext_of(name: str) -> str:
    return os.path.splitext(name)[1].lstrip(".")


class _TreeReader(DataSourceReader):
    """The driver opens folders level by level until there are ``folderTasks`` of them; tasks walk the rest.

    A folder with more than ``folderNames`` names is not listed on the driver: ``folderParts`` tasks list it,
    and each takes its share.
    """

    def __init__(self, options: dict):
        self.root = options["path"]
        self.suffixes = tuple(s for s in options.get("suffixes", "").split(",") if s)
        self.per_task = int(options.get("filesPerTask", 200))
        self.most = int(options.get("folderTasks", 4096))
        self.names = int(options.get("folderNames", 50_000))
        self.parts = int(options.get("folderParts", 64))
        self.wanted = _Wanted()
        #: Folders listed, and folders that filters on paths keep shut, by this copy of the reader.
        self.entered = self.shut = 0

    def _entries(self, folder: str, most: int | None = None) -> list[os.DirEntry] | None:
        """What is in a folder, or None if that is more than ``most``."""
        found = []
        self.entered += 1
        try:
            with os.scandir(folder) as entries:
                for entry in entries:
                    found.append(entry)
                    if most is not None and len(found) > most:
                        return None
        except OSError:
            return []
        return sorted(found, key=lambda x: x.name)

    def _inside(self, entries: list[os.DirEntry], part: int = 0, parts: int = 1) -> tuple[list[str], list[str]]:
        """(folders to enter, files wanted) of one folder, or of one part of its names."""
        below, wanted = [], []
        for entry in entries:
            if parts > 1 and zlib.crc32(os.fsencode(entry.name)) % parts != part:
                continue
            if entry.is_dir():
                if entry.name not in PRUNED_DIRS and not entry.is_symlink():
                    if self.wanted.folder(entry.path):
                        below.append(entry.path)
                    else:
                        self.shut += 1
            elif (not self.suffixes or entry.name.endswith(self.suffixes)) and self.wanted.file(entry.path, entry.name):
                wanted.append(entry.path)
        return below, wanted

    def partitions(self) -> list[InputPartition]:
        found: list[str] = []
        open_, opened, wide = deque([self.root]), 0, []
        while open_ and opened < self.most and len(found) <= self.most * self.per_task:
            folder = open_.popleft()
            opened += 1
            entries = self._entries(folder, self.names)
            if entries is None:
                wide.append(folder)
                continue
            below, wanted = self._inside(entries)
            open_ += below
            found += wanted
        tasks = [_Files(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)]
        tasks += [_Files([], folder, part, self.parts) for folder in wide for part in range(self.parts)]
        return tasks + [_Files([], folder) for folder in open_] or [_Files([])]

    def _paths(self, partition: InputPartition) -> Iterator[str]:
        yield from partition.paths
        work = [(partition.folder, partition.part, partition.parts)] if partition.folder else []
        while work:
            folder, *share = work.pop()
            below, wanted = self._inside(self._entries(folder), *share)
            work += [(x, 0, 1) for x in below]
            yield from wanted

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in self._paths(partition):
            with open(path, encoding="utf-8", errors="ignore") as f:
                name = os.path.basename(path)
                yield path, name, ext_of(name), f.read()


class _PushingReader(_TreeReader):
    """With filters on path, file and ext pushed into the walk: what they rule out is neither entered nor read."""

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        return [x for x in filters if not self.wanted.take(x)]


class SourceTree(DataSource):
    """``spark.read.format("srctree").option("suffixes", ".py,.js").load(folder)``.

    Spark's own file sources hide names that begin with a dot or an underscore; this one shows them. The
    folder must be one that driver and executors both see. With the option ``pushdown`` (and Spark's setting
    spark.sql.python.filterPushdown.enabled, which ``source_tree`` sees to) filters on path, file and ext prune the walk.
    """

    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> str:
        return "path string, file string, ext string, content string"

    def reader(self, schema: StructType) -> DataSourceReader:
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return (_PushingReader if pushing else _TreeReader)(self.options)


class _Folders(InputPartition):
    """Folders that a task lists; with ``deep`` all that lies below as well."""

    def __init__(self, folders: list[str], deep: bool, start: int, end: int):
        super().__init__(None)
        self.folders, self.deep, self.start, self.end = folders, deep, start, end


class _ChangesReader(DataSourceStreamReader):
    """What changed between two times, by the change times of folders and files; the walk itself is done by tasks."""

    FOLDERS_PER_TASK = 64

    def __init__(self, options: dict):
        self.tree = _TreeReader(options)
        self.settle = int(float(options.get("settleSeconds", 1)) * 1e9)

    def initialOffset(self) -> dict:
        return {"ns": 0}

    def latestOffset(self) -> dict:
        return {"ns": time.time_ns() - self.settle}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        opened, open_ = [], deque([self.tree.root])
        while open_ and len(opened) < self.tree.most:
            folder = open_.popleft()
            opened.append(folder)
            open_ += self.tree._inside(self.tree._entries(folder))[0]
        span, n = (start["ns"], end["ns"]), self.FOLDERS_PER_TASK
        return [_Folders(opened[i : i + n], False, *span) for i in range(0, len(opened), n)] + [_Folders([x], True, *span) for x in open_]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        work = list(partition.folders)
        while work:
            folder = work.pop()
            try:
                changed = os.stat(folder).st_ctime_ns
            except OSError:
                continue  # it has gone, which its parent's listing tells
            below, wanted = self.tree._inside(self.tree._entries(folder))
            if partition.start < changed <= partition.end:
                yield "folder", folder, None, None, None, [os.path.basename(x) for x in [*below, *wanted]]
            for path in wanted:
                try:
                    if partition.start < os.stat(path).st_ctime_ns <= partition.end:
                        with open(path, encoding="utf-8", errors="ignore") as f:
                            name = os.path.basename(path)
                            yield "file", path, name, ext_of(name), f.read(), None
                except OSError:
                    continue
            if partition.deep:
                work += below

    def commit(self, end: dict) -> None:
        pass


class TreeChanges(DataSource):
    """``spark.readStream.format("treechanges").load(folder)``: files and listings of folders that changed since the batch before.

    The first batch has all. A moved folder shows in its own and its new parent's listing; files in it keep their times, so
    whoever follows has to look for names that are new to them, as ``follow_tree`` does.
    """

    @classmethod
    def name(cls) -> str:
        return "treechanges"

    def schema(self) -> str:
        return "kind string, path string, file string, ext string, content string, names array<string>"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _ChangesReader(self.options)


def source_tree(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, file, ext, content) of the files below ``folder``; pruned folders are never entered.

    ``where`` on path, file or ext reaches the walk: folders that no wanted path lies in are not listed, and files
    that are not wanted are not opened.
    """
    spark.dataSource.register(SourceTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("srctree").option("suffixes", ",".join(suffixes)).option("pushdown", "true").load(folder)


def write_tree(rows: DataFrame, folder: str) -> int:
    """Write (path, content) as UTF-8 files below ``folder``, which all machines mount; the number of files.

    Paths are relative. Tasks write their own rows; a file that is there is replaced, so a repeated task does no harm.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                place = os.path.join(folder, path)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(place, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    texts = rows.where(F.col("path").isNotNull() & F.col("content").isNotNull()).select("path", "content")
    with small_batches(rows.sparkSession):
        return texts.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@contextmanager
def opened(spark: SparkSession, target: str) -> Iterator[str]:
    """A folder for a target: itself, or a shallow clone of a git address, which is removed at the end.

    The clone lies in the folder that driver and executors share, which has to be mounted for that.
    """
    if not target.startswith(("http", "git@", "file://")):
        yield target
        return
    folder = urlparse(work_path(spark, "source"))
    if folder.scheme not in ("", "file"):
        raise ValueError("a clone needs a shared folder that is mounted on all machines")
    os.makedirs(os.path.dirname(folder.path), exist_ok=True)
    try:
        subprocess.run(["git", "clone", "--quiet", "--depth", "1", target, folder.path], check=True, timeout=600)
        yield folder.path
    finally:
        shutil.rmtree(folder.path, ignore_errors=True)


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """(name, file, day, time, raw) of saved responses ``[yyyyMMdd_]HHmmss_<file>.json``, one file each."""
    name = F.col("_metadata.file_name")
    parts = r"^(?:(\d{8})_)?(\d{6})_(.+)\.json$"
    return spark.read.text(folder, wholetext=True).select(
        name.alias("name"),
        F.regexp_extract(name, parts, 3).alias("file"),
        F.nullif(F.regexp_extract(name, parts, 1), F.lit("")).alias("day"),
        F.regexp_extract(name, parts, 2).alias("time"),
        F.col("value").alias("raw"),
    )
