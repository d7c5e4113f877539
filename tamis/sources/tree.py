"""A folder tree as a table of files, in a listing of our own: dot-files and empty files are there, dot-folders on demand.

The driver lists the upper folders only until there is enough to deal out; each task walks the folders it was given and
reads their files one by one. Any file system that pyarrow opens will do.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

SCHEMA = "path string, length bigint, modificationTime timestamp, content binary"
#: Folders and files that a task is given, if there are so many: enough tasks to share a tree of uneven folders.
ENTRIES_A_TASK = 64


@dataclass(frozen=True)
class Wanted:
    """Which files of a tree are read."""

    recursive: bool = True
    hidden: bool = False
    max_bytes: int | None = None
    min_bytes: int = 0
    suffixes: tuple[str, ...] = ()
    skip_suffixes: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()

    def file(self, info: fs.FileInfo, path: str) -> bool:
        if self.max_bytes is not None and info.size > self.max_bytes or info.size < self.min_bytes:
            return False
        return all(path.endswith(s) for s in self.suffixes) and not any(path.endswith(s) for s in self.skip_suffixes) and all(path.startswith(p) for p in self.prefixes)

    def folder(self, name: str) -> bool:
        return self.recursive and (self.hidden or not name.startswith(".") or name == ".")


@dataclass
class Share(InputPartition):
    """Folders to walk and files to read."""

    folders: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def _entries(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """What a folder has, by name; nothing if it can't be listed. Links and devices are no files."""
    try:
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    except OSError:
        return []
    local = isinstance(store, fs.LocalFileSystem)
    found = [e for e in found if e.type in (fs.FileType.File, fs.FileType.Directory) and not (local and os.path.islink(e.path))]
    return sorted((e for e in found if e.type != fs.FileType.File or not local or os.path.isfile(e.path)), key=lambda e: e.base_name)


def walked(store: fs.FileSystem, folder: str, wanted: Wanted) -> Iterator[fs.FileInfo]:
    """The files below `folder` in the order of names, folders among files. Only the way down is held."""
    todo = [iter(_entries(store, folder))]
    while todo:
        entry = next(todo[-1], None)
        if entry is None:
            todo.pop()
        elif entry.type == fs.FileType.Directory:
            if wanted.folder(entry.base_name):
                todo.append(iter(_entries(store, entry.path)))
        elif wanted.file(entry, entry.path):
            yield entry


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        flag = lambda name, default: options.get(name, default).lower() == "true"
        number = lambda name: int(options[name]) if options.get(name) else None
        many = lambda name: tuple(s for s in options.get(name, "").split(",") if s)
        self.path, self.max_files, self.tasks = options["path"], number("maxfiles"), number("tasks") or 64
        self.wanted = Wanted(flag("recursive", "true"), flag("includehidden", "false"), number("maxreadbytes"), 0, many("suffix"), many("skipsuffix"))

    def pushFilters(self, filters: list[Filter]):
        """Bounds on the length, and ends and starts of the path, are met while listing; the rest is Spark's."""
        w = self.wanted
        for f in filters:
            least = {EqualTo: 0, GreaterThan: 1, GreaterThanOrEqual: 0}.get(type(f))
            most = {EqualTo: 0, LessThan: -1, LessThanOrEqual: 0}.get(type(f))
            if getattr(f, "attribute", None) == ("length",) and (least, most) != (None, None):
                if least is not None:
                    w = replace(w, min_bytes=max(w.min_bytes, f.value + least))
                if most is not None:
                    w = replace(w, max_bytes=min(f.value + most, f.value + most if w.max_bytes is None else w.max_bytes))
            elif isinstance(f, StringEndsWith) and f.attribute == ("path",):
                w = replace(w, suffixes=(*w.suffixes, f.value))
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                w = replace(w, prefixes=(*w.prefixes, f.value))
            else:
                yield f
        self.wanted = w

    def partitions(self) -> list[Share]:
        store, top = _opened(self.path)
        if self.max_files is not None:  # the first of the walk: the driver lists no more than these
            found = []
            for entry in walked(store, top, self.wanted):
                if len(found) >= self.max_files:
                    break
                found.append(entry.path)
            return self._dealt([], found)
        folders, files = [top], []
        if store.get_file_info(top).type == fs.FileType.File:
            folders, files = [], [top]
        while folders and len(folders) + len(files) < self.tasks:
            below: list[str] = []
            for folder in folders:
                for e in _entries(store, folder):
                    if e.type == fs.FileType.Directory:
                        below += [e.path] if self.wanted.folder(e.base_name) else []
                    elif self.wanted.file(e, e.path):
                        files.append(e.path)
            folders = below
        return self._dealt(folders, files)

    def _dealt(self, folders: list[str], files: list[str]) -> list[Share]:
        """Evenly, folders and files each."""
        n = max(1, min(self.tasks, len(folders) + len(files)), -(-(len(folders) + len(files)) // ENTRIES_A_TASK))
        return [Share(folders[i::n], files[i::n]) for i in range(n)]

    def read(self, share: Share):
        store, _ = _opened(self.path)
        for entry in [e for path in share.files for e in [store.get_file_info(path)] if e.type == fs.FileType.File]:
            yield self._row(store, entry)
        for folder in share.folders:
            for entry in walked(store, folder, self.wanted):
                yield self._row(store, entry)

    def _row(self, store: fs.FileSystem, entry: fs.FileInfo):
        try:
            with store.open_input_stream(entry.path) as f:
                content = f.read()
        except OSError:
            content = None
        return entry.path, entry.size, entry.mtime, content


class TreeSource(DataSource):
    """format("tree"): option path, and recursive, includeHidden, maxReadBytes, suffix and skipSuffix (lists with commas),
    maxFiles, tasks."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def file_tree(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, length, modificationTime, content) of the files below `path`. A file that can't be read has a null content, a
    folder that can't be listed has no files, links are left out."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").option("path", path).option("tasks", str(8 * spark.sparkContext.defaultParallelism))
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, ",".join(value) if isinstance(value, list | tuple) else str(value).lower() if isinstance(value, bool) else str(value))
    return reader.load()
