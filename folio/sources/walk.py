"""A data source that lists a folder tree: (rel, path, bytes, mtime_ns).

Spark's own listing hides names that begin with an underscore and rounds times to microseconds. Excluded folders are cut off
before they are entered. Folders are opened from the root down until there are enough of them for as many tasks; a folder with
very many files is listed in several parts.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from folio.schema import FILES, IGNORED_DIRS
from folio.sources.ignore import FILE_NAME, IgnoreRules


#: Folders that are opened to deal out the rest, and files of one folder that a task lists at most.
LEAST_TASKS, PART_FILES = 256, 10_000


class _Part(InputPartition):
    """A folder with all below it (deep), or a part of its own files."""

    def __init__(self, rel: str, deep: bool, start: int = 0):
        super().__init__((rel, deep, start))
        self.rel, self.deep, self.start = rel, deep, start


class _Reader(DataSourceReader):
    def __init__(self, root: str, links: bool, skip: list[str], everything: bool):
        self.root, self.links, self.skip, self.everything = os.path.abspath(root), links, {os.path.realpath(x) for x in skip if x}, everything
        try:
            with open(f"{self.root}/{FILE_NAME}", encoding="utf-8") as file:
                lines = file.readlines()
        except (OSError, UnicodeDecodeError):
            lines = []
        self.rules = IgnoreRules([] if everything else lines)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        level, seen = [""], 0
        while level and seen + len(level) < LEAST_TASKS:
            below = []
            for rel in level:
                if self._loops(rel):
                    continue
                dirs, files = self._entries(rel)
                out += [_Part(rel, False, start) for start in range(0, len(files), PART_FILES)]
                below += [f"{rel}/{d}" if rel else d for d in dirs]
            seen, level = seen + len(level), below
        return out + [_Part(rel, True) for rel in level]

    def _loops(self, rel: str) -> bool:
        """The folder is, by links, one of those above it."""
        parts = rel.split("/") if rel else []
        above = {os.path.realpath(os.path.join(self.root, *parts[:n])) for n in range(len(parts))}
        return os.path.realpath(os.path.join(self.root, rel)) in above

    def _entries(self, rel: str) -> tuple[list[str], list[str]]:
        """Sorted folders and files of one folder that aren't excluded."""
        dirs, files = [], []
        try:
            found = sorted(os.scandir(os.path.join(self.root, rel)), key=lambda e: e.name)
        except OSError:
            return [], []
        for e in found:
            own = f"{rel}/{e.name}" if rel else e.name
            if e.is_symlink() and not self.links:
                continue
            if e.is_dir():
                hidden = not self.everything and (e.name.startswith(".") or e.name in IGNORED_DIRS or os.path.realpath(e.path) in self.skip or self.rules.matches(own, True))
                if not hidden:
                    dirs.append(e.name)
            elif self.everything or not (e.name.startswith(".") or self.rules.matches(own)):
                files.append(e.name)
        return dirs, files

    def _walk(self, rel: str) -> Iterator[str]:
        if self._loops(rel):
            return
        dirs, files = self._entries(rel)
        yield from (f"{rel}/{f}" if rel else f for f in files)
        for d in dirs:
            yield from self._walk(f"{rel}/{d}" if rel else d)

    def read(self, partition: _Part) -> Iterator[tuple]:
        own = partition.rel
        found = self._walk(own) if partition.deep else (f"{own}/{f}" if own else f for f in self._entries(own)[1][partition.start : partition.start + PART_FILES])
        for rel in found:
            path = os.path.join(self.root, rel)
            try:
                found_stat = os.stat(path)
            except OSError:
                continue
            if stat.S_ISREG(found_stat.st_mode):
                yield rel, path, found_stat.st_size, found_stat.st_mtime_ns


class WalkSource(DataSource):
    """Options: root, links (follow symbolic links), skip (folders, one a line), everything (no exclusions)."""

    @classmethod
    def name(cls) -> str:
        return "folio_walk"

    def schema(self) -> StructType:
        return FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        on = lambda key: str(self.options.get(key, "false")).lower() == "true"
        return _Reader(self.options["root"], on("links"), self.options.get("skip", "").split("\n"), on("everything"))


def walk(spark: SparkSession, root: str, links: bool = False, skip: list[str] | None = None, everything: bool = False):
    spark.dataSource.register(WalkSource)
    return spark.read.format("folio_walk").options(root=root, links=links, skip="\n".join(skip or []), everything=everything).load()
