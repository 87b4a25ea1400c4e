"""Files of a folder as a data source: folders that are left out are not listed, files that are left out are not opened.

``spark.dataSource.register(FolderSource)``, then ``spark.read.format("folder").load(root)``.  The driver lists the folders that stay
(names alone); their files are listed and read by tasks, some folders each.  Options: ``include`` and ``exclude`` (globs
parted by commas, against the path below the root; a * crosses slashes), ``endings`` (parted by commas), ``maxBytes``, ``contents``
(false lists only), ``foldersAtOnce``.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.sources.code import EXCLUDED

MAX_BYTES, FOLDERS_AT_ONCE = 10 << 20, 32


class Folders(InputPartition):
    def __init__(self, folders: list[str]):
        self.folders = folders


def _globs(text: str) -> list[re.Pattern]:
    return [re.compile(fnmatch.translate(g.strip())) for g in text.split(",") if g.strip()]


class Filter:
    """What of a repository is looked at."""

    def __init__(self, include: str = "", exclude: str = "", endings: str = ""):
        self.include, self.exclude = _globs(include), _globs(exclude)
        self.endings = tuple(e.strip().lower() for e in endings.split(",") if e.strip())
        self.default = re.compile(EXCLUDED)

    def folder(self, path: str) -> bool:
        """Whether a folder (below the root) is looked into."""
        return not self.default.search(f"{path}/") and not any(g.match(path) or g.match(f"{path}/") for g in self.exclude)

    def file(self, path: str) -> bool:
        if self.default.search(path) or any(g.match(path) for g in self.exclude):
            return False
        return (not self.endings or path.lower().endswith(self.endings)) and (not self.include or any(g.match(path) for g in self.include))


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "rel_path string, length long, skipped boolean, content string"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.filter = Filter(options.get("include", ""), options.get("exclude", ""), options.get("endings", ""))
        self.max_bytes = int(options.get("maxBytes", MAX_BYTES))
        self.contents = str(options.get("contents", "true")).lower() != "false"
        self.at_once = int(options.get("foldersAtOnce", FOLDERS_AT_ONCE))

    def _opened(self) -> tuple[fs.FileSystem, str]:
        where, path = fs.FileSystem.from_uri(self.root if ":" in self.root.split("/", 1)[0] else f"file://{self.root}")
        return where, path.rstrip("/")

    def _listed(self, where: fs.FileSystem, top: str, folder: str) -> list[fs.FileInfo]:
        return where.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/")))

    def partitions(self) -> list[Folders]:
        where, top = self._opened()
        found, todo = [], [""]
        while todo:
            folder = todo.pop()
            found.append(folder)
            below = (i.path[len(top) + 1 :] for i in self._listed(where, top, folder) if i.type == fs.FileType.Directory)
            todo += [b for b in below if self.filter.folder(b)]
        found.sort()
        return [Folders(found[i : i + self.at_once]) for i in range(0, len(found), self.at_once)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        where, top = self._opened()
        for folder in partition.folders:
            for info in sorted(self._listed(where, top, folder), key=lambda i: i.path):
                path = info.path[len(top) + 1 :]
                if info.type != fs.FileType.File or not self.filter.file(path):
                    continue
                large = info.size > self.max_bytes
                text = None
                if self.contents and not large:
                    with where.open_input_stream(info.path, compression=None) as f:
                        text = f.read().decode("utf-8", "replace")
                yield path, info.size, large, text
