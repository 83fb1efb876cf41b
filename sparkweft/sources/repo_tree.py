"""A source tree as rows: its directories and Python files, with the files' contents.

Spark's own file readers leave out names that begin with an underscore or a dot, so packages'
__init__ files would be missing. The driver lists names only; the executors read.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Directories that hold no source of the repository, by their whole name.
IGNORED = (".git", "__pycache__", ".pytest_cache", ".venv", "venv", "env", "build", "dist", ".egg-info", ".idea", ".vscode", ".mypy_cache", ".ruff_cache")
SCHEMA = "kind string, path string, content binary"
PER_PARTITION = 500


class _Files(InputPartition):
    def __init__(self, root: str, kind: str, paths: list[str]):
        self.root, self.kind, self.paths = root, kind, paths


class _Reader(DataSourceReader):
    def __init__(self, root: str, ignored: frozenset[str]):
        self.root, self.ignored = os.path.abspath(root), ignored

    def partitions(self) -> list[_Files]:
        directories, files = [], []
        for here, names, found in os.walk(self.root):
            names[:] = sorted(n for n in names if n not in self.ignored)
            relative = os.path.relpath(here, self.root).replace(os.sep, "/")
            at = "" if relative == "." else relative + "/"
            directories += [at + n for n in names if not os.path.islink(os.path.join(here, n))]
            files += [at + n for n in sorted(found) if n.endswith(".py")]
        cut = lambda kind, paths: [_Files(self.root, kind, paths[i : i + PER_PARTITION]) for i in range(0, len(paths), PER_PARTITION)]
        return [*cut("directory", directories), *cut("file", files)] or [_Files(self.root, "file", [])]

    def read(self, partition: _Files):
        for path in partition.paths:
            content = None
            if partition.kind == "file":
                with open(os.path.join(partition.root, path), "rb") as f:
                    content = f.read()
            yield partition.kind, path, content


class RepoTree(DataSource):
    """spark.read.format("repo_tree").option("ignore", "a,b").load(root)"""

    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        ignored = self.options.get("ignore")
        return _Reader(self.options["path"], frozenset(IGNORED if ignored is None else ignored.split(",")))


def read_tree(spark: SparkSession, root: str, ignored: tuple[str, ...] | None = None) -> DataFrame:
    """(kind, path, content) of the directories and Python files under the root."""
    if not os.path.isdir(root):
        raise FileNotFoundError(f"Repository directory not found: {root}")
    spark.dataSource.register(RepoTree)
    reader = spark.read.format("repo_tree")
    return (reader if ignored is None else reader.option("ignore", ",".join(ignored))).load(root)
