"""The few file-system calls Spark has no DataFrame form for, on whatever system a path names."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


#: Renames under way at once.
MOVES = 16


class SharedFiles:
    """Small metadata files next to a table; data itself is read and written by Spark."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def glob(self, pattern: str) -> list[str]:
        found = self._fs.globStatus(self._path(pattern))
        return sorted(s.getPath().toString() for s in found) if found is not None else []

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            data = self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
        finally:
            stream.close()
        return bytes(data).decode("utf-8")

    def write_text(self, path: str, text: str) -> None:
        stream = self._fs.create(self._path(path), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def publish(self, source: str, target: str) -> None:
        """Rename that fails if the target exists."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        qualified = [self._fs.makeQualified(self._path(p)) for p in (source, target)]
        context.rename(*qualified, options)

    def move(self, targets: Mapping[str, str]) -> None:
        """Rename many files (source to target) into a folder that no one else writes to. Much cheaper for each than
        :meth:`publish`, which asks for the state of both ends, on local disks by processes of their own."""
        if len(set(targets.values())) < len(targets):
            raise ValueError("two files have one target")

        def one(source: str, target: str) -> None:
            if not self._fs.rename(self._path(source), self._path(target)):
                raise OSError(f"cannot rename {source} to {target}")

        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(one, targets.keys(), targets.values()))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
