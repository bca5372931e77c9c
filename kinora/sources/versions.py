"""Stored tables with atomic changes: every commit writes new folders and then moves one pointer file into place.

A commit may replace several tables; readers see all of them or none.  Any Hadoop file system will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def _versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[8:-5]) for n in names if n.startswith("pointer-") and n.endswith(".json"))

    def tables(self) -> dict[str, str]:
        """The folder of each table in the newest version."""
        versions = self._versions()
        if not versions:
            return {}
        with_lines = self.spark.read.option("wholetext", True).text(f"{self.folder}/pointer-{versions[-1]:08d}.json")
        return json.loads(with_lines.first().value)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.tables()[name])

    def has(self, name: str) -> bool:
        return name in self.tables()

    def commit(self, changes: dict[str, DataFrame]) -> int:
        """Write the changed tables, then make them the newest version; returns its number."""
        versions, now = self._versions(), self.tables()
        version = versions[-1] + 1 if versions else 1
        for name, df in changes.items():
            path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            now[name] = path
        draft = self._path(f"{self.folder}/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if not self._fs.rename(draft, self._path(f"{self.folder}/pointer-{version:08d}.json")):
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    def size(self) -> int:
        """Bytes of the newest version."""
        return sum(self._fs.getContentSummary(self._path(p)).getLength() for p in self.tables().values())
