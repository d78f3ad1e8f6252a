"""Versioned tables with an atomic upsert.

A table is a folder of versions and one small file, ``current``, that names the version in force. A writer puts a
whole new version beside the others and then replaces ``current`` in one rename; readers see the old version or the
new one, never a mixture, and a writer that dies in between leaves the old one in force. A run has a name: a run
that is repeated after it took effect changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import joined


class VersionedTable:
    """A table at ``path``, a folder of any store that Spark reaches and that renames atomically."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._store = jvm.FileContext.getFileContext(self._path(self.path).toUri(), self._conf)
        self._files = self._path(self.path).getFileSystem(self._conf)
        self._rename = jvm.Options.Rename

    def manifest(self) -> dict | None:
        """The version in force and the runs that made it, or None before the first."""
        at = self._path(f"{self.path}/current")
        if not self._files.exists(at):
            return None
        stream = self._files.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        """The rows in force."""
        held = self.manifest()
        return None if held is None else self.spark.read.parquet(f"{self.path}/{held['version']}")

    def write_version(self, rows: DataFrame, run: str) -> dict:
        """Writes rows as a version that is not in force yet; ``swap`` puts it there."""
        held = self.manifest() or {"number": 0, "runs": []}
        number = held["number"] + 1
        version = f"v{number:06d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{version}")
        return {"number": number, "version": version, "runs": [*held["runs"], run][-100:]}

    def swap(self, new: dict) -> None:
        """Puts a version in force, in one step; refuses one that was made from a version that is no longer in force."""
        held = self.manifest()
        if held is not None and held["number"] + 1 != new["number"]:
            raise RuntimeError(f"another run has put version {held['number']} in force")
        fresh = self._path(f"{self.path}/.current-{uuid.uuid4().hex}")
        stream = self._files.create(fresh)
        try:
            stream.write(bytearray(json.dumps(new).encode()))
        finally:
            stream.close()
        modes = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        modes[0] = self._rename.OVERWRITE
        self._store.rename(self._store.makeQualified(fresh), self._store.makeQualified(self._path(f"{self.path}/current")), modes)

    def upsert(self, rows: DataFrame, keys: list[str], run: str) -> bool:
        """Replaces rows of equal keys and adds the others; False where the run took effect before.

        Of several new rows of one key the greatest by their other columns stays, so a repeated run gives the same table.
        """
        held = self.manifest()
        if held is not None and run in held["runs"]:
            return False
        others = [c for c in rows.columns if c not in keys]
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in others or keys)))
        new = rows.withColumn("__place", place).where("__place = 1").drop("__place")
        if held is not None:
            kept = joined(self.read(), new.select(*keys), keys, "left_anti")
            new = kept.unionByName(new, allowMissingColumns=True)
        self.swap(self.write_version(new, run))
        return True

    def delete_old(self, keep: int = 2) -> None:
        """Deletes all but the last versions; readers of deleted ones fail."""
        held = self.manifest()
        for status in self._files.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith("v") and int(name[1:7]) <= held["number"] - keep:
                self._files.delete(status.getPath(), True)
