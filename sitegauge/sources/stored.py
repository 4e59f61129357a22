"""A stored table that batches are merged into: keep the latest row of each key, in versions that appear at once.

Rows lie in ``parts`` parts by the hash of their key. A merge reads and rewrites only the parts that its batch touches, into folders of their own, and then writes the list of all
parts' folders as the next version by one rename: readers see the version before or the one after, never between. A merge that dies leaves folders that no version
names; one that runs twice, or whose batch was merged before, gives the same rows. Two merges at once want the same version number, and the later rename is refused.
Paths are Hadoop's, so the table can lie where only Spark reads.

Null keys are keys like any other. Of rows equal in key and order the greatest by all their columns is kept; an empty batch changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "part_"


class StoredTable:
    """A table under ``path`` with rows of one ``schema``, told apart by ``keys``, the latest by ``order``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str], parts: int = 16):
        self.spark, self.path, self.schema, self.keys, self.order, self.parts = spark, path.rstrip("/"), schema, keys, order, parts
        self.files = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The number of the last version; 0 before the first merge."""
        if not self.files.exists(self._at("versions")):
            return 0
        return max((int(s.getPath().getName()) for s in self.files.listStatus(self._at("versions")) if s.getPath().getName().isdigit()), default=0)

    def _folders(self, version: int) -> dict[str, str]:
        """The folder of each part that has rows (at most ``parts``)."""
        if not version:
            return {}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/versions/{version}").first()[0])

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version (the last without one), or of some parts of it."""
        held = self._folders(self.version() if version is None else version)
        wanted = [f"{self.path}/{f}" for p, f in held.items() if only is None or int(p) in only]
        return self.spark.read.schema(self.schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame) -> int:
        """Merges the batch; the number of the version that has it."""
        version = self.version()
        folder = f"data/{uuid.uuid4().hex}"
        touched = self.write(batch, version, folder)
        if not touched:
            return version
        return self.publish(version, self._folders(version) | {str(p): f"{folder}/{PART}={p}" for p in touched})

    def write(self, batch: DataFrame, version: int, folder: str) -> list[int]:
        """Writes the parts that the batch touches, merged with the version's rows; the parts."""
        columns = self.read(0).columns
        rows = batch.select(*columns)
        part = F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")
        touched = [r[0] for r in rows.select(part.alias(PART)).distinct().collect()]  # at most ``parts``
        if touched:
            both = rows.unionByName(self.read(version, touched))
            rest = [c for c in columns if c not in self.keys and c not in self.order]
            last = both.groupBy(*self.keys).agg(F.max(F.struct(*self.order, *rest)).alias("x")).select(*self.keys, "x.*")
            last.select(*columns, part.alias(PART)).repartition(PART).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        return touched

    def publish(self, version: int, folders: dict[str, str]) -> int:
        """Makes the list of folders the version after ``version``, by one rename."""
        mine = self._at(f"versions/.{uuid.uuid4().hex}")
        out = self.files.create(mine)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if self.files.exists(self._at(f"versions/{version + 1}")) or not self.files.rename(mine, self._at(f"versions/{version + 1}")):
            self.files.delete(mine, False)
            raise RuntimeError(f"version {version + 1} of {self.path} was written by another merge")
        return version + 1
