"""Session plumbing shared by every operator: shipping the package, shared folders, cutting lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Bytes and rows of a step: what is parsed in Python before its results go out.
STEP_BYTES, STEP_ROWS = 1 << 20, 256


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of ``spark`` (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="sitegauge-"), "sitegauge.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(target)
        _SHIPPED.add(sc.applicationId)
    return spark


def bounded(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that go to Python by rows and bytes, whatever the lengths of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception:  # older sessions know only the row bound
        pass
    return spark


def steps(batch: pa.RecordBatch, sizes: Iterable[int], most: int = STEP_BYTES, rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose rows have ``sizes``: of at most so much, and so many rows, or of one larger row. All rows, in order; an empty batch as it is."""
    begin, total, k = 0, 0, -1
    for k, size in enumerate(sizes):
        if k > begin and (total + size > most or k - begin >= rows):
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += size
    yield batch.slice(begin)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a local master, as in tests, a temporary folder stands in for it where it is unset; elsewhere that is an error, for
    executors would not see the driver's folder.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        current = context.getCheckpointDir()
        if current:
            found = os.path.dirname(current)
        elif context.master.startswith("local[") or context.master == "local":
            found = tempfile.mkdtemp(prefix="sitegauge-shared-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
