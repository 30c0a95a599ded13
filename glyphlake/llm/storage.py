"""Intermediate tables in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only where that is unset and
all tasks run in one process (tests, a laptop) a folder below /tmp is chosen and set; a cluster
without a shared folder is an error, as its executors would write to their own disks.  A written table cuts the lineage: a
lost executor costs its running tasks, not the finished work.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

FALLBACK_DIR = "/tmp/checkpoints/glyphlake"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(FALLBACK_DIR)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


class Workspace:
    """A folder of intermediate tables for one run of one operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark)}/glyphlake/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table read back."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def delete(self, name: str) -> None:
        """Remove a table that no later plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of input for each range of an ordered table.
RANGE_BYTES = 256 << 20
#: Sizes above this are a planner's sign that it knows none.
_UNKNOWN = 1 << 55


def ranges(df: DataFrame) -> int:
    """How many ranges to order ``df`` in: by the bytes of its files, the session's number at least."""
    least = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return max(least, -(-size // RANGE_BYTES)) if size < _UNKNOWN else least


#: Bytes of an Arrow batch that a Python worker holds at once, a few times over.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES, so that whole texts of any number and
    length pass through Python workers of a fixed size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


_held: dict[str, Any] = {}


def held(key: str, make: Callable[[], Any]) -> Any:
    """A helper that a worker process keeps for its next tasks: a tokenizer or a memo.

    A process holds one at a time, so workers that serve several operators in turn do not add up
    the helpers of all of them.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]
