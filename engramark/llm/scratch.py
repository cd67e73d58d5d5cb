"""Tables written to cut lineage, in the folder that the cluster shares.

A table belongs to the owner in whose block it was written. settled() gives steps an
owner of their own and removes their tables when the result is written; release()
removes those of one owner. All that is left goes when the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_owner: ContextVar[str] = ContextVar("owner", default="")
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one is set on one machine; a cluster without one is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="engramark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _system(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


@contextmanager
def owner(name: str) -> Iterator[None]:
    """Tables written in the block, and in no block within it, belong to ``name``."""
    token = _owner.set(name)
    try:
        yield
    finally:
        _owner.reset(token)


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call returns."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(_owner.get(), []).append(path)
    system, target = _system(spark, path)
    system.deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, steps: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``steps`` as a table; the tables that they wrote on the way are removed."""
    inner = uuid.uuid4().hex
    with owner(inner):
        result = steps()
    result = written(result, name)
    release(spark, inner)
    return result


def remove(spark: SparkSession, path: str) -> None:
    system, target = _system(spark, path)
    system.delete(target, True)


def release(spark: SparkSession, name: str) -> None:
    """Removes the tables of an owner. Only for callers who have written what they made of them."""
    for path in _written.pop(name, []):
        remove(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
