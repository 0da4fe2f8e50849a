"""Session, scratch-table and text helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """Folder of this run inside spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent a local session takes a folder under the temporary directory; a cluster has no folder
    that all its executors see, so there that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{base.rstrip('/')}/strandset-{uuid.uuid4().hex}"
        atexit.register(_remove_quietly, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM has gone; the folder is left to the cluster's own cleaning
        pass


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str, by: tuple[str, ...] = (), **options: str) -> DataFrame:
        """``df`` written and read again; ``by``: columns that make folders, so that a filter on them reads no other."""
        where = f"{self.path}/{name}"
        df.write.options(**options).partitionBy(*by).parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.path}/{name}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns freed memory of this worker to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def keep_freed() -> None:
    """Lets this worker use freed arrays again without asking the system for cleared pages, until ``give_back``."""
    import ctypes

    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):  # not glibc
        return
    mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
    mallopt(-1, 1 << 27)  # M_TRIM_THRESHOLD


def lean(run: Callable, encodes: bool = False) -> Callable:
    """``run`` (for mapInArrow) in a worker that may be reused: what tokenizing tasks before it cached goes first, unless it
    ``encodes`` itself, and freed memory goes back when it ends."""

    def call(batches: Iterator) -> Iterator:
        from strandset.llm.tokens import forget

        if not encodes:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return call


def arrow_column(run: Callable, kind):
    """A function of one column from ``run`` (an iterator of Arrow arrays to one of arrays of type ``kind``). Rows stay in the JVM
    meanwhile: only the column goes to the worker, and only the result comes back."""
    import pyarrow as pa

    call = lean(run)
    call.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(call, kind)


def binary(column) -> list:
    """Texts of an Arrow column as bytes; null becomes b''."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
