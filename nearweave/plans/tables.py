"""Tables that cut lineage between steps, in the folder that all executors share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Spark's switch that deletes an execution's shuffle files when it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset and all executors run in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "/tmp/checkpoints"
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str = "t") -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/nearweave-{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_pages() -> None:
    """This Python's C heap hands its free pages back to the system, where its library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _free_jvm_pages(spark: SparkSession) -> None:
    """The same for the C heap of the driver's JVM, where that has the command (jcmd's System.trim_native_heap)."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    # The server's own class isn't public, so its method is called by way of the interface.
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = name, "systemTrimNativeHeap"
    with suppress(Py4JJavaError):
        invoke.invoke(server, args)


def _released(spark: SparkSession) -> None:
    """The driver lets go of what earlier steps leave before its heap is half full: plans, their constants, broadcasts.

    Otherwise the heap grows to its bound, and stays there beside the memory that is not in it; that, too, keeps what
    compiling and sending tasks leave.
    """
    free_pages()
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        spark._jvm.System.gc()
    _free_jvm_pages(spark)


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: nothing reads them once the table stands."""
    held = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, held) if held is not None else spark.conf.unset(_CLEAN)


class Tables:
    """Intermediate tables of one run. Leaving the block deletes all but those that were kept.

    What a run inside another one keeps belongs to the outer run, and goes with it.
    """

    _open: list[Tables] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = shared_path(spark, "run")
        self._paths: dict[int, str] = {}
        self._frames: list[DataFrame] = []

    def __enter__(self) -> Tables:
        Tables._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Tables._open.remove(self)
        delete(self.spark, self.root)

    def settle(self, df: DataFrame) -> DataFrame:
        """Write the rows and read them again: later steps don't repeat earlier ones, and a lost executor costs one step."""
        out, path = _written(df, f"{self.root}/{len(self._frames)}")
        self._paths[id(out)] = path
        self._frames.append(out)  # an id stays unique while its frame is held
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in frames:
            delete(self.spark, self._paths.pop(id(df)))

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows in a table that outlives this run: what a returned frame may read."""
        outer = Tables._open[Tables._open.index(self) - 1] if Tables._open.index(self) else None
        return outer.settle(df) if outer else _written(df, shared_path(self.spark))[0]


def _written(df: DataFrame, path: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    with _shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    _released(spark)
    return spark.read.schema(df.schema).parquet(path), path


def settle(df: DataFrame) -> DataFrame:
    """The rows in a table of the run that is open, or else in one that stays."""
    return Tables._open[-1].settle(df) if Tables._open else _written(df, shared_path(df.sparkSession))[0]
