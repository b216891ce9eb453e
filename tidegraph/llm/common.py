"""Shared pieces of the training-data operators: table access, the shared folder, Arrow helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tidegraph.operators.storage import delete, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where tables of the running block go within the shared folder.
_within: ContextVar[str] = ContextVar("within", default="")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within the block are deleted at its end: what they serve must be written by then."""
    name = f"scratch-{uuid.uuid4().hex}/"
    token = _within.set(name)
    try:
        yield
    finally:
        _within.reset(token)
        delete(spark, f"{shared_dir(spark)}/{name}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again. The driver then gives its free memory back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_within.get()}{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release_driver_memory(spark)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, max_bytes: int = 8 << 20) -> DataFrame:
    """mapInArrow whose batches are cut so that one holds at most a few MB of text."""

    def run(batches):
        yield from fn(small_batches(batches, max_bytes))
        release_memory()  # the worker waits for its next task without what this one held

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Give what is free in the pools of Arrow and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def release_driver_memory(spark: SparkSession) -> None:
    """Release the driver's Python memory, and the C library's pools in its JVM: the hundreds of threads that plan and broadcast leave
    in them what they have freed. A JVM without the command for that (not HotSpot, or not on glibc) keeps its pools."""
    release_memory()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # its class is not exported to Py4J: the method is taken from the public interface
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
    args = gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(server, args)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getName() != "java.lang.reflect.InvocationTargetException":
            raise


def small_batches(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of each batch with about max_bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, max_bytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
