"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from graphtension.errors import InvalidConfig


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is named, a local session (tests) gets one of its own; on a
    cluster executors would each write to their own disk, so InvalidConfig is raised."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise InvalidConfig("name a folder that all machines share in spark.checkpoint.dir")
    own = tempfile.mkdtemp(prefix="graphtension-")
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


_LOCK, _WRITERS = threading.Lock(), {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """While any writer of the session is in here, shuffles are freed after their query; then the setting returns."""
    key = id(spark)
    with _LOCK:
        n, before = _WRITERS.get(key, (0, None))
        if not n:
            before = spark.conf.get(_CLEAN, None)
            spark.conf.set(_CLEAN, "true")
        _WRITERS[key] = (n + 1, before)
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITERS.pop(key)
            if n > 1:
                _WRITERS[key] = (n - 1, before)
            elif before is not None:
                spark.conf.set(_CLEAN, before)
            else:
                spark.conf.unset(_CLEAN)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut in the lineage that outlives executors.

    The shuffles behind it are no longer needed, so their files are freed.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote for ``df``; nothing that is still to run may read it."""
    path = getattr(df, "_written", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all, in any store that Spark reads."""
    fs, to = _at(spark, path)
    _, part = _at(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, to):
        fs.delete(to, False)
        fs.rename(part, to)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of a folder; none if it isn't there."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def bytes_in(spark: SparkSession, path: str) -> int:
    fs, p = _at(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0
