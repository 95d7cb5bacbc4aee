"""Session helpers: the shared work folder and written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is read from ``spark.checkpoint.dir``. Only where that is unset and all
    runs on one machine, as in tests, a temporary folder is made and removed at
    exit; on a cluster each executor would see a folder of its own, so that is
    an error.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="coterie-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package's source to the executors, once per application.

    Their Python workers then need neither an installation nor a path. The
    archive lies in the shared folder.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if sc.applicationId in _SHIPPED or not os.path.isdir(root):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(root)))
    where = spark._jvm.org.apache.hadoop.fs.Path(work_path(spark, "source") + "/coterie.zip")
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(str(where))
    _SHIPPED.add(sc.applicationId)


_KEPT: set[str] = set()


def work_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses.

    It lies in a folder of the application, which is removed when the driver's
    Python ends: results are lazy and may read written tables until then.
    """
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/coterie/{app}"
    if app not in _KEPT:
        _KEPT.add(app)
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        conf = spark._jsc.hadoopConfiguration()

        def remove() -> None:
            # a JVM that is already gone leaves the folder to whoever owns the shared one
            with contextlib.suppress(Exception):
                where.getFileSystem(conf).delete(where, True)

        atexit.register(remove)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def named_path(spark: SparkSession, name: str, source: str) -> str:
    """A path in the shared folder that is the same for the same source."""
    return f"{shared_dir(spark)}/coterie/{name}-{hashlib.sha1(source.encode()).hexdigest()[:12]}"


def materialise(df: DataFrame, name: str, path: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage in a way that outlives any executor. Returns the
    table and its path; ``discard`` removes it once nothing reads it.
    """
    spark = df.sparkSession
    path = path or work_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def at_once(spark: SparkSession, *steps: Callable) -> tuple:
    """The results of steps that do not wait for each other, each in a thread of its own."""
    with ThreadPoolExecutor(max(1, len(steps))) as pool:
        return tuple(f.result() for f in [pool.submit(inheritable_thread_target(spark)(s)) for s in steps])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def state(spark: SparkSession, path: str) -> str:
    """Size, number and time of the files at a path: changed content is a new state."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    of = fs.getContentSummary(where)
    return f"{of.getLength()} {of.getFileCount()} {fs.getFileStatus(where).getModificationTime()}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove written tables."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(conf).delete(where, True)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Split an input of few partitions over all cores before costly work.

    Large inputs have enough partitions and are left alone, so nothing is
    shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * per_core)
