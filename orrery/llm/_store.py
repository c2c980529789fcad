"""Tables that a job writes for itself, in the folder that all machines share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_swept = [0.0]
#: A side of a join is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a temporary folder in local mode, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="orrery-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def stored(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it: cuts lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    # Shuffle files of finished steps go when the driver finds their plans unused; long jobs should not wait for that.
    if time.monotonic() - _swept[0] > 2:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _swept[0] = time.monotonic()
    out = spark.read.schema(schema).parquet(path)
    out._orrery_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote; nothing may read them any more."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table._orrery_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame) -> DataFrame:
    """``df``, broadcast if its rows, which are counted, are few."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def free(columns: list[str], name: str) -> str:
    """``name``, or a longer one that no column has."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Texts can be long: hold fewer rows in an Arrow batch than Spark's default, unless the session set a number."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def give_back() -> None:
    """Return this process's free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What a worker keeps from task to task, and how to let go of it: tasks of other operators do so first.
_kept: dict[str, Callable[[], None]] = {}


def tidy(run: Callable[[Iterator], Iterator], keeps: str | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, giving the memory of a task back to the system at its end, as workers outlive tasks;
    before it, also what other operators have kept in the worker (``keeps`` names what stays)."""

    def clean(batches):
        for name, drop in _kept.items():
            if name != keeps:
                drop()
        yield from run(batches)
        give_back()

    return clean
