"""Session defaults, the shared work folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Work folders made for sessions without spark.checkpoint.dir (local masters only), by application id.
_own_folders: dict[str, str] = {}
#: (session, path) of every folder this process wrote below a shared folder.
_written: list[tuple[SparkSession, str]] = []

#: Temporary folders of this process, on the driver's machine.
_temporary: list[str] = []

#: Applications whose workers have this package.
_shipped: set[str] = set()

#: Rows and bytes a side may have at most to be broadcast; beyond either the join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Bytes of input (as stored) for each partition of a shuffle whose partitions are numbered and can't be split or joined later.
PARTITION_BYTES = 256 << 20


class SharedFolderMissing(RuntimeError):
    """A cluster session names no folder that all executors share."""


def build_session(app: str = "driftwell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times, adaptive execution and Arrow transfer; *conf* overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, but on a local master only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.applicationId not in _own_folders:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise SharedFolderMissing("set spark.checkpoint.dir to a folder that every executor can reach")
        _own_folders[context.applicationId] = "file://" + _temporary_folder()
    return _own_folders[context.applicationId]


def _temporary_folder() -> str:
    _temporary.append(tempfile.mkdtemp(prefix="driftwell-"))
    return _temporary[-1]


def with_package(df: DataFrame) -> DataFrame:
    """*df*, after this package was sent to the Python workers of its session (once per application)."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        name = os.path.join(_temporary_folder(), f"{os.path.basename(root)}.zip")
        with zipfile.ZipFile(name, "w") as bundle:
            for folder, _, files in os.walk(root):
                for file in files:
                    if file.endswith(".py"):
                        path = os.path.join(folder, file)
                        bundle.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(name)
        _shipped.add(context.applicationId)
    return df


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the process ends."""
    path = f"{shared_folder(spark)}/driftwell-{uuid.uuid4().hex}/{name}"
    _written.append((spark, path.rsplit("/", 1)[0]))
    return path


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """*df*, written once as Parquet to the shared folder and read from there: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's (FileSystem, Path) of *path*."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below *path*; no job is run."""
    fs, at = file_system(spark, path)
    return int(fs.getContentSummary(at).getLength()) if fs.exists(at) else 0


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            fs, at = file_system(spark, path)
            fs.delete(at, True)
        except Exception:  # the session or its JVM has ended: only a local folder can still be removed
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
    for path in _temporary:
        shutil.rmtree(path, ignore_errors=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """*df* with a broadcast hint if it has at most *rows* rows of *size* bytes in all, else as it is.

    Rows and bytes are added up in the map tasks, so one row a task is shuffled. *df* is computed for it: it should be
    written data, or cheap.
    """
    fixed = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType))]
    varying = [F.coalesce(F.length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema.fields if f.name not in fixed]
    row_bytes = sum(varying, F.lit(16 * len(df.columns)))
    n, held = df.agg(F.count(F.lit(1)), F.sum(row_bytes)).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files *df* reads, as Catalyst's leaves give them; nothing is run. A leaf of unknown size counts as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def slots(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partitions_for(df: DataFrame, each: int = PARTITION_BYTES) -> int:
    """Partitions for a shuffle of *df* with a fixed number: the session's, or more where the input is larger than *each* for every one."""
    return max(slots(df.sparkSession), -(-input_bytes(df) // each))
