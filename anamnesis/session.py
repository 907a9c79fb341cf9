"""Session settings the jobs rely on, and where a job may cut its lineage."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOCAL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "8192",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "anamnesis",
                  **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {**LOCAL_SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions),
                "spark.driver.memory": os.environ.get("ANAMNESIS_DRIVER_MEMORY", "12g"), **extra}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> None:
    """Stored times are UTC instants; text output must not follow the host zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. In local mode, where every task shares the
    driver's disk, a private one serves if none is set; on a cluster that is an error.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="anamnesis-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


#: Whether Spark drops the shuffle files of a write when the write ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes = threading.local()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when each of them ends, and not when the driver happens to
    collect its garbage. What was written does not need them."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def write_table(df: DataFrame) -> str:
    """The path of a new table in the shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return path


def read_tables(like: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Tables of the columns of `like`; a `scratch` around the call drops them at its end."""
    held = getattr(_scopes, "held", None)
    if held:
        held[-1].extend(paths)
    return like.sparkSession.read.schema(like.schema).parquet(*paths)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise as a table in the shared checkpoint folder and go on from there.

    A lost executor then replays from the table. Parquet keeps column pruning, predicate
    pushdown and a known size for the steps that follow.
    """
    return read_tables(df, [write_table(df)])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `cut_lineage` makes inside go at the end; no DataFrame made of them may be used after it."""
    if not hasattr(_scopes, "held"):
        _scopes.held = []
    made: list[str] = []
    _scopes.held.append(made)
    try:
        yield
    finally:
        _scopes.held.pop()
        for path in made:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` gives, as a table; the tables made on the way to it go."""
    with scratch(spark):
        result = make()
        path = write_table(result)
    return read_tables(result, [path])
