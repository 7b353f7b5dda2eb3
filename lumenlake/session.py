"""Sessions, and how the package reaches the executors."""

from __future__ import annotations

import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "lumenlake") -> SparkSession:
    """A session for tests and benchmarks on this machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.parent.suffix != ".zip":
        path = Path(tempfile.mkdtemp(prefix="lumenlake-")) / "lumenlake_code.zip"
        with zipfile.ZipFile(path, "w") as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, source.relative_to(root.parent))
        context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


#: Tables of fewer bytes than this may lie in fewer partitions than there are cores.
SPREAD_BYTES = 64 << 20


def spread(frame: DataFrame) -> DataFrame:
    """A small table dealt over all cores, for work that is heavy for each row.

    Small files are one task however costly their rows are; dealing them costs a
    shuffle of at most SPREAD_BYTES.  Larger tables have enough splits of their own
    and are left as they are.
    """
    if frame.isStreaming:
        return frame
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return frame.repartition(4 * frame.sparkSession.sparkContext.defaultParallelism) if size < SPREAD_BYTES else frame


#: Bytes of a table of costly rows that a task takes, about.
DEAL_BYTES = 8 << 20


def deal(frame: DataFrame) -> DataFrame:
    """A table of rows that take milliseconds each, such as pictures, dealt into many tasks whatever its size.

    A file of one row group is one task however many splits it has, so splits cannot
    be relied on; a shuffle of the rows costs little beside the work on them.
    """
    if frame.isStreaming:
        return frame
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return frame.repartition(max(8 * frame.sparkSession.sparkContext.defaultParallelism, min(size // DEAL_BYTES, 100_000)))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumenlake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of a scan that a task reads at most where their number is asked for.
TASK_BYTES = 1 << 30


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Settings for work that is done at once; what the session had comes back afterwards."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def arrow_rows(spark: SparkSession, rows: int, tasks: int = 0):
    """``settings`` by which Arrow batches have ``rows`` rows, and files are dealt over some ``tasks`` tasks where given."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}
    if tasks:
        wanted |= {"spark.sql.files.minPartitionNum": str(tasks), "spark.sql.files.maxPartitionBytes": str(TASK_BYTES)}
    return settings(spark, wanted)
