"""Session set-up, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What has been written for a lineage cut and not been cleaned, by session.
_WRITTEN: dict[str, list[str]] = {}
#: Of so many Parquet files at most the footers are read to know how many rows a table has.
MOST_FOOTERS = 64


def local_session(cores: int | str = "*", app: str = "ledgerloom", memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests, benches and the command line."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: the session's ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one process (tests, a single
    machine) a temporary folder is made, once per session, and removed at its
    end; a cluster without the setting is an error.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"{key} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set(key, found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has, to be cleaned with the rest."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage so that a lost executor costs a re-read, not a re-run, and
    so that a stage used twice runs once.  See :func:`clean`.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes what :func:`written` has left in the shared folder; results that still read it must be stored before."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def _rows_on_file(df: DataFrame) -> int | None:
    """Rows of the Parquet files behind a plan that only narrows them, from their footers; null for any other plan."""
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        while plan.nodeName() in ("Project", "Filter"):
            plan = plan.children().head()
        files = df.inputFiles() if plan.nodeName() == "LogicalRelation" else []
        if not 0 < len(files) <= MOST_FOOTERS:
            return None
        import pyarrow.parquet as pq
        from pyarrow import fs

        opened = [fs.FileSystem.from_uri(f) for f in files]
        return sum(pq.read_metadata(path, filesystem=system).num_rows for system, path in opened)
    except Exception:  # noqa: BLE001 - no JVM at hand, no Parquet, a file system that is not known here
        return None


def bounded(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to hold at most ``rows`` rows.

    Parameter tables, and tables written before, are known by the footers of
    their files and cost no job; others are counted.
    """
    known = _rows_on_file(df)
    if known is None or known > rows:
        known = df.limit(rows + 1).count()
    return F.broadcast(df) if known <= rows else df


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow batches of at most ``rows`` for what is run inside, for stages on long texts; the session's setting comes back.

    A batch is held as a whole by the executor and by its Python worker, and by
    default has 10,000 rows of whatever length.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)
