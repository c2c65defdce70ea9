"""Session settings and the shared folder for checkpoints and round trips."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Useful on any cluster: wide feature projections compile to methods too long for
# the JVM's own compiler, and to more classes than the default cache holds.
TUNING = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.codegen.cache.maxEntries": "1000",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

#: Spark removes the shuffle files of a write at its end, not when the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "signalloom",
                  shared: str | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Small tables, many derived columns: keep one task per core busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in TUNING.items():
        builder = builder.config(key, value)
    if shared is not None:
        builder = builder.config("spark.checkpoint.dir", shared)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by `spark.checkpoint.dir`.

    A local master may go without: driver and tasks share one machine there, and a
    folder of the session's own is made and removed with it. A cluster without the
    setting is refused.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if named is None:
            named = tempfile.mkdtemp(prefix="signalloom-")
            _made.append(named)
        context.setCheckpointDir(named)
        current = context.getCheckpointDir()
    return spark.conf.get("spark.checkpoint.dir", None) or current


_made: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed at the end of the innermost `scratch` block, or else by `clear_scratch`."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _remove(entries: list[tuple[SparkSession, str]]) -> None:
    for spark, path in entries:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            jvm = spark.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class scratch:
    """Scratch tables made inside the block are removed at its end, but for those of `keep`.

    What is kept reads nothing but its own table, so nothing later needs the removed
    ones, not even to recover from a lost executor. Kept tables belong to the block
    around; `clear` removes them once no reader is left. Blocks nest; they are for one
    thread of the driver.
    """

    def __init__(self):
        self.kept: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> scratch:
        self.start = len(_written)
        return self

    def keep(self, df: DataFrame, name: str = "kept") -> DataFrame:
        """Write `df` now and continue from there, after the block too."""
        out = cut(df, name)
        self.kept.append(_written.pop())
        return out

    def __exit__(self, *failure) -> None:
        mine = _written[self.start :]
        del _written[self.start :]
        _remove(mine)
        _written.extend(self.kept)

    def clear(self) -> None:
        """Remove the tables of `keep`."""
        for entry in self.kept:
            if entry in _written:
                _written.remove(entry)
        _remove(self.kept)
        self.kept = []


def clear_scratch() -> None:
    """Remove everything written to scratch paths by this process.

    Results that were not read to the end lose what they are read from, so this is for
    the end of a job; it runs by itself when Python ends.
    """
    _remove(_written)
    _written.clear()
    while _made:
        shutil.rmtree(_made.pop(), ignore_errors=True)


atexit.register(clear_scratch)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write `df` as a table in the shared folder and continue from there.

    Later readers see the very same rows even when an executor is lost, which
    sampled partition bounds and partition ids would not survive otherwise, and
    read only the columns they need. What was shuffled for the table goes once it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
