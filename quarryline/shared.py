"""Tables written in the folder that all executors share.

Lineage is cut by writing a table, never by localCheckpoint: an executor may
be lost at any time and what it held must be readable by the others.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (tests, local mode)."""
    own = spark.sparkContext.getConf().get(CHECKPOINT_DIR) or spark.conf.get(CHECKPOINT_DIR, None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set(CHECKPOINT_DIR, own)
        _made.append((spark, own))
    return own.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/quarryline/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a compressed table in the shared folder and read it back; the result's lineage is that table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, path: str, key: str, n: int) -> DataFrame:
    """Write df, parted by `key` already, as a table of n buckets at `path`, sorted by key: later joins and aggregations on it
    need no shuffle. The catalogue keeps no entry of it; opened() reads it again, in any session."""
    spark, name = df.sparkSession, f"quarryline_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    return opened(spark, path, df.schema.simpleString().removeprefix("struct<").removesuffix(">"), key, n)


def opened(spark: SparkSession, path: str, schema: str, key: str, n: int) -> DataFrame:
    """The table that bucketed() wrote at `path`; dropping the entry that names its buckets leaves the files."""
    name = f"quarryline_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _parsed(schema))
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{path}'")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _parsed(schema: str):
    from pyspark.sql.types import DataType

    return DataType.fromDDL(f"struct<{schema}>")


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a file or folder; whether it worked."""
    (here, fs), there = _at(spark, path), _at(spark, to)[0]
    return fs.rename(here, there)


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete or not there: written beside its place and renamed; fails if the place is taken."""
    part, fs = _at(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if exists(spark, path) or not move(spark, str(part), path):
        fs.delete(part, False)
        raise OSError(f"{path} is there already")


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove on leaving what was written to the shared folder within: for long sessions, around a query and its action."""
    before = len(_made)
    shared_dir(spark)
    before = max(before, len(_made))
    try:
        yield
    finally:
        release(before)
        tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of stages that nothing refers to any more; it otherwise waits for the driver's
    heap to fill up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def release(keep: int = 0) -> None:
    """Remove the tables that this process wrote, all but the first `keep`."""
    while len(_made) > keep:
        spark, path = _made.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass
