"""Tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names it; a temporary folder stands in only where that
is unset and all runs in one process, as in tests.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_TEMPORARY: dict[str, str] = {}
_STORED: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return f"{named.rstrip('/')}/lumenrec-tables-{app}"
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if app not in _TEMPORARY:
        _TEMPORARY[app] = "file://" + tempfile.mkdtemp(prefix="lumenrec-tables-")
    return _TEMPORARY[app]


def delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception as gone:  # at exit the JVM may be down already
        if spark.sparkContext._jsc is not None and "py4j" not in type(gone).__module__:
            raise


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it ends; Spark keeps them until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def table(spark: SparkSession, name: str) -> str:
    """The path of a new table, deleted at exit."""
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def append(df: DataFrame, path: str) -> None:
    with _swept(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").parquet(path)


def reread(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write and reread: cuts the lineage and survives lost executors."""
    path = table(df.sparkSession, name)
    append(df, path)
    return reread(df.sparkSession, path, df.schema)


def drop(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    delete(df.sparkSession, df.stored_at)


def stored(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage boundary table (split, candidates, features), made once per session and source."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _STORED:
        df = make()
        df = df if hasattr(df, "stored_at") else store(df, name)
        _STORED[key] = (df.stored_at, df.schema)
    return reread(spark, *_STORED[key])
