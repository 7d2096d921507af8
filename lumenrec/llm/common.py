"""Small shared tools: shared-folder tables, column guards, text normal forms."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOT: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and
    all runs in one process (tests) a temporary folder stands in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if named:
        return f"{named.rstrip('/')}/lumenrec-{app}"
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="lumenrec-")
    return _OWN_ROOT[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a shared-folder table; a session that has ended is no error."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception as gone:  # the JVM may be down already at exit
        if spark.sparkContext._jsc is not None and "py4j" not in type(gone).__module__:
            raise


def table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and return (rows read back, path).

    This cuts the lineage: the copy outlives lost executors, and values that a
    recomputation could change (partition ids, row positions) become fixed.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    return table(df, name)[0]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def row_keys(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """(rows, column that tells them apart).

    The identifier, where it is never null and never repeats.  Otherwise the rows
    are stored with a number each, which later plans then read alike.
    """
    ids = docs.groupBy(F.col(quoted(id_col)).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("n > 1 OR i IS NULL").isEmpty():
        return docs, id_col
    key = fresh(docs, "row_number")
    return cut(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


#: Keys (8 bytes or so each) of dropped rows that may be broadcast; more are joined by shuffle.
BROADCAST_KEYS = 2_000_000


def without(docs: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in the stored one-column table ``dropped``.

    A list of up to BROADCAST_KEYS keys (counted) goes to the rows, so texts do
    not move; beyond that both sides are shuffled by key.
    """
    (name,) = dropped.columns
    gone = dropped.select(F.col(quoted(name)).alias(fresh(docs, "gone")))
    if dropped.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[quoted(key)] == gone[gone.columns[0]], "left_anti")


def text_or_empty(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def one_space(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
