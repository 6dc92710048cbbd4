"""Written intermediate tables in the shared folder of the cluster.

Lineage is cut by writing Parquet to the folder named in ``spark.checkpoint.dir``, which every executor reaches, so a lost
executor loses nothing that was written. A folder of our own is made only where that setting is absent and everything runs on
this machine, as in tests; a cluster without the setting is an error, as its executors would write where no other one reads.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, list[str]] = {}
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def folder(spark: SparkSession) -> str:
    """URI of the shared folder."""
    set_already = spark.conf.get("spark.checkpoint.dir", None)
    if not set_already:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors reach")
        set_already = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", set_already)
    return set_already if "://" in set_already or set_already.startswith("file:") else "file://" + set_already


def path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed by `clear` or when the driver's interpreter ends."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = []
        atexit.register(_forget, spark, app)
    made = f"{folder(spark)}/weftgraph/{app}/{name}-{uuid.uuid4().hex}"
    _made[app].append(made)
    return made


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """The rows of `df`, computed once, written and read again. With `free`, its shuffle files are then deleted at once."""
    spark = df.sparkSession
    at = path(spark, name)
    before = spark.conf.get(FREE, None)
    if free:
        spark.conf.set(FREE, "true")
    try:
        df.write.parquet(at)
    finally:
        if free:
            spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)
    made = spark.read.schema(df.schema).parquet(at)
    _places[made] = at
    return made


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing still to be evaluated is built on."""
    for table in tables:
        _delete(table.sparkSession, _places.pop(table))


def _delete(spark: SparkSession, made: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete every table written so far; DataFrames built on them can no longer be evaluated."""
    for made in _made.get(spark.sparkContext.applicationId, []):
        _delete(spark, made)
    _made.pop(spark.sparkContext.applicationId, None)


def _forget(spark: SparkSession, app: str) -> None:
    try:
        if app in _made and spark.sparkContext._jsc is not None:
            clear(spark)
    except Exception:  # the JVM has gone already  # noqa: BLE001
        return
