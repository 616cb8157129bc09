"""What every part needs from a session: tables, the shared folder, size estimates."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The application's folder below the one that the driver and all executors see, spark.checkpoint.dir.

    All that this package writes for itself lies there, and `clean` removes it. Only a local session without that setting gets a temporary folder; a cluster without it is an error,
    as no folder of one machine would do.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return f"{path.rstrip('/')}/tributary-{spark.sparkContext.applicationId}"
    context = spark.sparkContext
    path = context.getCheckpointDir()
    if path is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir is unset; a cluster needs a shared folder there")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tributary-')}")
        path = context.getCheckpointDir()
    return f"{path.rstrip('/')}/tributary-{context.applicationId}"


def clean(spark: SparkSession) -> None:
    """Removes what this application's calls have written for themselves, once no result is to be read any more."""
    for t in spark.catalog.listTables():
        if t.name.startswith("tributary_") and not t.isTemporary:
            place = spark.sql(f"DESCRIBE FORMATTED {t.name}").where("col_name = 'Location'").first()
            if place and f"/tributary-{spark.sparkContext.applicationId}/" in place[1]:
                spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    remove(spark, shared_dir(spark))


def materialize(df: DataFrame, hint: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{hint}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Estimates from here on say that Spark doesn't know a size.
UNKNOWN = 1 << 60


def parts_for(df: DataFrame, bytes_each: int, least: int) -> int:
    """Parts of about bytes_each for the plan's estimated size, which grows with the input; one without an estimate is counted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN:
        long = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, kind in df.dtypes if kind in ("string", "binary")]
        size = df.agg(F.coalesce(F.sum(sum(long, F.lit(8 * len(df.columns)).cast("long"))), F.lit(0))).first()[0]
    return max(least, -(-size // bytes_each))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in any file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place))


def file_state(spark: SparkSession, path: str) -> tuple:
    """What changes where the files below a path do: their names, lengths and times."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names right below a path; none where it isn't there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(place)) if store.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what this package wrote below a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    store, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    return store, place


def read_text(path: str) -> str:
    """A small file, such as a configuration, in a local or remote folder."""
    store, place = _store(path)
    with store.open_input_stream(place) as f:
        return f.read().decode()


def write_text(path: str, text: str) -> None:
    store, place = _store(path)
    store.create_dir(place.rpartition("/")[0])
    with store.open_output_stream(place) as f:
        f.write(text.encode())
