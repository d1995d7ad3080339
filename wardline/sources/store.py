"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one folder of our own for an application where none is set, in local mode only."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors share no other folder")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return _OWN[app]


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: later steps read it instead of making it again."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Removes the files of a stored table that no later step reads."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        home = spark._jvm.org.apache.hadoop.fs.Path(folder)
        home.getFileSystem(spark._jsc.hadoopConfiguration()).delete(home, True)
