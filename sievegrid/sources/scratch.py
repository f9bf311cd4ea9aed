"""Tables that cut lineage, written where every executor can read them.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that
is unset a local session gets a temporary folder; a cluster without it is an
error, since a machine-local folder would not be seen by other executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables of this application."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/sievegrid/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="sievegrid-")
    return _OWN[app]


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes ``df`` as a scratch table and reads it back, without lineage.

    The rows are computed once; a lost executor costs a re-read of shared files
    and not a recomputation. Files stay until ``clear`` or the end of the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a scratch table that nothing reads any more; ``table`` is what ``materialize`` gave."""
    spark = table.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        if folder.rsplit("/", 2)[-2] == shared_dir(spark).rsplit("/", 1)[-1]:  # only tables of this application
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application; results that weren't written elsewhere can't be read after that."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))  # the store's own client, whatever store it is
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
