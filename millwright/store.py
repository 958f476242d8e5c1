"""Tables in the folder that all machines share, used to cut lineage."""

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, one folder of this machine for each application,
    if all its tasks run here, as in tests; on a cluster that would lose rows, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="millwright-")
        found = _own[app]
    return found.rstrip("/")


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


class Cut:
    """A written table. ``df`` reads it; ``drop()`` removes it early, else it goes with the session."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.where = f"{shared_dir(self.spark)}/millwright/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.where)
        fs, path = _path(self.spark, self.where)
        fs.deleteOnExit(path)
        self.df = self.spark.read.schema(df.schema).parquet(self.where)

    def drop(self, shuffles: bool = True) -> None:
        """Removes the table, and with ``shuffles`` what the jobs before it left, which costs a collection."""
        fs, path = _path(self.spark, self.where)
        fs.delete(path, True)
        if not shuffles:
            return
        # shuffle files go when their last reference is collected
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: later jobs read it and never recompute it."""
    return Cut(df, name).df
