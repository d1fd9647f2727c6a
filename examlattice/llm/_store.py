"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Only where it is unset (tests, one machine) a temporary folder takes its place."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if folder:
        return folder
    own = getattr(spark, "_examlattice_scratch", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = spark._examlattice_scratch = "file://" + tempfile.mkdtemp(prefix="spark-")
    return own


class Scratch:
    """Cuts lineage: `keep` writes a DataFrame as Parquet to the shared folder and reads it again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        """Deletes what `keep` wrote, once nothing reads it any more."""
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Ids that may go to every task: two million longs take some tens of MB. Of more ids, both sides are shuffled.
BROADCAST_IDS = 2_000_000


def restrict(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """rows with (left_semi) or without (left_anti) a key among ids, a table of distinct keys that is counted first. Long texts are
    then not shuffled for a few ids."""
    from pyspark.sql import functions as F

    if ids.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), key, how)
    return rows.join(ids.hint("shuffle_hash"), key, how)


def joined(rows: DataFrame, table: DataFrame, key: str, size: int) -> DataFrame:
    """rows with the columns of a table of distinct keys that is of a counted size; see restrict."""
    from pyspark.sql import functions as F

    return rows.join(F.broadcast(table) if size <= BROADCAST_IDS else table.hint("shuffle_hash"), key)
