"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; where none is set, a folder of our own in local mode and an error elsewhere."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
    sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="palaver-checkpoint-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows go to the shared checkpoint folder and survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one job, written as compressed Parquet to the shared folder and removed together when it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, shared_path(spark, "scratch"), 0

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        remove_path(self.spark, self.folder)


def fresh(name: str, df: DataFrame) -> str:
    """A column name made from *name* that *df* does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_{uuid.uuid4().hex[:6]}"
    return name


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
