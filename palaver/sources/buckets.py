"""Tables whose rows lie in a fixed number of buckets by a hash of their key, each bucket in versions (ST9, S14).

A job writes the buckets that it changes as a new version beside the old one.  All rows of a bucket are one file, which
appears when its task is committed, so a version is there as a whole or not at all, and readers take the newest version of
each bucket.  A version carries the number of the job that wrote it: a job that runs again after a failure sees which
buckets it had reached.  Files of other buckets are not touched.  Numbers of later jobs have to be larger, and one job
writes at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class BucketTable:
    """Rows below *path* by the bucket of *key* and by version."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _place(self, below: str | None = None):
        """A path of the table and its file system."""
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        at = make(self.path) if below is None else make(make(self.path), below)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> dict[int, list[int]]:
        """The versions of each bucket, from the names of their folders."""
        at, fs = self._place()
        found: dict[int, list[int]] = {}
        if fs.exists(at):
            for status in fs.globStatus(self._place("bucket=*/version=*/*.parquet")[0]) or []:
                version = status.getPath().getParent()
                found.setdefault(int(version.getParent().getName().split("=")[1]), []).append(int(version.getName().split("=")[1]))
        return {b: sorted(v) for b, v in found.items()}

    def newest(self) -> dict[int, int]:
        return {b: v[-1] for b, v in self.versions().items()}

    def read(self, of: dict[int, int] | None = None) -> DataFrame | None:
        """The rows of the given versions by bucket, else of all newest ones; None where there are none."""
        paths = [f"{self.path}/bucket={b}/version={v}" for b, v in sorted((self.newest() if of is None else of).items())]
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, rows: DataFrame, version: int) -> None:
        """Write the buckets of *rows* as one version; they hold whatever the bucket is to hold from now on."""
        placed = rows.withColumns({"bucket": self.bucket(), "version": F.lit(version).cast("long")})
        placed.repartition("bucket").write.mode("append").option("maxRecordsPerFile", 0).partitionBy("bucket", "version").parquet(self.path)

    def vacuum(self) -> int:
        """Remove versions that are not the newest of their bucket, once no reader needs them."""
        old = [(b, v) for b, versions in self.versions().items() for v in versions[:-1]]
        for b, v in old:
            at, fs = self._place(f"bucket={b}/version={v}")
            fs.delete(at, True)
        return len(old)

    def remove(self) -> None:
        at, fs = self._place()
        fs.delete(at, True)
