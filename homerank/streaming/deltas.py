"""Tables that batches add to: a base and deltas, merged on reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


class Deltas:
    """Rows in buckets of a key, in one folder for each batch, and from time to time a base that takes the place of all before it.

    A batch writes its own folder only, over whatever an attempt before it left there, and reads those of batches before it; so a batch that
    runs again does the same again. After every `every`-th batch the base is written; what it covers is deleted when the next base
    stands, so a batch that runs again still finds it.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, buckets: int = 16, every: int = 16):
        self.spark, self.folder, self.buckets, self.every = spark, folder, buckets, every
        self.columns = schema.names
        self.own = schema
        self.schema = StructType([*schema.fields, StructField("version", LongType()), StructField("bucket", IntegerType())])

    def beside(self, name: str) -> Deltas:
        """A table of (fingerprint, id) that goes with this one."""
        fields = [StructField("fingerprint", self.own["fingerprint"].dataType), StructField("id", self.own["id"].dataType)]
        return Deltas(self.spark, f"{self.folder}-{name}", StructType(fields), self.buckets, self.every)

    def bucket(self, key: str) -> Column:
        return F.pmod(F.hash(key), F.lit(self.buckets))

    def compacts(self, number: int) -> bool:
        return (number + 1) % self.every == 0

    def _folders(self, before: int, bases: int | None = None) -> list[str]:
        """Where all rows of the batches before a number stand: the last base, or that of a number, and batches after it."""
        bases = before // self.every if bases is None else bases
        first = bases * self.every
        return [f"{self.folder}/base-{bases}"] * (bases > 0) + [f"{self.folder}/batch-{n}" for n in range(first, before)]

    def read(self, before: int, bases: int | None = None) -> DataFrame:
        """All versions of the rows of the batches before a number, with `version` and `bucket`."""
        out = None
        for folder in self._folders(before, bases):
            # Each folder is read by itself, so that buckets stay partitions.
            part = self.spark.read.schema(self.schema).parquet(folder)
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], self.schema) if out is None else out

    def latest(self, before: int, key: str, wanted: DataFrame | None = None) -> DataFrame:
        """The last version of each key's row; with `wanted` (bucket, key) of those keys alone."""
        rows = self.read(before)
        if wanted is not None:
            rows = rows.join(wanted.select("bucket", key), ["bucket", key], "left_semi")
        last = rows.groupBy(key).agg(F.max_by(F.struct(*self.columns, "bucket"), "version").alias("__row"))
        return last.select("__row.*")

    def write(self, rows: DataFrame, number: int) -> None:
        """Write a batch's rows (with `bucket`) into its own folder."""
        self._put(rows.withColumn("version", F.lit(number).cast("bigint")), f"{self.folder}/batch-{number}")

    def _put(self, rows: DataFrame, path: str) -> None:
        rows.select(*self.columns, "version", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def compact(self, number: int, key: str, *more: str) -> None:
        """Write the base of the batches up to a number: of each key (and `more` columns) its last version. Then delete the batches that the
        base before covers."""
        keys = [key, *more]
        base = (number + 1) // self.every
        rows = self.read(number + 1, base - 1).groupBy(*keys).agg(F.max_by(F.struct(*self.columns, "version", "bucket"), "version").alias("__row"))
        # One task a bucket and slice of it, so that a base has files of even size.
        self._put(rows.select("__row.*").repartition("bucket", F.pmod(F.xxhash64(*keys), F.lit(4))), f"{self.folder}/base-{base}")
        for n in range((base - 2) * self.every, (base - 1) * self.every):
            self._delete(f"{self.folder}/batch-{n}")
        self._delete(f"{self.folder}/base-{base - 2}")

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
