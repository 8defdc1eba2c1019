"""Deep pages of a long listing: a clustered copy with a directory of where its parts start."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.streaming.versions import CommitLog


class PageDirectory(CommitLog):
    """Rows sorted by range into parts, each in a folder of its own with every row's place in its part; the manifest says how many rows each part has.

    A page is found by adding up these numbers, and only the folders it lies in are opened; there, the place is sorted, so
    statistics leave the rest of a file unread.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int | None = None):
        super().__init__(spark, path)
        self.parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def build(self, rows: DataFrame, order: list[Column]) -> None:
        """order must tell all rows apart; a build that fails leaves the directory as it was."""
        folder = f"data/{uuid.uuid4().hex}"
        cut = rows.repartitionByRange(self.parts, *order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions("_part", *order)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        cut.withColumn("_place", place).write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        sizes = []
        if any(n.startswith("_part=") for n in self.names(folder)):
            sizes = [[r["_part"], r["n"]] for r in self.spark.read.parquet(f"{self.path}/{folder}").groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()]  # a row a part
        before = self.manifest()
        self.publish({"version": before["version"] + 1 if before else 0, "folder": folder, "sizes": sizes, "schema": rows.schema.jsonValue()})

    def parts_of(self, first: int, size: int) -> list[tuple[int, int]]:
        """(part, rows before it) of the parts that hold places first to first + size - 1."""
        out, before = [], 0
        for part, n in self.manifest()["sizes"]:
            if before < first + size and before + n > first:
                out.append((part, before))
            before += n
        return out

    def page(self, number: int, size: int = 50) -> DataFrame:
        """The rows of page ``number``, from 1, with place, their place in the listing from 1; beyond the end none."""
        from pyspark.sql.types import StructType

        found = self.manifest()
        schema = StructType.fromJson(found["schema"])
        first, out = (number - 1) * size, self.spark.createDataFrame([], StructType([*schema.fields]).add("place", "long"))
        for part, before in self.parts_of(first, size):
            rows = self.spark.read.schema(StructType([*schema.fields]).add("_place", "long")).parquet(f"{self.path}/{found['folder']}/_part={part}")
            out = out.unionByName(rows.filter(F.col("_place").between(first - before, first - before + size - 1)).withColumn("place", F.col("_place") + before + 1).drop("_place"))
        return out.orderBy("place")
