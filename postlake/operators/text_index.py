"""Full text by an inverted index: sorted term postings in files of known range, kept up by segments of touched rows.

The first segment holds a row for each term and id, sorted over the whole segment by range, so a frequent term spreads over many files and
all words with one prefix lie together. A segment's directory has the first and last term of each of its files; a look-up opens only files whose
range meets a wanted prefix, and within them Parquet's statistics skip row groups. Rows that change later go to a further segment,
with the ids that it touches: what older segments say about these no longer counts, and a touched id without text is gone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.text import tokens
from postlake.streaming.versions import CommitLog

#: Above every string that begins with a prefix, if put behind it.
LAST = "\U0010ffff"


def terms_of(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(term, id): each word of a row once, without case and marks; a null field has none."""
    return docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(tokens(F.concat_ws(" ", *fields)))).alias("term")).select("term", "id")


class TextIndex(CommitLog):
    def __init__(self, spark: SparkSession, path: str, files: int | None = None):
        """files: how many a segment has; by default the session's shuffle partitions."""
        super().__init__(spark, path)
        self.files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _segment(self, terms: DataFrame, files: int) -> dict:
        folder = f"data/{uuid.uuid4().hex}"
        rows = terms.repartitionByRange(files, "term", "id").withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "term", "id")
        rows.write.partitionBy("part").parquet(f"{self.path}/{folder}/terms")
        if not any(n.startswith("part=") for n in self.names(f"{folder}/terms")):
            return {"folder": folder, "parts": [], "kind": terms.schema["id"].dataType.simpleString()}
        # a row a file
        ranges = self.spark.read.parquet(f"{self.path}/{folder}/terms").groupBy("part").agg(F.min("term").alias("low"), F.max("term").alias("high")).orderBy("part").collect()
        return {"folder": folder, "parts": [[r["part"], r["low"], r["high"]] for r in ranges], "kind": terms.schema["id"].dataType.simpleString()}

    def build(self, docs: DataFrame, id_col: str, fields: list[str]) -> None:
        """Index all rows anew; what was indexed before stays readable until this is whole."""
        before = self.manifest()
        version = before["version"] + 1 if before else 0
        self.publish({"version": version, "segments": [self._segment(terms_of(docs, id_col, fields), self.files)]})

    def touch(self, ids: DataFrame, docs: DataFrame, id_col: str, fields: list[str]) -> None:
        """Index docs in place of what is indexed of ids(id); an id without a row in docs is gone."""
        now = self.manifest()
        segment = self._segment(terms_of(docs, id_col, fields), max(1, self.files // 8))
        ids.select(F.col(id_col).alias("id")).distinct().write.parquet(f"{self.path}/{segment['folder']}/touched")
        self.publish({"version": now["version"] + 1, "segments": [*now["segments"], segment | {"touched": True}]})

    def _parts(self, segment: dict, words: list[str]) -> list[str]:
        hit = [p for p, low, high in segment["parts"] if any(w <= high and low <= w + LAST for w in words)]
        return [f"{self.path}/{segment['folder']}/terms/part={p}" for p in hit]

    def files_for(self, words: list[str]) -> tuple[list[str], int]:
        """(folders that a look-up of the words reads, how many there are)."""
        segments = self.manifest()["segments"]
        return [f for s in segments for f in self._parts(s, words)], sum(len(s["parts"]) for s in segments)

    def search(self, words: list[str]) -> DataFrame:
        """(id) of the rows that have, for every word, a term that begins with it. Without words there is no condition to index, so none is found."""
        segments = self.manifest()["segments"]
        kind = segments[0]["kind"]
        within: Column = F.lit(False)
        for w in words:
            within |= (F.col("term") >= w) & (F.col("term") < w + LAST)
        found = self.spark.createDataFrame([], f"id {kind}, mask long, segment int")
        for n, segment in enumerate(segments):
            if paths := self._parts(segment, words):
                mask = sum((F.startswith("term", F.lit(w)).cast("long") * (1 << i) for i, w in enumerate(words)), F.lit(0).cast("long"))
                rows = self.spark.read.schema(f"term string, id {kind}").parquet(*paths).filter(within)
                found = found.unionByName(rows.select("id", mask.alias("mask"), F.lit(n).alias("segment")))
        touched = [self.spark.read.schema(f"id {kind}").parquet(f"{self.path}/{s['folder']}/touched").select("id", F.lit(n).alias("_last")) for n, s in enumerate(segments) if s.get("touched")]
        if touched:
            last = touched[0]
            for more in touched[1:]:
                last = last.unionByName(more)
            last = last.groupBy("id").agg(F.max("_last").alias("_last"))
            found = found.join(last, "id", "left").filter(F.col("_last").isNull() | (F.col("segment") >= F.col("_last")))
        whole = (1 << len(words)) - 1
        return found.groupBy("id").agg(F.bit_or("mask").alias("mask")).filter((F.col("mask") == whole) & F.lit(bool(words))).select("id")
