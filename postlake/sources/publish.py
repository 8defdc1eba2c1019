"""A sink that publishes a table whole or not at all, as a Python data source.

Each task writes its rows to a file of its own in a folder that belongs to the job; the driver then names that folder in a manifest, which takes
the place of the one before by a rename. A job that fails deletes its folder, and readers never see anything but the folder of the
last manifest. Paths may be of any file system that pyarrow opens.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "published.json"


def _open(path: str):
    """(file system, path) of a url or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class PublishWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.folder, self.schema = path.rstrip("/"), f"data-{uuid.uuid4().hex}", schema
        files, root = _open(self.path)
        files.create_dir(f"{root}/{self.folder}", recursive=True)  # here alone: a task that outlives an abort finds no folder to write to

    def write(self, iterator):
        import pyarrow.parquet as pq

        files, root = _open(self.path)
        name, rows, sink = f"{self.folder}/{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if sink is None:
                sink = pq.ParquetWriter(files.open_output_stream(f"{root}/{name}"), batch.schema)
            sink.write_batch(batch)
            rows += batch.num_rows
        if sink is not None:
            sink.close()
        return Written(name if rows else "", rows)

    def commit(self, messages):
        """Files of attempts that were not the last one of their task are not named, so they are never read."""
        files, root = _open(self.path)
        manifest = {"files": sorted(m.file for m in messages if m and m.file), "rows": sum(m.rows for m in messages if m), "schema": self.schema.jsonValue()}
        aside = f"{root}/{self.folder}.json"
        with files.open_output_stream(aside) as out:
            out.write(json.dumps(manifest).encode())
        files.move(aside, f"{root}/{MANIFEST}")

    def abort(self, messages):
        from pyarrow import fs

        files, root = _open(self.path)
        if files.get_file_info(f"{root}/{self.folder}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.folder}")


class PublishSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "publish"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite:
            raise ValueError("a published table is replaced as a whole: use mode overwrite")
        return PublishWriter(self.options["path"], schema)


def publish(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(PublishSource)
    df.write.format("publish").mode("overwrite").option("path", path).save()


def published(spark: SparkSession, path: str) -> DataFrame:
    """The table as last published."""
    manifest = json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])
    schema = StructType.fromJson(manifest["schema"])
    if not manifest["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in manifest["files"]])
