"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name, even beside columns that differ only in case or repeat a name."""
    at = [df.columns.index(n) for n in names]
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


def packed(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and ``row``, a struct of all columns by position; :func:`unpacked` is its reverse."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    named = [F.col(f"c{df.columns.index(n)}").alias(n) for n in names]
    return plain.select(*named, F.struct(*plain.columns).alias("row"))


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select("row.*").toDF(*like.columns)


def text_batches(df: DataFrame, most: int = 4 << 20) -> DataFrame:
    """df, for a map over Arrow batches: a worker holds a batch at a time, so its bytes are bounded, not its rows.

    The limit belongs to the session (Spark reads it when the query runs); a smaller one that is set already stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, str(1 << 30)).rstrip("b")) > most:
        conf.set(name, str(most))
    return df


def light(batches):
    """batches, as a task of a mapInArrow should read them: what Arrow frees goes back to the system, not to a pool."""
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    yield from batches
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from task to task and count in their executor's memory."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another libc
        pass


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only in local mode where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="postlake-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def written(df: DataFrame, free: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives lost executors.

    With free, the shuffle files of this write go when it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    try:
        if free:
            spark.conf.set(name, "true")
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(name, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing will read again. What a returned DataFrame still reads stays in the shared folder."""
    for t in tables:
        path = getattr(t, "written_path", None)
        if path:
            delete(t.sparkSession, path)


#: Bits held by one value of bitmap_construct_agg (fixed by Spark).
BITMAP_BITS = 32768


def slots_for(rows: int) -> int:
    """Slots of a bitmap for the keys that occur again among so many rows: 16 a key, 64 MB of bits at most."""
    return 1 << min(29, max(20, (8 * rows).bit_length()))


def maybe_in(rows: DataFrame, key: Column, keys: DataFrame, its_key: Column, flag: str, slots: int = 1 << 23) -> DataFrame:
    """rows with the boolean flag: false where key (a long) is surely not among its_key of keys.

    What is broadcast is a bitmap: at most slots / 32768 rows of 4 KB, however many keys. Where keys outnumber the
    slots more rows are flagged, and nothing else changes.
    """
    part = lambda c: F.floor(F.pmod(c, F.lit(slots)) / BITMAP_BITS).cast("int")
    bit = lambda c: F.pmod(F.pmod(c, F.lit(slots)), F.lit(BITMAP_BITS)).cast("int")
    bits = keys.select(part(its_key).alias("_part"), bit(its_key).alias("_bit")).groupBy("_part").agg(F.expr("bitmap_construct_agg(_bit)").alias("_bits"))
    rows = rows.withColumns({"_part": part(key), "_bit": bit(key)}).join(F.broadcast(bits), "_part", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, int(_bit / 8) + 1, 1)")), 16, 10).cast("int")
    return rows.withColumn(flag, F.coalesce(F.getbit(byte, F.expr("_bit % 8")) == 1, F.lit(False))).drop("_part", "_bit", "_bits")


def join_hot(rows: DataFrame, few: DataFrame, key: str, counts: DataFrame, total: int, spread: list[str], parts: int = 1000, least: int = 64) -> DataFrame:
    """rows joined with few, which has one row (or a few) a key, though one key may have a third of all rows.

    counts(key, _n) says how many rows each key of rows has and total their number. A key with more than one
    ``parts``-th of all rows is split by the columns of spread into pieces, and its rows of few are repeated once a
    piece. At most ``parts`` keys can be so large, so their names fit the driver whatever the input. A few thousand rows are
    no load for one task and are joined plainly.
    """
    limit = max(least, total // parts)
    hot = counts.filter(F.col("_n") > limit).select(key, "_n").collect() if total >= 4000 else []
    if not hot:
        return rows.join(few, key)
    pieces = min(parts, -(-max(r["_n"] for r in hot) // limit))
    large = F.col(key).isin([r[key] for r in hot])
    rows = rows.withColumn("_piece", F.when(large, F.pmod(F.xxhash64(F.lit(17), *spread), F.lit(pieces)).cast("int")).otherwise(0))
    few = few.withColumn("_piece", F.explode(F.when(large, F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0)))))
    return rows.join(few, [key, "_piece"]).drop("_piece")


def map_texts(df: DataFrame, make, fields: list[tuple[str, object]], most: int = 4 << 20) -> DataFrame:
    """df through a function of Arrow batches: make() gives it once a task; it returns columns for the (name, type) of fields.

    Batches are bounded by bytes, so a task holds about ``most`` bytes of text at a time, or one longer text.
    """
    schema = StructType()
    for name, kind in fields:
        schema.add(name, kind)
    names = schema.names

    def run(batches):
        import pyarrow as pa

        f = make()
        for batch in light(batches):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(f(*batch.columns), names=names)

    return text_batches(df, most).mapInArrow(run, schema)
