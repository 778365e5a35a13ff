"""What the training-data operators share: words, folders that all executors see, Arrow batches of bounded size."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than these six; ``bytes.split()`` splits at exactly them.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch. A batch is the unit that Python holds, so this bounds memory where texts are long; short rows still come by the thousand.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless they are bounded closer already. The number of rows in a batch stays as it was set."""
    set_ = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < set_ <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and the session local (as in tests), one of this session's own."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = tempfile.mkdtemp(prefix="latticework-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/latticework/{uuid.uuid4().hex}-{name}"


def stored(df: DataFrame, name: str, by: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written as a Parquet table in the shared folder and read again: its lineage is cut, and lost executors cost no recomputation.

    The shuffle files of the plan that made it go when the table is complete, as nothing reads them again.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    writer = df.write.partitionBy(by) if by else df.write
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that ``stored`` wrote, through Hadoop, whatever store it lies in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def bucket_crc(column: str, mod: int) -> Column:
    """crc32 of an id as text, modulo ``mod``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % F.lit(mod)


def crc_mod(value: object, mod: int) -> int:
    """The same in Python."""
    return zlib.crc32(("null" if value is None else str(value)).encode()) % mod


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def by_batch(f: Callable[[pa.RecordBatch], dict[str, object]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: ``f`` gives the output columns of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = f(batch)
                yield pa.RecordBatch.from_arrays([pa.array(made[x.name], x.type) if not isinstance(made[x.name], pa.Array) else made[x.name].cast(x.type) for x in schema], schema=schema)

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def code_points(text: bytes) -> int:
    """Code points of UTF-8 text."""
    return len(text.decode("utf-8", "replace"))


def quiet_tokenizers() -> None:
    """One thread a Python worker: Spark has a worker for each core already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def numbered(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """Adds column ``name``: 0, 1, 2, ... in the given order, without gathering rows in one task.

    Rows are dealt by range and sorted, the result is checkpointed (so that both uses below see the same partitions), and each partition
    gets the sum of the counts before it: one count for each partition reaches the driver.
    """
    spark = df.sparkSession
    parts = parts or shuffle_partitions(spark)
    dealt = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect())
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n
    starts = spark.createDataFrame([(k, v) for k, v in before.items()] or [(-1, 0)], "_part int, _before long")
    # monotonically_increasing_id counts from 0 in each partition in its low 33 bits; rows keep their sorted place
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + within).drop("_part", "_before", "_at")
