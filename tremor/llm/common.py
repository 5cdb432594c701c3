"""Shared folder, row keys and size-checked joins for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A side of a join is broadcast only when rows times row_bytes stay below this.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch on its way to Python.
ARROW_BYTES = "4m"

_NO_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a local session may go without that setting (tests): it then gets a folder of its own.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("tremor.test.checkpoint", None)
        if not root:
            root = tempfile.mkdtemp(prefix="spark-checkpoint-")
            spark.conf.set("tremor.test.checkpoint", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (underscores for dots) that hold inside the block only."""
    named = {k.replace("_", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def keep(df: DataFrame, name: str = "part") -> DataFrame:
    """Cut lineage: write the rows as Parquet into the shared folder and read them back.

    Shuffle files of the write are freed as soon as it ends, and Arrow batches that go to
    Python meanwhile are bounded by bytes; by rows alone, 10,000 long texts are one batch.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    with settings(
        spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true", spark_sql_execution_arrow_maxBytesPerBatch=ARROW_BYTES
    ):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that keep() wrote and nothing needs any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent().getParent()
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def pack_bytes(x: bytes) -> bytes:
    """Compressed bytes, for what travels in binary columns."""
    return zstandard.ZstdCompressor(level=1).compress(x)


def unpack_bytes(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names that begin like these and are none of the taken ones, in whatever case."""
    used, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def row_key() -> dict:
    """Columns k1 (doc_id, its null as the smallest long) and k2 (hash of the text)."""
    return {"k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "k2": F.xxhash64(F.col("text"))}


def with_row_key(docs: DataFrame) -> DataFrame:
    """Add k1 and k2.

    Rows with equal keys have equal ids and texts, so every operator gives them equal
    results; that makes repeated rows harmless and null ids joinable.
    """
    return docs.withColumns(row_key())


def with_fresh_key(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with the two key columns under names that docs does not have, and these names."""
    names = fresh(docs.columns, *row_key())
    return docs.withColumns(dict(zip(names, row_key().values(), strict=True))), names


def doc_id_of(k1="k1"):
    """The doc_id that with_row_key turned into k1."""
    return F.when(F.col(k1) != _NO_ID, F.col(k1))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str, row_bytes) -> DataFrame:
    """Join a wide table with a narrow one that was written by keep().

    The narrow side is broadcast while its measured size, row_bytes (a number or a column)
    summed over its rows, stays below BROADCAST_BYTES, which spares the texts a shuffle;
    beyond that both sides are shuffled.
    """
    size = small.agg(F.sum(row_bytes if not isinstance(row_bytes, int) else F.lit(row_bytes))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def numbered(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Add the rank (from 1) in the given order without bringing all rows to one task.

    Range partitions are written with their number; each counts its own rows, and one row
    for each partition carries the sum of those before it.
    """
    columns = df.columns
    part, before, many = fresh([*columns, name], "part", "before", "many")
    ranged = keep(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn(part, F.spark_partition_id()), "ranged")
    ahead = ranged.groupBy(part).agg(F.count("*").alias(many)).select(
        part, F.coalesce(F.sum(many).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before)
    )
    return (
        ranged.join(F.broadcast(ahead), part)  # a row for each partition
        .withColumn(name, F.row_number().over(W.partitionBy(part).orderBy(*order)) + F.col(before))
        .select(*columns, name)
    )
