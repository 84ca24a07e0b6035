"""What the operators of this subpackage share: word columns, keys and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words, and the others, as Java character classes.
SPACE_CLASS = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Bits of a sieve at most: 16 MB.
SIEVE_BITS = 1 << 27
#: The folder that tables go to within `scratch`.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, local mode gets a temporary one; a cluster raises ValueError."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="llm_shared_")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column in `taken` bears; Spark does not tell names apart by case."""
    used, names = {c.lower() for c in taken}, []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        names.append(name)
    return names


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_SCRATCH.get() or _own_tables(spark)}/{name}_{uuid.uuid4().hex}"


def _own_tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes every table that operators of this application left in the shared folder: what their results are read from.

    Call it when the results are written; results that are still to be read are lost.
    """
    delete(spark, _own_tables(spark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written within go to a folder that is deleted at the end; gives a `materialize` for those that outlive it."""
    outer = _SCRATCH.get()
    folder = new_path(spark, "scratch")
    before = _SCRATCH.set(folder)
    try:
        yield lambda df, name: materialize(df, name, outer or _own_tables(spark))
    finally:
        _SCRATCH.reset(before)
        delete(spark, folder)


def materialize(df: DataFrame, name: str, folder: str | None = None, compression: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder, or in `folder`, and reads it back: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{folder}/{name}_{uuid.uuid4().hex}" if folder else new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder through Hadoop's file system, so that it works on any store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def words(text: Column) -> Column:
    """The words of a text: runs of anything but ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that together identify a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def sieve(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose `key`, a 64-bit hash, is not in `wanted`; none is lost whose key is there.

    Before a join with few of the rows, so that not all of them are shuffled.
    """
    (met,) = free_names(rows.columns, "met")
    return sifted(rows, key, wanted, met).filter(met).select(*[F.col(f"`{c}`") for c in rows.columns])


def sifted(rows: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
    """rows with the boolean `name`: false for most of those whose `key`, a 64-bit hash, is not in `wanted`, true for all others.

    One bit in eight or fewer of a bitmap that is broadcast, of SIEVE_BITS at most, is set; with more keys it only holds
    less back.
    """
    bits = min(SIEVE_BITS, 1 << max(15, (8 * wanted.count() - 1).bit_length()))
    place = F.pmod(F.col(key), F.lit(bits)) + 1
    number, payload = free_names([*rows.columns, name], "number", "payload")
    held = wanted.select(F.bitmap_bucket_number(place).alias(number), F.bitmap_bit_position(place).alias("at")).groupBy(number).agg(F.bitmap_construct_agg("at").alias(payload))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col(payload), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn(number, F.bitmap_bucket_number(place)).join(F.broadcast(held), number, "left")
    hit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(hit, F.lit(False)).alias(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
