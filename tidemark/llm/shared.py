"""What several text operators use: the shared folder, keys and small rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import Scratch, new_path, written

__all__ = ["SPACE", "Scratch", "bitmap_place", "fold_remainder", "fresh_names", "hash_bitmap", "new_path", "small_batches", "small_or_shuffled", "table", "text_key", "written"]

#: A word is a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names like `names` that no column of `df` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name += "_"
        out.append(name)
    return out


def small_or_shuffled(table: DataFrame, most: int) -> DataFrame:
    """A written table, to be broadcast in a join if it has at most so many rows."""
    return F.broadcast(table) if table.count() <= most else table


def bitmap_place(hashed: Column, most: int) -> tuple[Column, Column]:
    """The word of a bitmap of at most `most` 64-bit words that stands for a hash, and the hash's bit in it."""
    words = 1 << (most.bit_length() - 1)
    bit = F.pmod(hashed, F.lit(64)).cast("int")
    return F.shiftrightunsigned(hashed, 6).bitwiseAND(F.lit(words - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def hash_bitmap(hashes: DataFrame, most: int) -> DataFrame:
    """word and bits of a bitmap of the column `hash`: bounded whatever the number of hashes, so it can be broadcast."""
    word, bit = bitmap_place(F.col("hash"), most)
    return hashes.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def text_key(text: Column) -> Column:
    """With doc_id, names a row up to repeats that are equal in both."""
    return F.xxhash64(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo `modulus`; 0 for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus), F.lit(0))


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bounds the Arrow batches of this session: texts are long, and each Python worker holds some batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
