"""Shards of nearly equal size by sampled splitters.

A document's key is the hash of its text, then its id: shards are mixtures of
all sources, and copies of a text are neighbours. Keys drawn by size give the
boundaries of ranges, overfull ranges are divided (see `ranges`), and the bytes
before each document say which shard it is in: shards are ranges of keys. A
group of copies that is larger than a shard is divided by its ids. Texts are
read where they are; what is shuffled is a key and a size. DataFrame functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ranges import Ranges, number, positions
from tidemark.llm.shared import Scratch, fresh_names, written

#: The law that holds: the shards' sizes are nearly equal.
LAW = "bytes"
KEY = ("text_hash", "doc_id", "size", "text_crc32")


def keyed(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """A document's key: text_hash (60 bits of the text's MD5), doc_id, size (bytes of the text and 1), text_crc32."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    text_hash = F.conv(F.substring(F.md5(body), 1, 15), 16, 10).cast("long")
    values = (text_hash, F.col(id_col), (F.octet_length(body) + 1).cast("long"), F.crc32(body))
    return [v.alias(n) for v, n in zip(values, KEY)]


def shards(docs: DataFrame, n: int = 8, rule: Ranges = Ranges(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, text_hash, law, shard (0 to n - 1) and slot (from 0, gapless in a shard) of every row.

    A document is in the shard that holds its middle byte when all are laid end
    to end in the order of keys, so a shard's size is off an nth of all by one
    document at most; where single documents are larger than a shard, some may
    have none. Null texts count as empty; rows without doc_id are the first of
    their text; repeated rows have a slot each, and may fall on both sides of a
    boundary. Other columns, of any name, are not read. An empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    placed = written(positions(docs.select(*keyed(id_col, text_col)), KEY, scratch, "size", rule), "shard-places")
    scratch.drop()
    total = placed.agg(F.max(F.col("weight_before") + F.col("size"))).first()[0] or 1
    # In decimals: bytes times shards may pass 64 bits.
    middle = (2 * F.col("weight_before") + F.col("size")).cast("decimal(38,0)") * n
    sharded = placed.withColumn("shard", F.least(F.floor(middle / (2 * total)), F.lit(n - 1)).cast("int"))
    firsts = sharded.groupBy("shard").agg(F.min("rows_before").alias("_first"))
    slot = (F.col("rows_before") - F.col("_first")).alias("slot")
    # A row for each shard, so the broadcast is as small as their number.
    return sharded.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "text_hash", F.lit(LAW).alias("law"), "shard", slot)


def write(
    docs: DataFrame, folder: str, n: int = 8, rule: Ranges = Ranges(), id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 128 << 20
) -> DataFrame:
    """Writes all columns of the documents to folder/shard=0 and so on; gives shard, documents and size of each.

    Texts move once: shards are ranges of keys, so a document finds its own by
    comparing its key with each shard's first one, and files are ranges of keys
    of about `file_bytes`. Repeated rows that fall on both sides of a boundary
    are kept together in the later shard. A column named shard is kept; the
    folders are then named after the first of _shard, _shard_ and so on that is
    free.
    """
    told = written(shards(docs, n, rule, id_col, text_col), "shards")
    size = told.agg(F.sum("size")).first()[0] or 0
    used = [r.shard for r in told.select("shard").distinct().orderBy("shard").collect()]
    names = dict(zip(KEY, fresh_names(docs, *KEY)))
    own = "shard" if "shard" not in (c.lower() for c in docs.columns) else fresh_names(docs, "shard")[0]
    rows = docs.select("*", *(c.alias(names[k]) for k, c in zip(KEY, keyed(id_col, text_col))))
    firsts = told.filter("slot = 0").filter(F.col("shard") > min(used, default=0))
    of, _ = number(rows, list(names.values()), firsts.select(F.struct(*(F.col(k).alias(v) for k, v in names.items())).alias("key")))
    # A shard without a document has no first key, so the place among the keys is not the shard's number.
    dealt = rows.withColumn(own, F.get(F.array(*(F.lit(k) for k in used or [0])), of))
    files = max(n, -(-size // file_bytes))
    placed = dealt.repartitionByRange(files, own, *names.values()).sortWithinPartitions(own, *names.values())
    placed.drop(*names.values()).write.partitionBy(own).parquet(folder)
    return told.groupBy("shard").agg(F.count("*").alias("documents"), F.sum("size").alias("size"))
