"""Near-duplicate classes by SimHash fingerprints and ball hashing.

A fingerprint has 64 bits, one for each bit position of the hashes of a text's
3-word shingles: set if it is set in over half of them. Two texts link when
their fingerprints differ in at most three bits; a class is what links reach.

Links are found by meeting in the middle: a fingerprint emits the variants
within half the radius, and fingerprints that emit a common variant are
candidates. The radius is odd, so half of it is not whole; two facts about odd
radii keep the balls small.

* Screening (every distinct fingerprint): if three bits differ at most, one of
  four 16-bit blocks can be deleted so that at most two bits differ in the
  other 48. Balls of radius one around the four shortened fingerprints then
  meet: 4 x 49 variants. A fingerprint whose variants nobody shares has no link.
* Linking (only what is left): balls on whole fingerprints. Each emits its 64
  one-bit variants; those of odd parity also emit themselves and their two-bit
  variants within one half (of three bits, two lie in one half). At a variant,
  all that are within one bit of it ("near") are within three bits of all that
  meet there, so one edge to the smallest near one keeps every link's class
  without listing the pairs. Each edge's distance is verified.

Classes come from alternating large-star and small-star steps on the edges,
each written to the shared folder. Nothing but two counters reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.shared import Scratch, fresh_names, small_batches, small_or_shuffled, text_key, written

RADIUS = 3
SHINGLE = 3
SEED = 42
BLOCKS, BLOCK_BITS = 4, 16
#: Shingles whose bits are counted at once.
COUNTED = 1 << 17
#: Characters of a text that is counted in slices of as many bytes.
LONG = 1 << 20
_GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: Rows that go (an id and a hash each) are broadcast up to so many, else joined by a shuffle.
MOST_BROADCAST = 1_000_000


def _hashes(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """Hashes of a text's shingles; a shorter text is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) < shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    digest = xxhash.xxh64_intdigest
    return [digest(x, SEED) for x in map(b" ".join, zip(*(words[k:] for k in range(shingle))))]


def _majority(hashes: list[int], sizes: list[int]) -> np.ndarray:
    """A fingerprint for each run of `sizes` hashes; 0 for an empty run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        n = np.array(sizes, np.int64)[full]
        ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _long_majority(text: str, shingle: int, size: int) -> np.ndarray:
    """The fingerprint of one text, whose bits are counted in slices between words; a slice begins with the words that its first shingles need."""
    data, at, before, ones, n = text.encode("utf-8", "surrogatepass"), 0, [], np.zeros(64, np.int64), 0
    while at < len(data):
        gap = _GAP.search(data, min(at + size, len(data)))
        stop = gap.end() if gap else len(data)
        words = before + data[at:stop].lower().split()
        if len(words) >= shingle:
            own = np.array([xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*(words[k:] for k in range(shingle))))], np.uint64)
            ones += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(own)
        before, at = words[max(0, len(words) - shingle + 1) :], stop
    if not n:
        return _majority(_hashes(text, shingle), [len(_hashes(text, shingle))])
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def fingerprints_of(texts, shingle: int = SHINGLE, long: int = LONG) -> np.ndarray:
    """Fingerprints of texts as signed 64-bit numbers; memory is bounded within a long text, too."""
    done, hashes, sizes = [], [], []
    for text in texts:
        if text and len(text) > long:
            done += [_majority(hashes, sizes), _long_majority(text, shingle, long)]
            hashes, sizes = [], []
            continue
        own = _hashes(text, shingle)
        hashes += own
        sizes.append(len(own))
        if len(hashes) >= COUNTED:
            done.append(_majority(hashes, sizes))
            hashes, sizes = [], []
    done.append(_majority(hashes, sizes))
    return np.concatenate(done).view(np.int64)


@F.pandas_udf(T.LongType())
def _fingerprint(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series(fingerprints_of(texts))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the text) and fp (long) of every row; null and blank texts have fp 0."""
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("key"), _fingerprint.asNondeterministic()(text).alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _longs(values) -> F.Column:
    return F.expr("array(" + ",".join(f"{_signed(v)}L" if _signed(v) > -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")")


def screening_keys(fp: F.Column) -> F.Column:
    """The 4 x 49 variants of a fingerprint with one block deleted."""
    kept = 64 - BLOCK_BITS
    masks = _longs([0] + [1 << i for i in range(kept)])

    def around(rest: F.Column) -> F.Column:
        return F.transform(masks, lambda m: m.bitwiseXOR(rest))

    out = []
    for k in range(BLOCKS):
        low = fp.bitwiseAND(F.lit((1 << BLOCK_BITS * k) - 1))
        high = F.shiftleft(F.shiftrightunsigned(fp, BLOCK_BITS * (k + 1)), BLOCK_BITS * k) if k < BLOCKS - 1 else F.lit(0).cast("long")
        out.append(around(low.bitwiseOR(high).bitwiseOR(F.lit(k << kept))))
    return F.concat(*out)


def with_company(fps: DataFrame) -> DataFrame:
    """Of distinct fingerprints (fp), those that share a screening variant."""
    at = Window.partitionBy("key").orderBy("fp")
    # Each row becomes 196: few bytes, much work, so tasks must not be merged by size.
    spark = fps.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return (
        fps.repartition(tasks).select("fp", F.explode(screening_keys(F.col("fp"))).alias("key"))
        .select("fp", F.lag("fp").over(at).alias("before"), F.lead("fp").over(at).alias("after"))
        .filter("before is not null or after is not null")
        .select("fp")
        .distinct()
    )


def links(fps: DataFrame) -> DataFrame:
    """Verified edges (a, b), a > b, that join what links join."""
    one = [1 << i for i in range(64)]
    two = [1 << i | 1 << j for half in (0, 32) for i in range(half, half + 32) for j in range(half, i)]
    fp = F.col("fp")
    near = F.transform(_longs(one), lambda m: F.struct(m.bitwiseXOR(fp).alias("key"), F.lit(True).alias("near")))
    far = F.transform(_longs(two), lambda m: F.struct(m.bitwiseXOR(fp).alias("key"), F.lit(False).alias("near")))
    own = F.array(F.struct(fp.alias("key"), F.lit(True).alias("near")))
    odd = F.bit_count(fp) % 2 == 1
    met = fps.select("fp", F.explode(F.when(odd, F.concat(near, own, far)).otherwise(near)).alias("x")).select("fp", "x.*")
    to = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("key"))
    return (
        met.select("fp", to.alias("to"))
        .filter("to is not null and to <> fp")
        .select(F.greatest("fp", "to").alias("a"), F.least("fp", "to").alias("b"))
        .distinct()
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b; a > b) but the roots, as a table.

    A root is the smallest node of its component. Joins are on a node's
    minimum, which has one row a node, so a hub's edges can be split.
    """
    scratch = Scratch(edges.sparkSession, "stars")
    now = scratch.written(edges.select("a", "b"), "edges")
    state = None
    while True:
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if seen == state:
            out = written(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "components")
            scratch.drop()
            return out
        state = seen
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = scratch.written(moved.union(small.select("a", "m")).distinct(), "edges")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tables: doc_id, key and fp of every row; fp and root (the smallest fingerprint of the class) of every distinct fingerprint."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = rows.select("fp").distinct()
    scratch = Scratch(docs.sparkSession, "company")
    company = scratch.written(with_company(fps), "company")
    roots = components(links(company)).withColumnRenamed("node", "fp")
    scratch.drop()
    return rows, written(fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest doc_id that links reach, the row's own
    included. Null and blank texts have the zero fingerprint and link like any
    other; rows without doc_id belong to classes but never name them (null if
    a class has no doc_id); repeated rows stay; ids of any type, other columns
    don't matter. An empty table gives an empty result.

    A class is named by way of its fingerprints, each of which has one row, and
    every join has a table on both sides, so that Spark can split a hot one.
    """
    rows, roots = classes(docs, id_col, text_col)
    least = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp"), "least")
    named = written(least.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    by_fp = written(least.join(named, "root").select("fp", "component_id"), "by_fingerprint")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for every class, with all its columns: the one with the smallest doc_id.

    Rows without doc_id come last; of equal doc_ids the smaller text hash
    comes first, and of rows equal in both the one with the smallest hash of
    all columns stays. Null and blank texts are one class; ids and columns of
    any type and name; an empty table stays empty.

    Only ids and hashes are shuffled: texts stay where they are, but for rows
    that are repeated.
    """
    rows, roots = classes(docs, id_col, text_col)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    pairs = written(rows.groupBy("doc_id", "key", "fp").agg(F.count("*").alias("n")), "pairs")
    first = pairs.join(roots, "fp").groupBy("root").agg(F.min(rank).alias("x")).select(F.col("x.doc_id").alias("f_doc_id"), F.col("x.key").alias("f_key"))
    doc, key = fresh_names(docs, "doc", "key")
    named = lambda table: table.select(F.col("doc_id").alias(doc), F.col("key").alias(key))
    gone = pairs.join(first, F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("key") == F.col("f_key")), "left_anti")
    here = F.col(id_col).eqNullSafe(F.col(doc)) & (text_key(F.col(text_col)) == F.col(key))
    kept = docs.join(small_or_shuffled(written(named(gone), "gone"), MOST_BROADCAST), here, "left_anti")
    again = written(named(pairs.filter("n > 1")), "again")
    if again.isEmpty():
        return kept
    again = small_or_shuffled(again, MOST_BROADCAST)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = kept.join(again, here, "left_semi").groupBy(F.col(id_col), text_key(F.col(text_col))).agg(F.min_by(whole, F.xxhash64(whole)).alias("row"))
    return kept.join(again, here, "left_anti").union(one.select("row.*"))
