"""URL filters: prefix rules on hosts, and an exact Bloom filter cascade for what no rule fits.

The cascade stores a list of keys relative to a complete universe of keys. Its
first level holds the listed keys; the second the other keys of the universe
that the first lets pass; the third the listed keys that the second lets pass,
and so on until nothing passes. The first level that doesn't hold a key tells
whether it is listed: for keys of the universe without error, and without a
join of the pages with the list.

Levels are built by Spark: tasks set bits, Spark merges them word by word. The
driver sees filters, never keys. Their size is checked before anything is sent:
beyond `Cascade.most_bytes` the list is joined instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import written

#: (rule, verdict): a host, a slash and a path; the rule fits the host and its subdomains.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host(url: Column) -> Column:
    """After the first :// up to a slash, question mark, number sign or the end; A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to a question mark, number sign or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = text.partition("/")
        fits = F.endswith(F.concat(F.lit("."), host), F.lit("." + name)) & F.startswith(path, F.lit("/" + start))
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


@dataclass
class Cascade:
    """Levels of (seed, hashes, bits); the list itself if the levels end before all is told apart."""

    levels: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def n_bytes(self) -> int:
        return sum(bits.nbytes for _, _, bits in self.levels)


def _places(one: np.ndarray, two: np.ndarray, seed: int, hashes: int, size: int) -> Iterator[np.ndarray]:
    """Bit places of keys by double hashing, mixed anew for each level."""
    with np.errstate(over="ignore"):
        a = (one.view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(31)
        b = (two.view(np.uint64) + np.uint64(seed * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)) * np.uint64(0x94D049BB133111EB)
        b = (b ^ b >> np.uint64(29)) | np.uint64(1)
        for k in range(hashes):
            x = (a + np.uint64(k) * b)
            yield (x >> np.uint64(11)) % np.uint64(size)


def _holds(level: tuple[int, int, np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    seed, hashes, bits = level
    out = np.ones(len(one), bool)
    for at in _places(one, two, seed, hashes, 64 * len(bits)):
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def listed(cascade: Cascade, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which keys (two hashes each) of the universe are in the list."""
    out = np.zeros(len(one), bool)
    left = np.arange(len(one))
    for k, level in enumerate(cascade.levels):
        holds = _holds(level, one[left], two[left])
        out[left[~holds]] = k % 2 == 1
        left = left[holds]
    out[left] = len(cascade.levels) % 2 == 1
    return out


def key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key, F.lit(1)).alias("one"), F.xxhash64(F.lit(2), key).alias("two")]


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> tuple[int, int, np.ndarray]:
    """A filter of `n` keys (one, two) that lets about `rate` of others pass."""
    size = 64 * ceil(max(1, n) * log(1 / rate) / log(2) ** 2 / 64)
    hashes = max(1, round(log(1 / rate) / log(2)))

    def set_bits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            at = np.unique(np.concatenate([*_places(pdf["one"].to_numpy(np.int64), pdf["two"].to_numpy(np.int64), seed, hashes, size)]))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(word):
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pd.DataFrame({"word": word.astype(np.int64), "bits": bits.view(np.int64)})

    merged = keys.select("one", "two").mapInPandas(set_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[merged["word"].to_numpy(np.int64)] = merged["bits"].to_numpy(np.int64).view(np.uint64)
    return seed, hashes, bits


def _passing(keys: DataFrame, level: tuple[int, int, np.ndarray]) -> DataFrame:
    handle = keys.sparkSession.sparkContext.broadcast(level)

    def passing(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf[_holds(handle.value, pdf["one"].to_numpy(np.int64), pdf["two"].to_numpy(np.int64))]

    return keys.mapInPandas(passing, "one long, two long")


def build(universe: DataFrame, most_bytes: int = 1 << 26) -> Cascade | None:
    """The cascade of `universe` (key, listed; a row a key), or None if it would be too large.

    Keys are told apart by two 64-bit hashes. The first level lets pass about
    as many others as make the whole smallest, the later ones half.
    """
    keys = written(universe.select(*key_hashes(F.col("key")), "listed"), "universe")
    inside, outside = (keys.filter(c).select("one", "two") for c in ("listed", "not listed"))
    n, others = inside.count(), outside.count()
    cascade = Cascade()
    if not n:
        cascade.levels.append((0, 1, np.zeros(1, np.uint64)))
        return cascade
    rate = min(0.5, sqrt(0.5) * n / max(1, others))
    if n * log(1 / rate) / log(2) ** 2 / 8 * 4 > most_bytes:
        return None
    held, held_n, rest = inside, n, outside
    while True:
        cascade.levels.append(_level(held, held_n, rate, len(cascade.levels) + 1))
        if cascade.n_bytes() > most_bytes:
            return None
        passed = written(_passing(rest, cascade.levels[-1]), "passed")
        passed_n = passed.count()
        if not passed_n:
            return cascade
        held, held_n, rest, rate = passed, passed_n, held, 0.5


def member(spark, cascade: Cascade):
    """A function of (one, two): is the key listed?"""
    handle = spark.sparkContext.broadcast(cascade)

    @F.pandas_udf(T.BooleanType())
    def told(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for one, two in parts:
            yield pd.Series(listed(handle.value, one.to_numpy(np.int64), two.to_numpy(np.int64)))

    return told


def judged(pages: DataFrame, listed_hosts: DataFrame, rules=RULES, most_bytes: int = 1 << 26) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    `listed_hosts` (host) are blocked where no rule fits. Null urls and urls
    without :// have an empty host and path; rows without page_id, repeated
    rows and repeated or unknown listed hosts are nothing special; other
    columns don't matter. Either table may be empty.
    """
    url = F.col("url")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"))
    rows = rows.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for text, what in rules:
        verdict = F.when(F.col("rule") == text, F.lit(what)).otherwise(verdict)
    marks = listed_hosts.select("host").distinct().withColumn("listed", F.lit(True))
    universe = rows.select("host").distinct().join(marks, "host", "left").select(F.col("host").alias("key"), F.coalesce("listed", F.lit(False)).alias("listed"))
    cascade = build(universe, most_bytes)
    if cascade is None:
        told = rows.join(marks, "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        told = rows.withColumn("listed", member(pages.sparkSession, cascade)(*key_hashes(F.col("host"))))
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return told.select("page_id", "host", "path", "rule", F.coalesce(verdict, method).alias("verdict"))


def blocked_hosts(pages: DataFrame, rules=RULES) -> DataFrame:
    """Hosts of whose pages that a rule fits more are blocked than allowed."""
    url = F.col("url")
    fits = pages.select(host(url).alias("host"), rule(host(url), path(url), rules).alias("rule")).filter("rule is not null")
    vote = F.lit(0)
    for text, what in rules:
        vote = F.when(F.col("rule") == text, F.lit(1 if what == "block" else -1)).otherwise(vote)
    return fits.groupBy("host").agg(F.sum(vote).alias("votes")).filter("votes > 0").select("host")
