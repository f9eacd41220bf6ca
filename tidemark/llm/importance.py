"""Resampling documents towards a target by the importance of hashed features.

Features are runs of words, put into buckets by CRC-32. A bucket's gain is the
log of how much more frequent it is in the target than in the documents; a
document's weight is the mean gain of its features. Gumbel noise from a hash of
the id turns weights into scores, of which the highest are drawn: sampling
without replacement in proportion to the exponentials, the same on every run.

A CRC is linear: it is the XOR of what each byte contributes at its distance
from the end, and a constant of the length. So the CRCs of all features of many
texts are one look-up a byte and one `bitwise_xor.reduceat` over the spans;
spans longer than the table are folded block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ranges import Ranges, positions
from tidemark.llm.shared import Scratch, small_batches, written

#: Distances from the end that the table has: the longest span that needs no folding.
REACH = 256
_POLYNOMIAL, _ONES = 0xEDB88320, 0xFFFFFFFF
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Rules:
    #: Words of a feature: one or two.
    buckets: int = 10_000
    #: Documents with fewer words are not drawn; of the others so many per cent are.
    least_words: int = 20
    drawn_percent: int = 25
    seed: int = 7
    #: Bytes of texts that a task takes at a time.
    slice_bytes: int = 8 << 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte contributes at each distance from the end (REACH x 256), and the CRC of so many zero bytes (0 to REACH)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(_POLYNOMIAL), step >> 1)
    table = np.empty((REACH, 256), np.uint32)
    table[0] = step
    for d in range(1, REACH):
        table[d] = (table[d - 1] >> 8) ^ step[table[d - 1] & 255]
    zeros, state = np.empty(REACH + 1, np.uint32), np.uint32(_ONES)
    for n in range(REACH + 1):
        zeros[n] = state ^ np.uint32(_ONES)
        state = (state >> np.uint32(8)) ^ step[int(state) & 255]
    return table, zeros


def _summed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The XOR of values[start:end] for each span; spans are not empty and may lie anywhere."""
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[::2], bounds[1::2] = starts, ends
    return np.bitwise_xor.reduceat(np.append(values, np.uint32(0)), bounds)[::2]


def folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRCs of spans of any length: blocks of REACH bytes from the end, the first may be shorter; a state moves on by a block at a time."""
    table, zeros = _tables()
    blocks = -(-(ends - starts) // REACH)
    state = np.zeros(len(starts), np.uint32)
    for turn in range(int(blocks.max(initial=0))):
        own = (blocks > turn).nonzero()[0]
        stop = ends[own] - (blocks[own] - 1 - turn) * REACH
        start = np.maximum(starts[own], stop - REACH)
        size = stop - start
        at = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        bounds = np.cumsum(size)
        block = _summed(table[np.repeat(stop, size) - 1 - at, data[at]], bounds - size, bounds)
        if turn:
            old = state[own]
            moved = table[REACH - 1, old & 255] ^ table[REACH - 2, (old >> 8) & 255] ^ table[REACH - 3, (old >> 16) & 255] ^ table[REACH - 4, old >> 24]
        else:
            moved = zeros[size] ^ np.uint32(_ONES)
        state[own] = moved ^ block
    return state ^ np.uint32(_ONES)


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, paired: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of the words data[start:end], and of each word in `paired` with the byte after it and the word that follows.

    Words lie one byte apart. The second word of a pair contributes what it
    does alone; the first one's bytes are further from the end by its length.
    """
    table, zeros = _tables()
    if not len(starts):
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    sizes = ends - starts
    spot = np.arange(len(data))
    of = np.repeat(np.arange(len(starts)), sizes + 1)[: len(data)]
    alone = _summed(table[np.clip(ends[of] - 1 - spot, 0, REACH - 1), data], starts, ends)
    words = alone ^ zeros[np.minimum(sizes, REACH)]
    after = np.append(ends[1:], ends[-1])
    far = table[np.clip(after[of] - 1 - spot, 0, REACH - 1), data]
    whole = after[paired] - starts[paired]
    pairs = _summed(far, starts[paired], starts[paired + 1]) ^ alone[paired + 1] ^ zeros[np.minimum(whole, REACH)] if len(paired) else np.empty(0, np.uint32)
    long = (sizes > REACH).nonzero()[0]
    words[long] = folded(data, starts[long], ends[long])
    long = (whole > REACH).nonzero()[0]
    pairs[long] = folded(data, starts[paired[long]], after[paired[long]])
    return words, pairs


def _parts(text: bytes, size: int) -> Iterator[tuple[bytes, bool]]:
    """A text cut between words into parts of about `size` bytes; each but the first begins with the last word before it."""
    at, begin, again = 0, 0, False
    while len(text) - at > size:
        width, cut = size, at
        while cut <= at and at + width < len(text):
            gaps = (~_IS_WORD[np.frombuffer(text, np.uint8, width, at)]).nonzero()[0]
            cut, width = (at + int(gaps[-1]) if len(gaps) else at), 2 * width  # a word longer than a part stays whole
        if cut <= at:
            break
        yield text[begin:cut], again
        own = _IS_WORD[np.frombuffer(text, np.uint8, cut - begin, begin)]
        edge = np.diff(own, prepend=False, append=False).nonzero()[0]
        begin, again = (begin + int(edge[-2]), True) if len(edge) else (cut, False)
        at = cut
    yield text[begin:], again


def features(texts: list[tuple[int, bytes, bool]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, CRC) of the words and then of the pairs of words of (row, text, does its first word belong to the part before) triples."""
    data = np.frombuffer(b" ".join(t for _, t, _ in texts), np.uint8)
    own = _IS_WORD[data]
    edge = np.diff(own, prepend=False, append=False).nonzero()[0]
    sizes = edge[1::2] - edge[::2]
    if not len(sizes):
        return
    begins = np.cumsum([0] + [len(t) + 1 for _, t, _ in texts[:-1]])
    part = np.searchsorted(begins, edge[::2], "right") - 1
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    packed = np.full(int(ends[-1]), 32, np.uint8)
    packed[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = _LOWER[data[own]]
    paired = (part[1:] == part[:-1]).nonzero()[0]
    words, pairs = crcs(packed, starts, ends, paired)
    row = np.array([r for r, _, _ in texts], np.int64)[part]
    again = np.array([a for _, _, a in texts], bool)[part] & np.diff(part, prepend=-1).astype(bool)
    yield row[~again], words[~again]
    yield row[paired], pairs


def _of_batch(texts: pa.Array, rule: Rules) -> Iterator[list[tuple[int, bytes, bool]]]:
    """The texts of a batch in slices of bounded size."""
    held, size = [], 0
    for row, text in enumerate(texts):
        if (body := text.as_buffer()) is None:
            continue
        for part, again in _parts(body.to_pybytes(), rule.slice_bytes):
            held.append((row, part, again))
            size += len(part)
            if size >= rule.slice_bytes:
                yield held
                held, size = [], 0
    if held:
        yield held


def bucket_counts(docs: DataFrame, rule: Rules, text_col: str = "text") -> np.ndarray:
    """How many features of all texts each bucket has: a number for each bucket is all that leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(rule.buckets, np.int64)
        for batch in batches:
            for texts in _of_batch(batch.column(0), rule):
                for _, crc in features(texts):
                    counts += np.bincount(crc % rule.buckets, minlength=rule.buckets)
        some = counts.nonzero()[0]
        yield pa.record_batch({"bucket": some, "n": counts[some]})

    got = docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(rule.buckets, np.int64)
    counts[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return counts


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: the log of its share of the target over its share of the documents, with one more in each bucket."""
    n, d, t = len(documents), int(documents.sum()), int(target.sum())
    return np.array([floor(1000 * log((float(b) + 1) * (d + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(documents, target)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, rule: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, sums = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for texts in _of_batch(batch.column(1), rule):
                for k, (row, crc) in enumerate(features(texts)):
                    found = np.bincount(row, minlength=batch.num_rows)
                    n += found
                    words += found if k == 0 else 0
                    sums += np.bincount(row, shared.value[crc % rule.buckets], batch.num_rows).astype(np.int64)
            yield pa.record_batch({"doc_id": batch.column(0), "n_words": words, "n_features": n, "weight": sums // np.maximum(n, 1)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of the id ('null' where it is missing)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, rule: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", ranges: Ranges = Ranges()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row; rank is null where a document is not drawn.

    Ties of scores go to smaller ids, a missing one first; rows that are equal
    in all have ranks of their own. Null texts have no words; texts are read
    whole. Other columns are not read. Either table may be empty; an empty
    target draws what is rare in the documents.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "importance")
    gain = gains(bucket_counts(docs, rule, text_col), bucket_counts(target, rule, text_col))
    scored = weighed(docs, gain, rule, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), rule.seed))
    rows = scratch.written(scored, "scored").withColumn("_turn", -F.col("score"))
    able = F.col("n_words") >= rule.least_words
    most = rows.filter(able).count() * rule.drawn_percent // 100
    order = ("_turn", "doc_id", "n_words", "n_features", "weight", "score")
    ranked = positions(rows.filter(able), order, scratch, rule=ranges)
    rank = F.when(F.col("rows_before") < most, F.col("rows_before") + 1)
    names = ("doc_id", "n_words", "n_features", "weight", "score")
    out = ranked.select(*names, rank.alias("rank")).unionByName(rows.filter(~able).select(*names, F.lit(None).cast("long").alias("rank")))
    out = written(out, "resampled")
    scratch.drop()
    return out


def drawn(docs: DataFrame, target: DataFrame, rule: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are drawn, with all their columns; rows that share an id are drawn together."""
    ids = resampled(docs, target, rule, id_col, text_col).filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn"))
    return docs.join(ids, docs[id_col].eqNullSafe(F.col("_drawn")), "left_semi")
