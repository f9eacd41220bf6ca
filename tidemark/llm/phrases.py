"""Collocations by sampling: Toivonen's method on phrases of a few words.

A sample of the texts proposes phrases at a lowered support. One full pass then
counts the proposed phrases and their negative border (phrases whose own parts,
one word shorter, are all proposed) over all texts. Phrases of the border that
turn out frequent are failures of the sample: they are added, and a further
pass counts what the additions make possible. It takes every phrase that it
reaches as an addition itself, so it counts longer ones around it as well, and
the set is closed after it: the parts of a frequent phrase are frequent, hence
proposed, added, or reached. Without failures there is no such pass.

These passes count phrases by 64-bit hashes, so few bytes are shuffled; a hash
that two phrases share can only make both look more frequent. A last pass spells
the phrases that look frequent and counts each by its words, so the result is
that of a full count. Sets of phrases go to the tasks as bitmaps of hashes of
bounded size: a bit that is set by another phrase only makes a pass count more
than it must; it changes no count and hides no phrase.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import Scratch, hash_bitmap, small_batches, written

UNKNOWN = "und"
SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)], _KIND[list(BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LAST_WORD = re.compile(rb"[^ \t.,;:!?\n\x0b\x0c\r]+[ \t]*\Z")


@dataclass(frozen=True)
class Rules:
    #: Words of a phrase at most, and occurrences that make one frequent.
    longest: int = 4
    support: int = 30
    #: A phrase goes if a longer one around it has so many per cent of its count.
    subsumed_percent: int = 80
    top: int = 2000
    #: The sample's share of texts; it proposes at so much of a frequent phrase's expected count, twice at least.
    sample_share: float = 1 / 16
    lowered: float = 0.5
    #: Bytes of texts that a task counts at a time.
    slice_bytes: int = 3 << 20
    #: 64-bit words of a bitmap: 4 MB.
    bitmap_words: int = 1 << 19

    @property
    def proposed(self) -> int:
        return max(2, int(self.support * self.sample_share * self.lowered))


def _tail(part: bytes, words: int) -> tuple[bytes, int]:
    """The last so many words of a part, back to the last break; and their number."""
    at = len(part)
    for n in range(words):
        end = at
        while end and part[end - 1] in SPACES:
            end -= 1
        start = max(part.rfind(bytes((c,)), 0, end) for c in SPACES + BREAKS) + 1
        if start == end:
            return part[at:], n
        at = start
    return part[at:], words


def parts(text: bytes, size: int, words: int) -> Iterator[tuple[bytes, int]]:
    """A text cut between words into parts of about `size` bytes, each with the words before it that phrases may begin in, and their number."""
    at, before, n = 0, b"", 0
    while len(text) - at > size:
        cut = max(text.rfind(bytes((c,)), at, at + size) for c in SPACES + BREAKS) + 1
        if cut <= at:  # a word longer than a part stays whole
            found = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]").search(text, at + size)
            if found is None:
                break
            cut = found.end()
        part = before + text[at:cut]
        yield part, n
        before, n = _tail(part, words)
        at = cut
    yield before + text[at:], n


def _mixed(a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """One 64-bit hash of two, by multiplying and folding (all modulo 2^64); its last three bits are the length less one."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) & ~np.uint64(7) | np.uint64(length - 1)


def _has(bits: np.ndarray | None, hashed: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(hashed), bool)
    word = bits[(hashed >> np.uint64(6)) & np.uint64(len(bits) - 1)]
    return (word >> (hashed & np.uint64(63)) & np.uint64(1)).astype(bool)


def _coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's place among the different ones, and these."""
    got = pa.array(keys).dictionary_encode()
    return got.indices.to_numpy(zero_copy_only=False).astype(np.int64), got.dictionary.to_numpy(zero_copy_only=False)


def phrases_of(
    texts: list[tuple[str, bytes, int]], rules: Rules, known: np.ndarray | None = None, older: np.ndarray | None = None, spell: bool = False
) -> Iterator[tuple]:
    """languages, number of each phrase's language, phrases (None unless they are spelled), hashes and counts, of the phrases of each length in
    (language, text, words before) triples.

    A phrase is counted if its parts, one word shorter, have their bits in
    `known` (None: any), and was not reached by way of `older` alone: the pass
    before this one has those, and what it hasn't reached counts as known.
    Phrases of words before a text alone were counted with the part before.
    The last three bits of a hash are its length.
    """
    langs = sorted({x for x, _, _ in texts})
    place = {x: i for i, x in enumerate(langs)}
    data = np.frombuffer(b"\n".join(t for _, t, _ in texts), np.uint8)
    kind = _KIND[data]
    is_word = kind == 0
    edge = np.diff(is_word, prepend=False, append=False).nonzero()[0]
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return
    begins = np.cumsum([0] + [len(t) + 1 for _, t, _ in texts[:-1]])
    own = np.searchsorted(begins, starts, "right") - 1
    fresh = np.ones(len(starts), bool)
    for i, (_, _, before) in enumerate(texts):
        if before:
            at = np.searchsorted(starts, begins[i])
            fresh[at : at + before] = False
    joined = np.zeros(len(starts), bool)  # does a word go on the piece of the one before?
    joined[1:] = np.diff(np.cumsum(kind == 2, dtype=np.int32)[starts]) == 0
    sizes = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(sizes), pa.py_buffer(_LOWER[data[is_word]])).dictionary_encode()
    del data, kind, is_word, edge
    lang = np.array([place[x] for x, _, _ in texts], np.int64)[own]
    different = len(words.dictionary)
    one, pairs = _coded(lang * different + words.indices.to_numpy().astype(np.int64))
    of_lang, of_word = pairs // different, pairs % different
    by_word = np.array([xxhash.xxh64_intdigest(w.as_buffer(), 12) for w in words.dictionary], np.uint64)
    by_lang = np.array([xxhash.xxh64_intdigest(x, 12) for x in langs], np.uint64)
    unit = hashed = _mixed(by_lang[of_lang], by_word[of_word], 1)
    single = spelled = words.dictionary.take(pa.array(of_word)) if spell else None
    counts = np.bincount(one[fresh], minlength=len(pairs))
    yield langs, of_lang, spelled, hashed, counts if older is None else np.zeros_like(counts)
    ids, passes, was = one, _has(known, hashed), None if older is None else _has(older, hashed)
    for n in range(2, rules.longest + 1):
        # `ids` are those of the phrases of one word less, by their last word; -1 where there is none that counts.
        good = np.zeros(len(one), bool)
        good[1:] = joined[1:] & (ids[1:] >= 0) & (ids[:-1] >= 0)
        at = good.nonzero()[0]
        at = at[passes[ids[at]] & passes[ids[at - 1]]]
        if not len(at):
            return
        place_of, keys = _coded(ids[at - 1] * len(unit) + one[at])
        some = np.empty(len(keys), np.int64)
        some[place_of] = at
        prefix, last, suffix = ids[some - 1], one[some], ids[some]
        if spell:
            spelled = pc.binary_join_element_wise(spelled.take(pa.array(prefix)), single.take(pa.array(last)), " ")
        hashed = _mixed(hashed[prefix], unit[last], n)
        of_lang = of_lang[prefix]
        counts = np.bincount(place_of[fresh[at]], minlength=len(keys))
        if older is not None:
            # Was it reached before? Its bits alone don't tell: other phrases may have set them.
            reached = was[prefix] & was[suffix]
            counts = np.where(reached, 0, counts)
            was = reached & _has(older, hashed)
        yield langs, of_lang, spelled, hashed, counts
        passes = _has(known, hashed)
        if older is not None:
            passes |= ~reached
        ids = np.full(len(one), -1, np.int64)
        ids[at] = place_of


def _slices(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[list[tuple[str, bytes, int]]]:
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            if (body := text.as_buffer()) is None:
                continue
            for part, before in parts(body.to_pybytes(), rules.slice_bytes, rules.longest - 1):
                held.append((lang.as_py(), part, before))
                size += len(part)
                if size >= rules.slice_bytes:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text")).filter("text <> ''")


def summed(texts: DataFrame, rules: Rules, known: np.ndarray | None, older: np.ndarray | None, least: int) -> DataFrame:
    """hash and n of what one pass counts at least so often: what two phrases share counts for both."""
    spark = texts.sparkSession
    shared, before = spark.sparkContext.broadcast(known), spark.sparkContext.broadcast(older)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, rules):
            for _, _, _, hashed, counts in phrases_of(part, rules, shared.value, before.value):
                some = counts.nonzero()[0]
                yield pa.record_batch({"hash": hashed[some].view(np.int64), "n": counts[some]})

    found = texts.mapInArrow(run, "hash long, n long")
    return found.groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def sample(texts: DataFrame, rules: Rules) -> DataFrame:
    """Texts drawn by their hashes and places, so that copies are drawn one by one; what is drawn decides what the passes have to count, not what they find."""
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(7), "text", F.monotonically_increasing_id()), 11) / float(1 << 53)
    return texts.filter(unit < rules.sample_share)


def bitmap(hashes: DataFrame, rules: Rules, old: np.ndarray | None = None) -> np.ndarray:
    """The bits of `hashes`, and of an older bitmap: `bitmap_words` at most, whatever their number."""
    bits = np.zeros(rules.bitmap_words, np.uint64) if old is None else old.copy()
    got = hash_bitmap(hashes, rules.bitmap_words).toPandas()
    bits[got["word"].to_numpy()] |= got["bits"].to_numpy().view(np.uint64)
    return bits


def failures(often: DataFrame, rules: Rules, known: np.ndarray) -> DataFrame:
    """`hash` of the frequent ones that could be parts of longer phrases, and that `known` doesn't have."""
    shared = often.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = batch.column(0).to_numpy().view(np.uint64)
            new = ~_has(shared.value, hashed) & ((hashed & np.uint64(7)) < rules.longest - 1)
            yield pa.record_batch({"hash": hashed[new].view(np.int64)})

    return often.select("hash").mapInArrow(run, "hash long")


def spelled(texts: DataFrame, rules: Rules, often: np.ndarray) -> DataFrame:
    """lang, phrase and n of the phrases that are frequent, of those that have their bits; and '' with all words of each language."""
    shared = texts.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, rules):
            for level, (langs, of_lang, phrase, hashed, counts) in enumerate(phrases_of(part, rules, shared.value, spell=True)):
                names = pa.array(langs, pa.string())
                if level == 0:
                    totals = np.bincount(of_lang, counts, len(langs)).astype(np.int64)
                    yield pa.record_batch({"lang": names, "phrase": pa.array([""] * len(langs)), "n": totals})
                some = ((counts > 0) & _has(shared.value, hashed)).nonzero()[0]
                yield pa.record_batch({"lang": names.take(pa.array(of_lang[some])), "phrase": phrase.take(pa.array(some)), "n": counts[some]})

    sums = texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return sums.filter((F.col("n") >= rules.support) | (F.col("phrase") == ""))


def frequent(docs: DataFrame, rules: Rules, scratch: Scratch, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, phrase, words and n of all phrases that occur often enough in their language, and '' with all words.

    Exact whatever the sample proposes; it decides whether there is a further pass.
    """
    if not 1 <= rules.longest <= 8:
        raise ValueError("a phrase has 1 to 8 words")
    small_batches(docs.sparkSession)
    texts = _texts(docs, lang_col, text_col)
    known = bitmap(scratch.written(summed(sample(texts, rules), rules, None, None, rules.proposed), "proposals"), rules)
    counted = scratch.written(summed(texts, rules, known, None, rules.support), "counted")
    often = bitmap(counted, rules)
    failed = scratch.written(failures(counted, rules, known), "failures")
    if not failed.isEmpty():
        more = summed(texts, rules, bitmap(failed, rules, known), known, rules.support)
        often = bitmap(scratch.written(more, "counted"), rules, often)
    found = spelled(texts, rules, often)
    return found.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("words"), "n")


def mined(docs: DataFrame, rules: Rules = Rules(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases.

    A phrase's score is that of its worst cut in two: 2000000 a / (l + r),
    floored, in decimals, for products may pass 64 bits. Phrases that mostly
    occur inside a longer one go. Of phrases alike in score and count the first
    by name is better. Null texts and languages: empty, `und`. Texts are read
    whole; rows without doc_id, repeated rows and further columns are nothing
    special. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    known = scratch.written(frequent(docs, rules, scratch, lang_col, text_col), "frequent")
    several = known.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))

    word = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice(word, i, k), " "))))
    inside = several.filter("words > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    whole = 100 * F.coalesce(F.col("longer"), F.lit(0)).cast("decimal(38,0)") >= rules.subsumed_percent * F.col("a").cast("decimal(38,0)")
    kept = several.join(inside, ["lang", "phrase"], "left").filter(~whole).drop("longer")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    halves = cuts.withColumn("left", F.array_join(F.slice(word, 1, F.col("k")), " ")).withColumn("right", F.array_join(F.slice(word, F.col("k") + 1, F.col("words")), " "))
    of = lambda side, n: known.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    both = halves.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    scored = both.withColumn("score", F.expr("cast(2000000 * cast(a as decimal(30,0)) as decimal(38,0)) div (l + r)"))
    worst = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*best))
    # Among the best of the language are the best of each of its parts, so no task sees a whole language.
    some = worst.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", rank("lang", "part")).filter(F.col("rank") <= rules.top).drop("part", "rank")
    ranked = some.withColumn("rank", rank("lang")).filter(F.col("rank") <= rules.top)
    total = known.filter("words = 0").select("lang", "n")
    out = ranked.join(F.broadcast(total) if total.count() <= 1_000_000 else total, "lang")
    out = written(out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrases")
    scratch.drop()
    return out
