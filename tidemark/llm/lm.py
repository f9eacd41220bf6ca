"""Language-model scores: a unigram base and a probabilistic suffix tree.

The tree is over the bytes of a text's lower-cased words, joined by spaces and
closed by an end mark. A context of up to `depth` bytes is kept if it occurs
`least_count` times in the training texts, however many those are, and its
next-byte counts diverge from its suffix's by more than `least_gain` nats, with
all suffixes of kept contexts. Distributions are smoothed towards the suffix's,
in proportion to the symbols seen (Witten-Bell), down to a uniform one, so every
byte has a probability. Texts are scored by the longest kept suffix.

The tree grows with the corpus, so it stays in tables. Texts are dealt into
chunks of bounded size (long ones in segments), compressed; each gives its distinct byte windows, once. Their sums
give the tree; then every window of the corpus gets its probability, from the
empty context up, and goes back to the chunks that have it. A window has a row
a chunk at most, so none is hot.

Words of which each is 1/frequent of the corpus are at most `frequent` and are
broadcast; the others' counts are joined by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch, fold_remainder, small_batches, written

END = b"\n"
#: Bytes of texts that are handled at once.
PIECE = 1 << 19
_GAP, _WORD = re.compile(rb"[ \t\n\x0b\x0c\r]"), re.compile(rb"[^ \t\n\x0b\x0c\r]")
#: Bytes and rows of texts whose windows are looked up together: a chunk ends with the piece that reaches either.
DEAL, DEAL_ROWS = 1 << 25, 1 << 20
WORD, GRAM = 0, 1
#: Words of fewer bytes are hashed as arrays.
SHORT = 64
#: Windows that are sorted together.
SORTED = 1 << 21


@dataclass(frozen=True)
class Rules:
    depth: int = 5
    #: A context that is kept occurs so often, and tells so much (nats) beyond its suffix.
    least_count: int = 32
    least_gain: float = 30.0
    frequent: int = 1_000_000
    folds: int = 7
    #: Bytes of texts that are handled at once; a longer text is cut between words.
    piece: int = PIECE
    held_out: int = 2


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


#: A number for each byte at each place of a word. A word's hash is their sum, so words hash alike by one chance in 2**64, as by `_hash`.
_TABLE = np.array([_hash(bytes((place, byte))) for place in range(SHORT) for byte in range(256)], np.uint64)


def _tokens(texts: list[bytes], opens: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """text and hash of all words of texts that have one space between words, and of an end for each that isn't open."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.flatnonzero(data == 32)
    begins = np.concatenate((ends[:1] * 0, ends[:-1] + 1))
    sizes = ends - begins
    # The space behind a word counts as its last byte.
    at = np.arange(len(data)) - np.repeat(begins, sizes + 1)
    np.minimum(at, SHORT - 1, out=at)
    hashes = np.add.reduceat(_TABLE[(at << 8) + data], begins)
    for i in np.flatnonzero(sizes >= SHORT):
        hashes[i] = _hash(data[begins[i] : ends[i]].tobytes())
    words, closed = sizes > 0, np.flatnonzero(~np.array(opens, bool))
    text = np.repeat(np.arange(len(texts)), [t.count(b" ") + 1 for t in texts])
    every = np.concatenate((hashes[words], np.full(len(closed), _hash(END), np.uint64)))
    return np.concatenate((text[words], closed)), every.view(np.int64)


def _segments(text: str | None, depth: int, size: int) -> Iterator[tuple[list[bytes], bytes, bool]]:
    """words, lead and open of the segments of a text: one, but for long texts.

    A segment begins with the `depth` bytes before it (END for the first), and
    an open one goes on: it ends with a space in place of END.
    """
    data = text.encode("utf-8", "surrogatepass") if text else b""
    at, lead = 0, END * depth
    while len(data) - at > size:
        gap = _GAP.search(data, at + size)
        more = _WORD.search(data, gap.end()) if gap else None
        if more is None:
            break
        words = data[at : more.start()].lower().split()
        if words:
            yield words, lead, True
            lead = (lead + b" ".join(words) + b" ")[-depth:]
        at = more.start()
    yield data[at:].lower().split(), lead, False


def _grams(docs: list[list[bytes]], depth: int, leads: list[bytes] | None = None, opens: list[bool] | None = None) -> np.ndarray:
    """Every byte of the texts with the `depth` before it, packed; the first byte is highest. Words may be given joined."""
    leads, opens = leads or [END * depth] * len(docs), opens or [False] * len(docs)
    parts = [lead + b" ".join(words) + (b" " if more else END) for words, lead, more in zip(docs, leads, opens)]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    packed = np.zeros(len(data) - depth, np.int64)
    for k in range(depth + 1):
        packed |= data[k : k + len(packed)] << (8 * (depth - k))
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes) - sizes
    cross = (begins[1:, None] - depth + np.arange(depth)[None, :]).ravel()
    return np.delete(packed, cross)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of n by key, of parts that are sorted by key: a stable sort merges them as runs."""
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


DEALT = (
    "chunk long, part long, places array<long>, ids array<string>, held array<boolean>, sizes array<long>, leads array<binary>, opens array<boolean>, raw long, data binary"
)
_DEALT = [x.split()[0] for x in DEALT.split(", ")]


def _deal(depth: int, piece: int = PIECE):
    """For mapInPandas over (doc_id, held_out, text): a row a piece, of its segments' words together.

    It names the piece's chunk, and for each segment its text by the task's
    number and its place there. A long text has several segments, and may be in
    several chunks.
    """

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        chunk, size, rows, place, own, held = task << 24, 0, 0, 0, [], 0

        def packed() -> pd.DataFrame:
            texts = [b" ".join(words) for _, _, _, words, _, _ in own]
            data = b"".join(texts)
            places, ids, out, _, leads, opens = (list(x) for x in zip(*own))
            row = (chunk, task, places, ids, out, [len(t) for t in texts], leads, opens, len(data), pa.compress(data, codec="zstd", asbytes=True))
            return pd.DataFrame([row], columns=_DEALT)

        for pdf in parts:
            for doc_id, out, text in zip(*(pdf[c] for c in ("doc_id", "held_out", "text"))):
                for words, lead, more in _segments(text, depth, piece):
                    own.append((place, doc_id, out, words, lead, more))
                    held += sum(map(len, words)) + len(words)
                    if held < piece and len(own) < piece:
                        continue
                    yield packed()
                    size, rows, own, held = size + held, rows + len(own), [], 0
                    if size >= DEAL or rows >= DEAL_ROWS:
                        chunk, size, rows = chunk + 1, 0, 0
                place += 1
        if own:
            yield packed()

    return dealt


def _dealt(piece) -> tuple[list[bytes], list[bytes], list[bool]]:
    """The words (joined by spaces), leads and opens of a piece's segments."""
    data, ends = pa.decompress(piece["data"], decompressed_size=piece["raw"], codec="zstd", asbytes=True), np.cumsum(piece["sizes"])
    return [data[end - n : end] for n, end in zip(piece["sizes"], ends)], list(piece["leads"]), list(piece["opens"])


def _count(depth: int):
    """For mapInPandas over pieces: kind, chunk, key and n of words and byte windows.

    n is of the training texts; a window of held-out ones alone has 0. Words
    are of training texts, and have no chunk.
    """

    def rows(kind: int, chunk: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
        for i in range(0, len(keys), 1 << 17):
            yield pd.DataFrame({"kind": kind, "chunk": chunk, "key": keys[i : i + (1 << 17)], "n": n[i : i + (1 << 17)]})

    def summed(kept: list[np.ndarray], weight: int) -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.unique(np.concatenate(kept), return_counts=True)
        return keys, n * weight

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: list[tuple[np.ndarray, np.ndarray]] = []
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        # Windows of training (weight 1) and of held-out texts that were not summed yet.
        raw: dict[int, list[np.ndarray]] = {1: [], 0: []}
        now, most, most_words = None, 1 << 20, 1 << 19

        def chunk() -> Iterator[pd.DataFrame]:
            own = grams + [summed(kept, weight) for weight, kept in raw.items() if kept]
            return rows(GRAM, now, *_merged(own)) if own else iter(())

        for pdf in parts:
            for piece in pdf.to_dict("records"):
                if piece["chunk"] != now:
                    yield from chunk()
                    grams, raw, most = [], {1: [], 0: []}, 1 << 20
                now = piece["chunk"]
                segments = list(zip(*_dealt(piece), piece["held"]))
                for weight, kept in raw.items():
                    own = [x for x in segments if bool(x[3]) != bool(weight)]
                    if not own:
                        continue
                    texts, leads, opens, _ = (list(x) for x in zip(*own))
                    kept.append(_grams([[t] for t in texts], depth, leads, opens))
                    if sum(map(len, kept)) >= SORTED:
                        grams.append(summed(kept, weight))
                        kept.clear()
                    if weight:
                        words.append(summed([_tokens(texts, opens)[1]], 1))
                if sum(len(k) for k, _ in grams) > most:
                    grams = [_merged(grams)]
                    most = max(1 << 20, 2 * len(grams[0][0]))
                if sum(len(k) for k, _ in words) > most_words:
                    words = [_merged(words)]
                    most_words = max(1 << 19, 2 * len(words[0][0]))
                    if len(words[0][0]) > 1 << 19:
                        yield from rows(WORD, -1, *words[0])
                        words, most_words = [], 1 << 19
        if words:
            yield from rows(WORD, -1, *_merged(words))
        yield from chunk()

    return counted


def _levels(grams: DataFrame, depth: int, scratch: Scratch) -> dict[int, DataFrame]:
    """key (context, next byte) and n of all windows of every length.

    Every level is a table of its own, so that no plan is large: the windows
    of one length are the sums of those that are longer by a byte in front.
    """
    levels = {depth: scratch.written(grams.groupBy("key").agg(F.sum("n").alias("n")), "grams")}
    for d in range(depth - 1, -1, -1):
        shorter = F.col("key").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("key")
        levels[d] = scratch.written(levels[d + 1].groupBy(shorter).agg(F.sum("n").alias("n")), "grams")
    return levels


def _kept(levels: dict[int, DataFrame], rules: Rules, scratch: Scratch) -> dict[int, DataFrame]:
    """ctx, total and kinds of the contexts kept and their suffixes, by length."""
    common, sums = {}, {}
    for d in range(rules.depth, -1, -1):
        own = levels[d].filter("n > 0").withColumn("ctx", F.shiftright("key", 8))
        sums[d] = own.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter(F.col("total") >= (rules.least_count if d else 1))
        common[d] = scratch.written(own.join(sums[d], "ctx"), "common")
    out, longer = {}, None
    for d in range(rules.depth, 0, -1):
        up = common[d - 1].select(F.col("key").alias("up_key"), F.col("n").alias("up_n"), F.col("total").alias("up_total"))
        pairs = common[d].join(up, F.col("key").bitwiseAND(F.lit((1 << 8 * d) - 1)) == F.col("up_key"))
        gain = F.sum(F.col("n") * F.log(F.col("n") * F.col("up_total") / (F.col("total") * F.col("up_n"))))
        kept = pairs.groupBy("ctx").agg(gain.alias("gain")).filter(F.col("gain") > rules.least_gain).select("ctx")
        if longer is not None:
            kept = kept.union(longer).distinct()
        kept = scratch.written(kept, "contexts")
        out[d] = common[d].join(kept, "ctx", "left_semi").select("ctx", "total", "kinds").distinct()
        longer = kept.select(F.col("ctx").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1)).alias("ctx")).distinct()
    out[0] = common[0].select("ctx", "total", "kinds").distinct()
    return out


def _probabilities(levels: dict[int, DataFrame], kept: dict[int, DataFrame], scratch: Scratch) -> DataFrame:
    """key and p of every window of full length, by its longest kept suffix.

    From the empty context up: where a context is kept, its counts are smoothed
    by the probability of the window that is shorter by a byte in front.
    """
    told = None
    for d in sorted(levels):
        own = levels[d].withColumn("ctx", F.shiftright("key", 8))
        if told is None:
            own = own.withColumn("up", F.lit(1 / 256))
        else:
            up = told.select(F.col("key").alias("up_key"), F.col("p").alias("up"))
            own = own.join(up, F.col("key").bitwiseAND(F.lit((1 << 8 * d) - 1)) == F.col("up_key"))
        mixed = (F.col("n") + F.col("kinds") * F.col("up")) / (F.col("total") + F.col("kinds"))
        # Only the last is read after the scratch tables are gone.
        put = written if d == max(levels) else scratch.written
        told = put(own.join(kept[d], "ctx", "left").select("key", F.coalesce(mixed, "up").alias("p")), "probabilities")
    return told


SCHEMA = pa.schema([
    ("place", pa.int64()), ("part", pa.int64()), ("doc_id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("hash", pa.int64()),
    ("cnt", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()),
])
ROWS = "place long, part long, doc_id string, held_out boolean, n_tokens long, hash long, cnt long, n_known long, logs double, score double"


def _score(handle, depth: int):
    """For cogrouped chunks of pieces and windows: a row a text, and one for each of its rarer words."""

    def looked_up(docs: list[bytes], leads: list[bytes], opens: list[bool], keys: np.ndarray, score: np.ndarray) -> np.ndarray:
        """log10 probability of each segment's bytes and end.

        Windows are sorted together with their segment, in the bits they leave
        free: each distinct one is looked up once, and in order.
        """
        free, out = 63 - 8 * (depth + 1), []
        for i in range(0, len(docs), 1 << free):
            own = docs[i : i + (1 << free)]
            doc = np.repeat(np.arange(len(own)), [len(t) + 1 for t in own])
            packed = (_grams([[t] for t in own], depth, leads[i : i + len(own)], opens[i : i + len(own)]) << free) | doc
            packed.sort()
            windows, doc = packed >> free, packed & ((1 << free) - 1)
            first = np.flatnonzero(np.concatenate(([True], windows[1:] != windows[:-1])))
            at = np.minimum(np.searchsorted(keys, windows[first]), max(0, len(keys) - 1))
            if not len(keys) or (keys[at] != windows[first]).any():
                raise ValueError("a chunk has windows that were not counted")
            out.append(np.bincount(doc, np.repeat(score[at], np.diff(first, append=len(windows))), len(own)))
        return np.concatenate(out)

    def scored(texts: pa.Table, windows: pa.Table) -> pa.Table:
        hashes, counts = handle.value
        keys, first = np.unique(windows["key"].to_numpy(), return_index=True)
        score = windows["score"].to_numpy()[first]
        del windows, first
        out = []
        for piece in texts.to_pylist():
            (docs, leads, opens), ids, held = _dealt(piece), piece["ids"], piece["held"]
            part, places = piece["part"], np.array(piece["places"], np.int64)
            doc, every = _tokens(docs, opens)
            sizes = np.bincount(doc, minlength=len(docs))
            own, which = np.unique(every, return_inverse=True)
            at = np.minimum(np.searchsorted(hashes, own), max(0, len(hashes) - 1))
            n = np.where(hashes[at] == own, counts[at], 0) if len(hashes) else np.zeros(len(own), np.int64)
            known = n[which] > 0
            pairs, times = np.unique(doc[~known] * len(own) + which[~known], return_counts=True)
            for cols in (
                (places, part, ids, held, sizes, own[0] ^ places, 0, np.bincount(doc, known, len(docs)), np.bincount(doc, np.log10(n + 1.0)[which], len(docs)), looked_up(docs, leads, opens, keys, score)),
                (places[pairs // len(own)], part, None, False, 0, own[pairs % len(own)], times, 0, 0.0, 0.0),
            ):
                full = [c if np.ndim(c) else np.full(len(cols[0]), c) for c in cols]
                out.append(pa.table([pa.array(c, f.type) for c, f in zip(full, SCHEMA)], SCHEMA))
        return pa.concat_tables(out) if out else SCHEMA.empty_table()

    return scored


def scores(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null texts are empty: an end mark alone. A row without doc_id is in the
    training part. Without training texts every byte has 1/256 and the base is
    that of an empty vocabulary. Repeated rows stay and count each time; other
    columns don't matter; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    out = fold_remainder(F.col(id_col), rules.folds) == rules.held_out
    if not 1 <= rules.depth <= 6:
        raise ValueError("a context and its next byte must fit in 56 bits")
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"))
    rows = written(rows.mapInPandas(_deal(rules.depth, rules.piece), DEALT), "chunks")
    counts = written(rows.mapInPandas(_count(rules.depth), "kind int, chunk long, key long, n long"), "counts")
    vocabulary = written(counts.filter(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n")), "vocabulary")
    v, n = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    common = F.col("n") >= F.lit(n / rules.frequent)
    top = vocabulary.filter(common).select("key", "n").orderBy("key").toPandas()
    grams = counts.filter(F.col("kind") == GRAM).select("chunk", "key", "n")
    scratch = Scratch(docs.sparkSession, "lm")
    levels = _levels(grams, rules.depth, scratch)
    told = _probabilities(levels, _kept(levels, rules, scratch), scratch)
    scratch.drop()
    windows = grams.select("chunk", "key").join(told, "key").select("chunk", "key", F.log10("p").cast("float").alias("score"))
    handle = docs.sparkSession.sparkContext.broadcast((top["key"].to_numpy(np.int64), top["n"].to_numpy(np.int64)))
    rarer = vocabulary.filter(~common).select(F.col("key").alias("hash"), F.col("n").alias("c"))
    # Windows are short rows: only the bytes of a batch bound it.
    small_batches(docs.sparkSession, rows=1 << 17)
    scored = rows.groupBy("chunk").cogroup(windows.groupBy("chunk")).applyInArrow(_score(handle, rules.depth), ROWS)
    joined = scored.join(rarer, "hash", "left")
    c = F.coalesce("c", F.lit(0))
    return (
        joined.groupBy("part", "place")
        .agg(
            F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_known") + F.when(c > 0, F.col("cnt")).otherwise(0)).alias("n_known"),
            F.sum(F.col("logs") + F.col("cnt") * F.log10(c + 1)).alias("logs"), F.sum("score").alias("score"),
        )
        .select(
            F.col("doc_id").cast(docs.schema[id_col].dataType), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
            (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score",
        )
    )
