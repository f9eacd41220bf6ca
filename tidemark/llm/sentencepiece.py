"""SentencePiece encoding and decoding by batched Viterbi.

The pieces and scores come from a model file, read once on the driver and sent
to the tasks (a vocabulary is of fixed size). A text is written with a space in
front and `▁` for spaces and cut into words before each run of `▁`; pieces that
would cross such a cut are not used if the vocabulary has none, else the text
is one word. Each distinct word is segmented once for each piece of input:
words of equal length advance together, the hashes of all their substrings are
looked up among the sorted hashes of the pieces (and the characters compared),
and vectorised maxima keep the best score and its backpointer. Of equal scores
the longer last piece wins. Characters that no piece covers become bytes.

The segmentation is that of a unigram model: the one of best total score. A file
of merge ranks (BPE) has no probabilities, so a piece of rank r gets -log(1 + r)
(Zipf's law); mostly, but not always, this gives what merging in order gives.

Decoding is exact: a `▁` in the text itself is encoded as bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import small_batches

#: The public vocabulary's place; give another path for another model.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a `▁` of the text while words are cut: no character of any text.
OWN_MARK = "\ud800"
#: A character without piece costs this more than the worst piece.
UNKNOWN_COST = 10.0
#: Code points that are segmented at once; distinct words, and code points of them, that are remembered.
PIECE, REMEMBERED, REMEMBERED_POINTS = 1 << 20, 1 << 18, 1 << 22
BEFORE_SPACES = re.compile("(?<! ) ")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_FILTER_BITS = 20


@dataclass
class Vocabulary:
    """Pieces sorted by hash: hash, code points, id, score; bytes of every id; ids of the 256 bytes."""

    hashes: np.ndarray
    lengths: np.ndarray
    points: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    maybe: np.ndarray
    texts: list[bytes]
    byte_ids: np.ndarray
    unknown: float
    cuts: bool


def _hash_rows(points: np.ndarray) -> np.ndarray:
    """Polynomial hash of each row's prefix of each length (n, length + 1)."""
    out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(points.shape[1]):
            out[:, j + 1] = out[:, j] * _BASE + points[:, j].astype(np.uint64) + np.uint64(1)
    return out


def vocabulary(pieces: list[tuple[str, float, str]]) -> Vocabulary:
    """From (piece, score, kind) by id; kind: normal, byte or other (control, unknown: never chosen)."""
    normal = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind == "normal" and p]
    longest = max((len(p) for p, _, _ in normal), default=1)
    points = np.zeros((len(normal), longest), np.uint32)
    lengths = np.array([len(p) for p, _, _ in normal], np.int64)
    for k, (p, _, _) in enumerate(normal):
        points[k, : len(p)] = [ord(c) for c in p]
    hashes = _hash_rows(points)[np.arange(len(normal)), lengths] if normal else np.zeros(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    byte_ids = np.full(256, -1, np.int64)
    texts = []
    for i, (p, _, kind) in enumerate(pieces):
        if kind == "byte":
            byte_ids[int(p[3:5], 16)] = i
            texts.append(bytes([int(p[3:5], 16)]))
        else:
            texts.append(p.replace(SPACE, " ").encode() if kind == "normal" else b"")
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    maybe = np.zeros(1 << _FILTER_BITS, bool)
    maybe[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    crossing = any(a != SPACE and b == SPACE for p, _, _ in normal for a, b in zip(p, p[1:]))
    scores = np.array([s for _, s, _ in normal], np.float64)
    return Vocabulary(
        hashes[order], lengths[order], points[order], np.array([i for _, _, i in normal], np.int64)[order], scores[order], maybe,
        texts, byte_ids, float(scores.min(initial=0.0)) - UNKNOWN_COST, not crossing,
    )


def zipf(pieces: list[tuple[str, float, str]]) -> list[tuple[str, float, str]]:
    """Log probabilities in place of merge ranks, if all scores are whole numbers of 0 or less."""
    if not all(s <= 0 and s == int(s) for _, s, kind in pieces if kind == "normal"):
        return pieces
    return [(p, -log(1 - s) if kind == "normal" else s, kind) for p, s, kind in pieces]


def load(path: str = MODEL_FILE) -> Vocabulary:
    """The vocabulary of a SentencePiece model file; its bytes are read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal"
    return vocabulary(zipf([(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]))


def _segment(points: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Of words of equal length (n, length): piece row and start of the best last piece at every end.

    Row -1 is a character without piece.
    """
    n, length = points.shape
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    row = np.full((n, length + 1), -1, np.int64)
    back = np.zeros((n, length + 1), np.int64)
    prefix = _hash_rows(points)
    powers = np.ones(v.points.shape[1] + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, len(powers)):
            powers[k] = powers[k - 1] * _BASE
        for end in range(1, length + 1):
            best[:, end] = best[:, end - 1] + v.unknown
            back[:, end] = end - 1
            for size in range(1, min(end, v.points.shape[1]) + 1):
                start = end - size
                hashed = prefix[:, end] - prefix[:, start] * powers[size]
                some = np.flatnonzero(v.maybe[(hashed >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
                at = np.minimum(np.searchsorted(v.hashes, hashed[some]), len(v.hashes) - 1)
                good = (v.hashes[at] == hashed[some]) & (v.lengths[at] == size)
                some, at = some[good], at[good]
                if len(some):
                    same = (v.points[at, :size] == points[some, start:end]).all(1)
                    some, at = some[same], at[same]
                    total = best[some, start] + v.scores[at]
                    # A character's own piece rules out its bytes; longer pieces win with equal scores.
                    better = total >= best[some, end] if size > 1 else np.ones(len(some), bool)
                    some, at, total = some[better], at[better], total[better]
                    best[some, end], row[some, end], back[some, end] = total, at, start
    return row, back


def _spelled(word: list[int], row: list[int], back: list[int], v: Vocabulary) -> list[int]:
    """Ids of one word some of whose characters have no piece and become bytes."""
    ids: list[int] = []
    end = len(word)
    while end:
        if row[end] >= 0:
            ids.append(int(v.ids[row[end]]))
        else:
            own = chr(word[end - 1])
            ids += v.byte_ids[list((SPACE if own == OWN_MARK else own).encode("utf-8", "surrogatepass"))][::-1].tolist()
        end = back[end]
    return ids[::-1]


def _by_length(words: list[str], v: Vocabulary) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Numbers of some words of one length, their sizes in ids, and their ids one after the other.

    All backpointers of words of one length are followed together.
    """
    numbers: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        numbers.setdefault(len(w), []).append(i)
    for length, every in numbers.items():
        step = max(1, PIECE // (8 * max(1, length)))
        for first in range(0, len(every) if length else 0, step):
            which = every[first : first + step]
            points = np.frombuffer("".join([words[i] for i in which]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(which), length)
            row, back = _segment(points, v)
            live, end = np.arange(len(which)), np.full(len(which), length)
            seen, rows = [], []
            while len(live):
                seen.append(live)
                rows.append(row[live, end])
                end = back[live, end]
                live, end = live[end > 0], end[end > 0]
            # From the last step to the first, so that a stable sort by word gives reading order.
            word, found = np.concatenate(seen[::-1]), np.concatenate(rows[::-1])
            odd = np.zeros(len(which), bool)
            odd[word[found < 0]] = True
            plain = ~odd[word]
            order = np.argsort(word[plain], kind="stable")
            yield [which[k] for k in np.flatnonzero(~odd).tolist()], np.bincount(word, minlength=len(which))[~odd], v.ids[found[plain][order]].astype(np.int32)
            if odd.any():
                own = [_spelled(points[k].tolist(), row[k].tolist(), back[k].tolist(), v) for k in np.flatnonzero(odd).tolist()]
                yield [which[k] for k in np.flatnonzero(odd).tolist()], np.array([len(x) for x in own]), np.array([i for x in own for i in x], np.int32)


class Memory:
    """Piece ids of words, one after the other in a buffer; a word's number tells where. Its size is bounded."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.points = 0

    def learn(self, words: Iterable[str], v: Vocabulary) -> None:
        """Segments the words that are new; if the memory would be too large, it forgets all others."""
        words = dict.fromkeys(words)
        new = [w for w in words if w not in self.number]
        points = sum(map(len, new))
        if self.number and (len(self.number) + len(new) > REMEMBERED or self.points + points > REMEMBERED_POINTS):
            self.clear()
            new = list(words)
        order, sizes, parts = [], [np.zeros(0, np.int64)], [self.ids]
        for which, own, ids in _by_length(new, v):
            order += which
            sizes.append(own)
            parts.append(ids)
        self.number |= {new[i]: n for n, i in enumerate(order, len(self.number))}
        self.sizes = np.concatenate([self.sizes, *sizes]).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.concatenate(parts)
        self.points += points

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of learned words, one after the other, and how many each word has."""
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[at]
        places = np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes)
        return self.ids[places + np.arange(len(places))], sizes


def segmented(words: list[str], v: Vocabulary) -> list[np.ndarray]:
    """Piece ids of every word."""
    memory = Memory()
    memory.learn(words, v)
    ids, sizes = memory.of(words)
    return np.split(ids, np.cumsum(sizes)[:-1]) if len(words) else []


def words_of(text: str, v: Vocabulary) -> Iterator[list[str]]:
    """The text's words, marks included, in runs of about PIECE code points; none for an empty text."""
    if not v.cuts:
        if text:
            yield [SPACE + text.replace(SPACE, OWN_MARK).replace(" ", SPACE)]
        return
    start = 0
    while start < len(text):
        # A run ends before the first of some spaces, so that marks stay with the word that they precede.
        cut = BEFORE_SPACES.search(text, start + PIECE) if len(text) - start > PIECE else None
        end = cut.start() if cut else len(text)
        whole = ("" if start else SPACE) + text[start:end].replace(SPACE, OWN_MARK).replace(" ", SPACE)
        out, lead = [], ""
        for part in whole.split(SPACE)[1:]:  # each stands after one mark
            lead += SPACE
            if part:
                out.append(lead + part)
                lead = ""
        yield out + [lead] if lead else out
        start = end


def encoded(texts: Iterable[str | None], v: Vocabulary, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after the other, and where each begins and the last ends; null texts have none.

    `memory` keeps words' ids between calls.
    """
    parts, counts, words, runs, size = [np.zeros(0, np.int32)], [], [], [], 0

    def flush() -> None:
        nonlocal words, runs, size
        if runs:
            memory.learn(words, v)
            ids, sizes = memory.of(words)
            parts.append(ids)
            first = np.cumsum([0, *(n for _, n in runs[:-1])])
            for (i, _), own in zip(runs, np.add.reduceat(sizes, first).tolist()):
                counts[i] += own
        words, runs, size = [], [], 0

    for i, text in enumerate(texts):
        counts.append(0)
        for own in words_of(text or "", v):
            words += own
            runs.append((i, len(own)))
            size += sum(map(len, own))
            if size >= PIECE:
                flush()
    flush()
    return np.concatenate(parts), np.cumsum([0, *counts])


def decoded(ids, v: Vocabulary) -> str | None:
    """The text of piece ids: bytes joined, and the space in front taken off."""
    if ids is None:
        return None
    texts = v.texts
    whole = b"".join([texts[i] for i in np.asarray(ids).tolist()])
    return whole.removeprefix(b" ").decode("utf-8", "surrogatepass")


def _listed(ids: np.ndarray, places: np.ndarray, none: list[bool]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(none, pa.bool_()))


def coder(spark, v: Vocabulary):
    """A function of a text column: ids (null for a null text), the SHA-256 of the decoded text, and whether that is the text.

    One function encodes, decodes and compares every text, so that a task has
    one Python worker and ids don't go to it and back.
    """
    small_batches(spark)
    handle = spark.sparkContext.broadcast(v)

    @F.arrow_udf("ids array<int>, decoded_sha256 string, exact boolean")
    def code(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = Memory()
        for own in parts:
            texts = own.to_pylist()
            ids, places = encoded(texts, handle.value, memory)
            hashes, exact = [], []
            for text, a, b in zip(texts, places[:-1].tolist(), places[1:].tolist()):
                back = None if text is None else decoded(ids[a:b], handle.value)
                hashes.append(None if back is None else hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                exact.append(back == text)
            columns = [_listed(ids, places, [t is None for t in texts]), pa.array(hashes, pa.string()), pa.array(exact, pa.bool_())]
            yield pa.StructArray.from_arrays(columns, ["ids", "decoded_sha256", "exact"])

    # Else each use of the result would have it computed again.
    return code.asNondeterministic()


def encoder(spark, v: Vocabulary):
    """A function of a text column: its piece ids."""
    small_batches(spark)
    handle = spark.sparkContext.broadcast(v)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = Memory()
        for own in parts:
            texts = own.to_pylist()
            yield _listed(*encoded(texts, handle.value, memory), [t is None for t in texts])

    return encode.asNondeterministic()


def decoder(spark, v: Vocabulary):
    """A function of a column of piece ids: its text."""
    small_batches(spark)
    handle = spark.sparkContext.broadcast(v)

    @F.pandas_udf(T.StringType())
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in parts:
            yield pd.Series([decoded(x, handle.value) for x in ids], dtype=object)

    return decode.asNondeterministic()


def encode(docs: DataFrame, v: Vocabulary, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and ids (array of int) of every row.

    A null text has null ids, an empty one none. Very long texts are cut into
    words by runs. Rows without doc_id, repeated rows and further columns are
    nothing special; an empty table gives an empty result.
    """
    return docs.select(*keep, encoder(docs.sparkSession, v)(F.col(text_col)).alias("ids"))


def coded(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded_sha256 (of the decoded text) and exact (is that the text?) of every row.

    A null text has null ids and a null hash, and is exact; the rest is as in
    `encode`. Every text is decoded again, whole.
    """
    return docs.select(F.col(id_col).alias("doc_id"), coder(docs.sparkSession, v)(F.col(text_col)).alias("_coded")).select("doc_id", "_coded.*")


def round_trip(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_sha256, decoded_sha256 and exact of every row: the digest of `coded`.

    n_ids is 0 and the hashes are null for a null text.
    """
    return coded(docs, v, id_col, text_col).select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "decoded_sha256", "exact"
    )
