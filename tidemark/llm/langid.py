"""Language identification of spans in mixed-language text.

Scores are naive Bayes on character trigrams: every letter counts, in the place
between its neighbours. A word's score for a language is the sum over its
letters. The scripts of its letters narrow the candidates to the languages that
use such a script in the training texts; then a Viterbi pass over the words of
a text, with a penalty for each switch, labels spans. The language with most
letters is the text's.

Training texts are a bounded sample of the labelled rows (`Rules.sample_rows`),
drawn for each language by a hash of their content, copies once; counts are summed by Spark into one row for
each (language, bin), so what the driver reads is bounded by the bins and the
languages. Numpy inside tasks; batches are cut into pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import fresh_names, small_batches, small_or_shuffled, written

UNKNOWN = "und"
BIN_BITS = 16
#: Code points whose letters are scored at once; those whose words are labelled at once.
LETTERS, PIECE = 1 << 18, 1 << 21

#: Languages are broadcast with their sizes up to so many.
MOST_BROADCAST = 10_000

#: Script numbers and the first and last code point of their main ranges.
SCRIPTS = (
    (1, 0x0041, 0x024F), (1, 0x1E00, 0x1EFF), (2, 0x0370, 0x03FF), (2, 0x1F00, 0x1FFF), (3, 0x0400, 0x052F), (4, 0x0530, 0x058F),
    (5, 0x0590, 0x05FF), (6, 0x0600, 0x077F), (6, 0x08A0, 0x08FF), (7, 0x0900, 0x097F), (8, 0x0980, 0x09FF), (9, 0x0E00, 0x0E7F),
    (10, 0x10A0, 0x10FF), (11, 0x1100, 0x11FF), (11, 0xAC00, 0xD7AF), (12, 0x3040, 0x30FF), (13, 0x3400, 0x9FFF), (13, 0x20000, 0x2FFFF),
)
N_SCRIPTS = 14


@dataclass
class Model:
    """Log probabilities by bin and language; the scripts each language uses."""

    languages: list[str]
    scores: np.ndarray
    uses: np.ndarray


@dataclass(frozen=True)
class Rules:
    #: Of each language about so many texts are learned, at most; of a smaller one, all.
    sample_rows: int = 5_000
    switch_penalty: float = 16.0
    #: A script counts as a language's if so large a share of its letters has it.
    least_script_share: float = 0.01
    smoothing: float = 0.5
    bits: int = field(default=BIN_BITS)


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter; its script (0: another)."""
    if not _TABLES:
        letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        scripts = np.zeros(0x110000, np.uint8)
        for script, first, last in SCRIPTS:
            scripts[first : last + 1] = script
        _TABLES.update(letters=letters, scripts=scripts)
    return _TABLES["letters"], _TABLES["scripts"]


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between zeros, and where each begins."""
    lengths = np.array([len(t) if t else 0 for t in texts], np.int64)
    joined = "\0" + "\0".join(t or "" for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, 1 + np.cumsum(lengths + 1) - (lengths + 1)


def _letters(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every letter in `texts`: place, bin, script; the code points, the texts' begins."""
    letter, script = _tables()
    points, begins = _points(texts)
    at = np.flatnonzero(letter[points])
    low = points.astype(np.uint64)
    upper = (points >= 65) & (points <= 90) | (points >= 0xC0) & (points <= 0xDE) | (points >= 0x391) & (points <= 0x3A9) | (points >= 0x410) & (points <= 0x42F)
    low[upper] += 32
    low[~letter[points]] = 32
    hashed = low[at - 1] * np.uint64(0x9E3779B97F4A7C15) + low[at] * np.uint64(0xC2B2AE3D27D4EB4F) + low[at + 1] * np.uint64(0x165667B19E3779F9)
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    return at, (hashed >> np.uint64(64 - bits)).astype(np.int64), script[points[at]], points, begins


def _pieces(texts, most: int = PIECE) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about `most` code points, and where they start."""
    start, size, own = 0, 0, []
    for i, t in enumerate(texts):
        own.append(t)
        size += len(t) if t else 0
        if size >= most:
            yield start, own
            start, size, own = i + 1, 0, []
    if own:
        yield start, own


def _count(bits: int):
    """For mapInPandas over (lang, text): letters by language and bin, and by script."""

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins: dict[str, np.ndarray] = {}
        for pdf in parts:
            for lang, group in pdf.groupby("lang"):
                total = bins.setdefault(lang, np.zeros((1 << bits) + N_SCRIPTS, np.int64))
                for _, texts in _pieces(group["text"], LETTERS):
                    _, where, script, _, _ = _letters(texts, bits)
                    total += np.bincount(np.concatenate([where, script.astype(np.int64) + (1 << bits)]), minlength=len(total))
        for lang, total in bins.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bin": at, "n": total[at]})

    return counted


def train(labelled: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages in `labelled`; rows without label or text teach nothing."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null")
    million = 1_000_000
    # One number for each language: what share of its different texts is learned. Their number is an estimate that is 2 % off by one deviation.
    bar = (F.lit(million * rules.sample_rows) / (0.9 * F.approx_count_distinct(F.xxhash64("text"), 0.02))).alias("_bar")
    sizes = small_or_shuffled(written(rows.filter("text is not null").groupBy(F.col("lang").alias("_lang")).agg(bar), "languages"), MOST_BROADCAST)
    drawn = rows.join(sizes, F.col("lang") == F.col("_lang")).filter(F.pmod(F.xxhash64("text", "lang"), F.lit(million)) < F.col("_bar"))
    once = drawn.groupBy("lang", F.xxhash64("text").alias("_hash")).agg(F.first("text").alias("text")).select("lang", "text")
    counts = once.mapInPandas(_count(rules.bits), "lang string, bin long, n long")
    found = counts.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(found["lang"]))
    size = 1 << rules.bits
    total = np.zeros((size + N_SCRIPTS, max(1, len(languages))))
    total[found["bin"], [languages.index(x) for x in found["lang"]]] = found["n"]
    own, scripts = total[:size] + rules.smoothing, total[size:]
    uses = scripts >= rules.least_script_share * np.maximum(scripts.sum(0), 1)
    return Model(languages, np.log(own / own.sum(0)).astype(np.float32), uses)


def _viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every row of `scores`; sequences start at `first` and run to the next.

    All sequences advance together, the longest first, so those that have
    ended are a suffix.
    """
    sizes = np.diff(np.append(first, len(scores)))
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = first[order], sizes[order]
    stay = np.empty(scores.shape, bool)
    source = np.empty(len(scores), np.int16)
    label = np.empty(len(scores), np.int16)
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    best = np.zeros((len(sizes), scores.shape[1]), np.float64)
    for t in range(sizes[0]):
        n = active[t]
        rows = begins[:n] + t
        if t:
            now = best[:n]
            top = now.argmax(1)
            bar = now[np.arange(n), top] - penalty
            source[rows] = top
            stay[rows] = now >= bar[:, None]
            np.maximum(now, bar[:, None], out=now)
        best[:n] += scores[rows]
    for t in range(sizes[0] - 1, -1, -1):
        n = active[t]
        more = active[t + 1] if t + 1 < sizes[0] else 0
        rows = begins[:n] + t
        ends = best[more:n].argmax(1)
        label[rows[more:]] = ends
        if more:
            after = rows[:more] + 1
            l = label[after]
            label[rows[:more]] = np.where(stay[after, l], l, source[after])
    return label


def _labels(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """What `_viterbi` gives, which runs only for sequences that may switch.

    A sequence stays in its best language g if no run of words gains more than
    the penalty by another one (each such run costs a switch at least), and if
    leaving g altogether gains no more than one penalty either.
    """
    label = np.empty(len(scores), np.int16)
    mixed = []
    for k, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(scores)])):
        own = scores[a:b]
        g = int(own.sum(0).argmax())
        gain = own - own[:, g : g + 1]
        sums = np.cumsum(gain, axis=0)
        lowest = np.minimum.accumulate(np.vstack([np.zeros((1, sums.shape[1])), sums[:-1]]), axis=0)
        gain[:, g] = -np.inf
        if (sums - lowest).max() < penalty and (sums.shape[1] == 1 or gain.max(1).sum() < penalty):
            label[a:b] = g
        else:
            mixed.append(k)
    if mixed:
        sizes = np.diff(np.append(first, len(scores)))[mixed]
        rows = np.repeat(first[mixed] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        label[rows] = _viterbi(scores[rows], np.cumsum(sizes) - sizes, penalty)
    return label


def _words(texts: list[str | None], model: Model) -> list[np.ndarray]:
    """Of every word: its text, start and end there, letters, and score for each language."""
    parts = []
    for skipped, own in _pieces(texts, LETTERS):
        at, where, script, _, begins = _letters(own, int(np.log2(len(model.scores))))
        if not len(at):
            continue
        word = np.flatnonzero(np.r_[True, np.diff(at) > 1])
        last = np.append(word[1:], len(at)) - 1
        scores = np.add.reduceat(model.scores[where], word, axis=0).astype(np.float64)
        allowed = model.uses[script[word]]
        # All scripts of a word count; most words have one.
        for k in np.flatnonzero(np.minimum.reduceat(script, word) != np.maximum.reduceat(script, word)).tolist():
            allowed[k] = model.uses[script[word[k] : last[k] + 1]].all(0)
        allowed[~allowed.any(1)] = True
        scores[~allowed] = -1e9
        text = np.searchsorted(begins, at[word], side="right") - 1
        parts.append((text + skipped, at[word] - begins[text], at[last] + 1 - begins[text], last - word + 1, scores))
    return [np.concatenate(x) for x in zip(*parts)]


def _spans(texts: list[str | None], model: Model, penalty: float) -> list[tuple[str, float, list[dict]]]:
    """(language, share of letters, spans) of every text."""
    out: list[tuple[str, float, list[dict]]] = [(UNKNOWN, 0.0, [])] * len(texts)
    words = _words(texts, model) if model.languages else []
    if not words:
        return out
    text, start, end, n_letters, scores = words
    new_text = np.r_[True, np.diff(text) > 0]
    label = _labels(scores, np.flatnonzero(new_text), penalty)
    letters = np.zeros((len(texts), len(model.languages)))
    np.add.at(letters, (text, label), n_letters)
    top, total = letters.argmax(1), letters.sum(1)
    heads = np.flatnonzero(new_text | np.r_[True, np.diff(label) != 0])
    tails = np.append(heads[1:], len(text)) - 1
    spans: list[list[dict]] = [[] for _ in texts]
    for t, a, e, own in zip(text[heads].tolist(), start[heads].tolist(), end[tails].tolist(), label[heads].tolist()):
        spans[t].append({"start": a, "end": e, "lang": model.languages[own]})
    for i in np.flatnonzero(total):
        out[i] = (model.languages[top[i]], float(letters[i, top[i]] / total[i]), spans[i])
    return out


FOUND = T.StructType([
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType()),
    ]))),
])


def labeller(spark, model: Model, penalty: float):
    """A function of a text column: lang_pred, score and spans."""
    small_batches(spark)
    handle = spark.sparkContext.broadcast(model)

    @F.pandas_udf(FOUND)
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for own in parts:
            found = [x for _, texts in _pieces(own) for x in _spans(texts, handle.value, penalty)]
            yield pd.DataFrame({name: pd.Series([x[k] for x in found], dtype=kind) for k, (name, kind) in enumerate((("lang_pred", object), ("score", float), ("spans", object)))})

    # Else a filter on the result would have it computed twice.
    return label.asNondeterministic()


def identify(docs: DataFrame, model: Model, rules: Rules = Rules(), text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred, score and spans of every row.

    lang_pred is the language with most letters, score the share of letters
    that have it, spans are runs of words of one language in code points.
    Null texts, texts without a letter, and every text if nothing was learned,
    have `und`, score 0 and no spans. Between languages of equal share the
    first in alphabetical order wins. Repeated rows stay, further columns don't
    matter, an empty table gives an empty result.
    """
    (found,) = fresh_names(docs, "found")
    label = labeller(docs.sparkSession, model, rules.switch_penalty)
    return docs.select(*keep, label(F.col(text_col)).alias(found)).select(*keep, f"{found}.*")


def judged(docs: DataFrame, model: Model, rules: Rules = Rules(), text_col: str = "text") -> tuple[DataFrame, str]:
    """All columns of `docs` and a struct (lang_pred, score, spans) under a name that no column has; that name."""
    (found,) = fresh_names(docs, "found")
    label = labeller(docs.sparkSession, model, rules.switch_penalty)
    return docs.select("*", label(F.col(text_col)).alias(found)), found
