"""The suffix tree in memory, for small ones: what the tables of `tidemark.llm.lm` are held against."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

END = b"\n"
#: Bytes of a text that are followed by one row of the automaton.
CHUNK = 256


@dataclass
class Tree:
    """The automaton: class of each byte; next state and log10 probability by state * width + class."""

    depth: int
    width: int
    classes: np.ndarray
    step: np.ndarray
    score: np.ndarray


def automaton(rows: pd.DataFrame, depth: int) -> Tree:
    """The automaton of kept contexts (depth, key, n); no rows: one uniform state.

    Its states are the contexts and all their parts, so that each is reached
    byte by byte; those that were not kept predict as their suffixes do.
    """
    level, key, n = (rows[c].to_numpy(np.int64) for c in ("depth", "key", "n"))
    symbols = np.unique(key & 255)
    classes = np.full(256, len(symbols), np.int64)
    classes[symbols] = np.arange(len(symbols))
    width = len(symbols) + 2  # the last but one is any other byte, the last is padding
    tail = lambda contexts, d: contexts & ((1 << 8 * (d - 1)) - 1)
    states = [np.unique(key[level == d] >> 8) for d in range(depth + 1)]
    states[0] = np.zeros(1, np.int64)
    for d in range(depth, 0, -1):
        states[d - 1] = np.unique(np.concatenate([states[d - 1], states[d] >> 8, tail(states[d], d)]))
    first = np.cumsum([0, *map(len, states)])
    step = np.zeros((first[-1], width), np.int32)
    prob = np.full((first[-1], width), 1 / 256, np.float32)
    for d, own in enumerate(states):
        here = slice(first[d], first[d + 1])
        if d:
            suffix = first[d - 1] + np.searchsorted(states[d - 1], tail(own, d))
            step[first[d - 1] + np.searchsorted(states[d - 1], own >> 8), classes[own & 255]] = np.arange(first[d], first[d + 1])
            step[here], prob[here] = step[suffix], prob[suffix]
        seen = level == d
        counts = np.zeros((len(own), width))
        counts[np.searchsorted(own, key[seen] >> 8), classes[key[seen] & 255]] = n[seen]
        kinds = (counts > 0).sum(1, keepdims=True)
        prob[here] = np.where(kinds > 0, (counts + kinds * prob[here]) / np.maximum(counts.sum(1, keepdims=True) + kinds, 1), prob[here])
    # Another byte leads to no context but the empty one; so does padding, which costs nothing.
    step[:, -2:] = 0
    np.log10(prob, out=prob)
    prob[:, -1] = 0
    return Tree(depth, width, classes, step.ravel(), prob.ravel())


def tree_scores(docs: list[list[bytes]], tree: Tree) -> np.ndarray:
    """log10 probability of each text's bytes and end."""
    lead = tree.depth
    parts = [END * lead + b" ".join(words) + END for words in docs]
    data = np.append(tree.classes[np.frombuffer(b"".join(parts), np.uint8)], tree.width - 1)
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(sizes) - sizes
    chunks = -(-(sizes - lead) // CHUNK)
    doc = np.repeat(np.arange(len(parts)), chunks)
    start = begins[doc] + CHUNK * (np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks))
    end = begins[doc] + sizes[doc]
    state = np.zeros(len(doc), np.int64)
    total = np.zeros(len(doc))
    for j in range(lead + CHUNK):
        at = start + j
        cell = state * tree.width + data[np.where(at < end, at, len(data) - 1)]
        if j >= lead:
            total += tree.score[cell]
        state = tree.step[cell].astype(np.int64)
    return np.bincount(doc, total, minlength=len(docs))
