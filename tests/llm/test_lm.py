import math
import zlib
from collections import Counter, defaultdict

import automaton
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import lm
from tidemark.sources.tables import Scratch

SCHEMA = "doc_id long, text string, score string, n int"


def brute_tree(train, rules):
    """Contexts by plain dictionaries; returns a function of (history, byte)."""
    counts = defaultdict(Counter)
    for text in train:
        data = b"\n" * rules.depth + b" ".join(lm.words_of(text)) + b"\n"
        for i in range(rules.depth, len(data)):
            for d in range(rules.depth + 1):
                counts[data[i - d : i]][data[i]] += 1
    kept = {b""}
    for c, own in counts.items():
        n, up = sum(own.values()), counts[c[1:]]
        if c and n >= rules.least_count and sum(k * math.log(k / n / (up[b] / sum(up.values()))) for b, k in own.items()) > rules.least_gain:
            kept |= {c[d:] for d in range(len(c))}

    def prob(c, b):
        up = prob(c[1:], b) if c else 1 / 256
        own = counts.get(c)
        return (own[b] + len(own) * up) / (sum(own.values()) + len(own)) if own else up

    def score(text):
        data = b"\n" * rules.depth + b" ".join(lm.words_of(text)) + b"\n"
        out = 0.0
        for i in range(rules.depth, len(data)):
            c = next(data[i - d : i] for d in range(rules.depth, -1, -1) if data[i - d : i] in kept)
            out += math.log10(prob(c, data[i]))
        return out

    return score, len(kept)


def check(spark, docs, rules):
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 7
    train = [t for i, t in docs if fold(i) != 2]
    words = Counter(w for t in train for w in (*lm.words_of(t), b"\n"))
    n, v = sum(words.values()), len(words)
    score, kept = brute_tree(train, rules)
    got = lm.scores(spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA), rules).collect()
    want = []
    for i, t in docs:
        own = [*lm.words_of(t), b"\n"]
        want.append((str(i), fold(i) == 2, len(own), sum(words[w] > 0 for w in own), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own), score(t)))
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-5, abs=1e-4)
    return kept


def test_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(1, None), (2, ""), (None, "No ID here"), (5, "É ümlaut 漢字 \x7f"), (5, "twice"), (5, "twice"), (9, "the " * 3000)]
    assert check(spark, docs, lm.Rules(depth=3, least_count=40, least_gain=5.0, frequent=50)) > 50
    check(spark, docs[:12], lm.Rules(depth=2, least_count=2, least_gain=1.0, frequent=10**6))


def test_nothing_learned(spark):
    assert lm.scores(spark.createDataFrame([], SCHEMA)).count() == 0
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    got = lm.scores(spark.createDataFrame([(i, "ab", "x", 1) for i in ids], SCHEMA)).collect()
    assert [(r.train_tokens, r.n_known, r.base_score) for r in got] == [(0, 0, 0.0)] * 2
    assert got[0].score == pytest.approx(-3 * math.log10(256), rel=1e-6)


def test_probabilities_sum_to_one(spark, sf_dir):
    import numpy as np
    import pandas as pd

    data = np.frombuffer(b"\n\nthe cat and the hat and that\n" * 30, np.uint8).astype(np.int64)
    packed = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    keys, n = np.unique(packed, return_counts=True)
    rows = [(2, k, c) for k, c in zip(keys, n)] + [(d, k, c) for d in (1, 0) for k, c in Counter((packed & ((1 << 8 * (d + 1)) - 1)).tolist()).items()]
    tree = automaton.automaton(pd.DataFrame(rows, columns=["depth", "key", "n"]), 2)
    prob = 10.0 ** tree.score.reshape(-1, tree.width)
    others = 256 - (tree.width - 2)
    assert np.allclose(prob[:, :-2].sum(1) + others * prob[:, -2], 1, atol=1e-5)


def test_small_sources_are_learned_in_large_corpora(spark):
    import random

    dice = random.Random(7)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    new = next(i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2)
    small = "abcdefghijklmnopqrstuvwxyz"
    filler = ["".join(dice.choices("0123456789 ", k=100_000)) for _ in range(60)]
    docs = [(i, t, "clash", 1) for i, t in zip(ids, filler + [small] * 34)] + [(new, small, "clash", 1)]
    got = {r.doc_id: r.score for r in lm.scores(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert len(got) == 95 and got[new] > -10  # of which the first letter costs 5; without contexts every letter does


def test_tables_and_automaton_agree(spark, sf_dir):
    import numpy as np
    import pandas as pd

    rules = lm.Rules(depth=3, least_count=4, least_gain=5.0)
    texts = [(r.text or "")[:2000] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).collect()]
    docs = [lm.words_of(t) for t in texts]
    keys, n = np.unique(lm._grams(docs, 3), return_counts=True)
    scratch = Scratch(spark, "test")
    levels = lm._levels(spark.createDataFrame(pd.DataFrame({"key": keys, "n": n})), 3, scratch)
    kept = lm._kept(levels, rules, scratch)
    told = {r.key: r.p for r in lm._probabilities(levels, kept, scratch).collect()}
    rows = []
    for d in kept:
        contexts = {r.ctx for r in kept[d].collect()}
        rows += [(d, r.key, r.n) for r in levels[d].collect() if r.key >> 8 in contexts]
    tree = automaton.automaton(pd.DataFrame(rows, columns=["depth", "key", "n"]), 3)
    want = [sum(math.log10(told[k]) for k in lm._grams([d], 3).tolist()) for d in docs]
    assert automaton.tree_scores(docs, tree) == pytest.approx(want, rel=1e-5, abs=1e-4)


def test_places_of_late_partitions():
    """Chunks of the 800,000th partition: places are told by chunk and number, which need no room in common."""
    from types import SimpleNamespace

    docs, chunk = [[b"a", b"b"], [b"c"]], 800_000 << 24
    data = b"a bc"
    packed = [pa.compress(data, codec="zstd", asbytes=True)]
    piece = {"chunk": [chunk], "part": [800_000], "places": [[5, 6]], "ids": [["1", "2"]], "held": [[False, True]], "sizes": [[3, 1]], "leads": [[b"\n\n"] * 2], "opens": [[False] * 2]}
    piece |= {"raw": [4], "data": packed}
    keys = np.unique(lm._grams(docs, 2))
    handle = SimpleNamespace(value=(np.array([], np.int64), np.array([], np.int64)))
    out = lm._score(handle, 2)(pa.table(piece), pa.table({"key": keys, "score": np.zeros(len(keys))}))
    assert set(zip(out["part"].to_pylist(), out["place"].to_pylist())) == {(800_000, 5), (800_000, 6)}


def test_segments_of_long_texts(spark):
    """A text that is cut gives what it gives whole: tokens, base and score, also where it is learned from."""
    texts = ["", " ", "a", "a b c", "x" * 90 + " y", "one two  three " * 30 + "   ", "É é " * 50, "\n a" * 60, None]
    for depth, size in ((2, 1), (2, 10), (5, 40), (5, 1000)):
        for text in texts:
            parts = list(lm._segments(text, depth, size))
            assert [w for words, _, _ in parts for w in words] == lm.words_of(text) and [more for _, _, more in parts] == [True] * (len(parts) - 1) + [False]
            cut = lm._grams([w for w, _, _ in parts], depth, [x for _, x, _ in parts], [m for _, _, m in parts])
            assert cut.tolist() == lm._grams([lm.words_of(text)], depth).tolist()
    frame = spark.createDataFrame([(i, t, "s", 0) for i, t in enumerate(texts * 4)], SCHEMA)
    whole, small = (sorted(map(tuple, lm.scores(frame, lm.Rules(least_count=2, least_gain=0.5, piece=piece)).collect())) for piece in (1 << 19, 60))
    assert [r[:5] for r in whole] == [r[:5] for r in small]
    assert [r[5:] for r in whole] == [pytest.approx(r[5:]) for r in small]


def test_tokens_of_texts():
    """Words of any length, beside empty texts, are told by their hash; an end is a token of each text that isn't open."""
    words = [b"a", b"b", b"ab", b"ba", b"aa", b"\x00", b"\x00\x00", *(b"x" * n for n in (62, 63, 64, 65, 300)), b"x" * 299 + b"y", "É漢".encode().lower()]
    texts = [b"", b" ".join(words), b"", b"b a b", b"x" * 64, b""]
    opens = [False, True, False, False, True, False]
    text, hashes = lm._tokens(texts, opens)
    want = [(i, w) for i, (t, more) in enumerate(zip(texts, opens)) for w in (*t.split(), *([] if more else [b"\n"]))]
    one = {w: int(lm._tokens([w], [True])[1][0]) for w in words} | {b"\n": int(lm._tokens([b""], [False])[1][0])}
    assert len(set(one.values())) == len(words) + 1
    assert sorted(zip(text.tolist(), hashes.tolist())) == sorted((i, one[w]) for i, w in want)


def _piece(texts):
    data = b"".join(texts)
    piece = {"chunk": 3, "part": 0, "places": [*range(len(texts))], "ids": [str(i) for i in range(len(texts))], "held": [i % 3 == 2 for i in range(len(texts))]}
    piece |= {"sizes": [len(t) for t in texts], "leads": [b"\n" * 5] * len(texts), "opens": [False] * len(texts), "raw": len(data)}
    return piece | {"data": pa.compress(data, codec="zstd", asbytes=True)}


def test_no_call_a_word(monkeypatch):
    """Counting and scoring handle words as arrays: only those of 64 bytes and more are hashed one by one."""
    from types import SimpleNamespace

    import pandas as pd

    texts = [b" ".join(b"w%d" % (i * j % 997) for j in range(2000)) for i in range(1, 12)] + [b"z" * 70, b""]
    calls, plain = [], lm._hash
    monkeypatch.setattr(lm, "_hash", lambda word: calls.append(word) or plain(word))
    got = pd.concat(lm._count(5)(iter([pd.DataFrame([_piece(texts)])])))
    train = Counter(w for i, t in enumerate(texts) if i % 3 != 2 for w in (*t.split(), b"\n"))
    assert sorted(got.n[got.kind == lm.WORD]) == sorted(train.values())
    grams = got[got.kind == lm.GRAM]
    keys = grams.key.to_numpy()
    every = Counter(k for t in texts for k in lm._grams([[t]], 5).tolist())
    learned = Counter(k for i, t in enumerate(texts) if i % 3 != 2 for k in lm._grams([[t]], 5).tolist())
    assert dict(zip(keys.tolist(), grams.n)) == {k: learned[k] for k in every}
    handle = SimpleNamespace(value=(np.array([], np.int64), np.array([], np.int64)))
    score = (keys % 7).astype(float)
    windows = pa.table({"key": keys[::-1].copy(), "score": score[::-1].copy()})
    out = lm._score(handle, 5)(pa.Table.from_pylist([_piece(texts)]), windows).to_pandas()
    own = out[out.n_tokens > 0].sort_values("place")
    assert own.n_tokens.tolist() == [len(t.split()) + 1 for t in texts]
    assert own.score.tolist() == [sum(k % 7 for k in lm._grams([[t]], 5).tolist()) for t in texts]
    assert out.groupby("place").cnt.sum().tolist() == [len(t.split()) + 1 for t in texts]
    assert set(calls) <= {b"z" * 70, b"\n"}
    with pytest.raises(ValueError, match="not counted"):
        lm._score(handle, 5)(pa.Table.from_pylist([_piece(texts)]), windows.slice(1))


def test_more_texts_than_bits():
    """At depth 6 a window leaves room for 128 segments: more of them are looked up in turns."""
    from types import SimpleNamespace

    texts = [b"t%d" % i for i in range(300)]
    piece = _piece(texts) | {"leads": [b"\n" * 6] * len(texts)}
    keys = np.unique(lm._grams([[t] for t in texts], 6))
    handle = SimpleNamespace(value=(np.array([], np.int64), np.array([], np.int64)))
    out = lm._score(handle, 6)(pa.Table.from_pylist([piece]), pa.table({"key": keys, "score": (keys % 5).astype(float)})).to_pandas()
    own = out[out.n_tokens > 0].sort_values("place")
    assert own.score.tolist() == [sum(k % 5 for k in lm._grams([[t]], 6).tolist()) for t in texts]
