import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import langid
from tidemark.llm.shared import fold_remainder

SCHEMA = "doc_id long, text string, lang string, score string, spans int"


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").withColumn("out", fold_remainder(F.col("doc_id"), 4) == 2)
    model = langid.train(docs.filter("not out"))
    got = langid.identify(docs.filter("out"), model, keep=("doc_id", "lang")).collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    assert all(0 < r.score <= 1 for r in got)


def test_edges_and_spans(spark):
    english, greek = "the quick brown fox is over the lazy dog and this is that ", "η γρήγορη αλεπού είναι πάνω από τον σκύλο "
    german = "der schnelle braune fuchs springt über den faulen hund und das ist gut "
    train = [(i, t and t * 3, lang, "x", 0) for i, (t, lang) in enumerate([(english, "en"), (greek, "el"), (german, "de"), (english, None), (None, "fr")])]
    model = langid.train(spark.createDataFrame(train, SCHEMA))
    assert model.languages == ["de", "el", "en"]
    rows = [(1, None), (2, ""), (3, "123 !? ٣"), (4, english), (5, greek), (6, english * 4 + german * 5), (None, german), (7, english * 2000), (4, english), (8, "漢字 кот"), (9, "\0the\0")]
    got = langid.identify(spark.createDataFrame([(i, t, None, "x", 0) for i, t in rows], SCHEMA), model).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by_id[1].score == 0 and by_id[1].spans == []
    assert [by_id[i].lang_pred for i in (4, 5, 6, None, 7)] == ["en", "el", "de", "de", "en"]
    mixed = by_id[6].spans
    assert [s.lang for s in mixed] == ["en", "de"] and abs(mixed[0].end - 4 * len(english)) <= 5 and mixed[1].end == 4 * len(english) + 5 * len(german) - 1
    assert by_id[8].lang_pred in model.languages
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "text", None, "x", 0)], SCHEMA), langid.train(empty)).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rnd = np.random.default_rng(5)
    sizes = [1, 4, 2, 6, 4]
    scores = rnd.normal(size=(sum(sizes), 3)) * 3
    first = np.cumsum([0, *sizes[:-1]])
    got = langid._viterbi(scores, first, 2.0)
    for a, n in zip(first, sizes):
        value = lambda path: sum(scores[a + i, l] for i, l in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))
        assert tuple(got[a : a + n]) == max(itertools.product(range(3), repeat=n), key=value)


def test_shortcut_gives_the_same_labels():
    import numpy as np

    rnd = np.random.default_rng(6)
    sizes = rnd.integers(1, 60, 300)
    first = np.cumsum(sizes) - sizes
    scores = rnd.normal(size=(sizes.sum(), 3)) * 2
    scores[:, 1] += np.repeat(rnd.choice([0.0, 1.0, 6.0], len(sizes)), sizes)
    assert (langid._labels(scores, first, 4.0) == langid._viterbi(scores, first, 4.0)).all()
    assert (langid._labels(scores[:, :1], first, 4.0) == 0).all()


M64 = (1 << 64) - 1


def brute_letters(text):
    """Place, bin and script of every letter, by plain integers."""
    low = lambda c: ord(c) + 32 if "A" <= c <= "Z" or "\u00c0" <= c <= "\u00de" or "\u0391" <= c <= "\u03a9" or "\u0410" <= c <= "\u042f" else ord(c)
    at = lambda i: low(text[i]) if 0 <= i < len(text) and text[i].isalpha() else 32
    for i, c in enumerate(text):
        if c.isalpha():
            h = at(i - 1) * 0x9E3779B97F4A7C15 + at(i) * 0xC2B2AE3D27D4EB4F + at(i + 1) * 0x165667B19E3779F9 & M64
            h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & M64
            yield i, h >> 48, next((s for s, a, b in langid.SCRIPTS if a <= ord(c) <= b), 0)


def brute_model(rows):
    bins, scripts = {}, {}
    for text, lang in set(rows):  # copies count once
        if text is not None and lang is not None:
            own = list(brute_letters(text))
            bins.setdefault(lang, Counter()).update(b for _, b, _ in own)
            scripts.setdefault(lang, Counter()).update(s for _, _, s in own)
    # A language without any letter is not learned.
    bins = {g: c for g, c in bins.items() if c}
    total = {g: sum(c.values()) + 0.5 * 65536 for g, c in bins.items()}
    score = lambda g, b: math.log((bins[g][b] + 0.5) / total[g])
    uses = lambda g, s: scripts[g][s] >= 0.01 * max(1, sum(scripts[g].values()))
    return sorted(bins), score, uses


def brute_label(text, model, penalty=16.0):
    """(language, share): words by runs of letters, scores narrowed by scripts, the best path with switches by plain dynamic programming."""
    languages, score, uses = model
    words, last = [], None
    for i, b, s in brute_letters(text or ""):
        if last is None or i > last + 1:
            words.append([])
        words[-1].append((b, s))
        last = i
    if not words or not languages:
        return "und", 0.0
    best, back = None, []
    for w in words:
        fits = [g for g in languages if all(uses(g, s) for _, s in w)] or languages
        own = {g: sum(score(g, b) for b, _ in w) if g in fits else -1e9 for g in languages}
        if best is None:
            best = own
        else:
            top = max(languages, key=lambda g: best[g])
            back.append({g: g if best[g] >= best[top] - penalty else top for g in languages})
            best = {g: max(best[g], best[top] - penalty) + own[g] for g in languages}
    label = [max(languages, key=lambda g: best[g])]
    for step in reversed(back):
        label.append(step[label[-1]])
    letters = Counter()
    for w, g in zip(words, reversed(label)):
        letters[g] += len(w)
    g = max(languages, key=lambda g: letters[g])
    return g, letters[g] / sum(letters.values())


def test_whole_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    texts = ["the quick brown fox", "Ein Satz und dann una frase de otra lengua que sigue mucho más larga todavía", "кот the кот", "a漢b 漢字", "", None, "1 2 3", "x" * 5000, "une phrase " * 4000]
    extra = [i for i in range(50_000, 50_400) if held(i)][: len(texts)]
    rows += [(i, t, None) for i, t in zip(extra, texts)] + [(None, "null id teaches", "en"), (60_000, "кошка и собака", "ru"), (60_001, "кошка и собака", "ru")]
    model = brute_model([(t, g) for i, t, g in rows if not held(i)])
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA).withColumn("held_out", F.coalesce(fold_remainder(F.col("doc_id"), 4) == 2, F.lit(False)))
    assert frame.filter("held_out").count() == sum(held(i) for i, _, _ in rows)
    got = langid.identify(frame, langid.train(frame.filter("not held_out")), keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, share = brute_label(r.text, model)
        assert (r.lang_pred, round(r.score, 9)) == (lang, round(share, 9)), r.text and r.text[:80]


def test_ties_of_shares_and_small_languages(spark):
    a, b = "abab " * 40, "xyxy " * 40
    many = [(i, f"{a} {'abc'[i % 3]} {i}", "aa", "x", 0) for i in range(300)] + [(1000, b, "bb", "x", 0)] + [(2000 + i, a, "aa", "x", 0) for i in range(500)]
    model = langid.train(spark.createDataFrame(many, SCHEMA), langid.Rules(sample_rows=50))
    assert model.languages == ["aa", "bb"]  # a language of one text among hundreds is learned
    got = langid.identify(spark.createDataFrame([(1, (a + b).strip(), None, "x", 0), (2, (b + a).strip(), None, "x", 0)], SCHEMA), model).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("aa", 0.5)}


def test_copies_do_not_lose_a_language(spark):
    """A few texts in very many copies: what is drawn are different texts, and there are few of them, so all are learned."""
    copies = spark.range(200_000).selectExpr("concat('wort zahl ', cast(id % 5 as string), ' und mehr davon') as text", "'aa' as lang")
    others = spark.range(300).selectExpr("concat('word number ', cast(id as string), ' and more of it') as text", "'bb' as lang")
    assert langid.train(copies.unionByName(others)).languages == ["aa", "bb"]
