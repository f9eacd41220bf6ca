import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from tidemark.llm import phrases, queries
from tidemark.llm.shared import Scratch

SCHEMA = "doc_id long, text string, lang string, phrase string, n int"


def grams(text, longest=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split("[.,;:!?\n-\r]", lowered):
        words = [w for w in re.split("[ \t]+", piece) if w]
        for n in range(1, longest + 1):
            yield from (tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(docs, rule):
    count = defaultdict(Counter)
    for lang, text in docs:
        count[lang or "und"].update(grams(text, rule.longest))
    out = []
    for lang, f in count.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: c for p, c in f.items() if c >= rule.support}
        inside = {q for p, c in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * c >= rule.subsumed_percent * f[q := p[i : i + k]]}
        rows = []
        for p, a in often.items():
            if len(p) > 1 and p not in inside:
                score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[: rule.top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def made(n=300):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["É", "ß-x", "it's", " ", "A"]
    text = lambda k: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t ", ", ", "\n", "; "]) for _ in range(k))
    docs = [(rnd.choice(["en", "de", None]), text(rnd.randrange(0, 60))) for _ in range(n)]
    docs += [("en", None), (None, ""), ("fr", " .;\n"), ("en", "New York City hall. " * 40), ("de", "one two three four five six " * 500), ("de", "x" * 5000 + " tail end" * 40)]
    return docs + [("en", "the very same copy of a text, it is")] * 50


def frame(spark, docs):
    return spark.createDataFrame([(i if i % 7 else None, t, lang, "clash", 0) for i, (lang, t) in enumerate(docs)], SCHEMA).repartition(5)


def test_parts_count_the_whole():
    """However a text is cut, each phrase is counted once."""
    rnd = random.Random(1)
    texts = [t for _, t in made(30) if t] + ["", " ", "a", "a b c d e f", "...", "a. b c.d e ", "x" * 40 + " y z " + "u" * 40]
    for size in (1, 5, 12, 64, 4000):
        for text in texts:
            got = Counter()
            cut = [("en", p, n) for p, n in phrases.parts(text.encode(), size, 3)]
            rnd.shuffle(cut)
            for _, _, phrase, _, counts in phrases.phrases_of(cut, phrases.Rules(), spell=True):
                for p, c in zip(phrase.to_pylist(), counts.tolist()):
                    if c:
                        got[tuple(p.split(" "))] += c
            assert got == Counter(grams(text)), (size, text[:50])


def test_brute_force(spark):
    docs = made()
    df = frame(spark, docs)
    for rule in (
        phrases.Rules(), phrases.Rules(support=4, top=50), phrases.Rules(support=3, sample_share=0.9, top=30, slice_bytes=300),
        phrases.Rules(support=5, sample_share=0.0), phrases.Rules(longest=2, support=2, subsumed_percent=10), phrases.Rules(support=4, bitmap_words=1),
    ):
        got = sorted(tuple(r) for r in phrases.mined(df, rule).collect())
        assert got == brute(docs, rule), rule
    assert phrases.mined(spark.createDataFrame([], SCHEMA)).count() == 0


def test_border_failures_are_closed(spark):
    """A sample of nothing proposes nothing: all longer phrases are found by the further pass, with the counts of a full count."""
    docs = made(80)
    rule, scratch = phrases.Rules(support=3, sample_share=0.0), Scratch(spark, "test")
    got = {(r.lang, r.phrase): r.n for r in phrases.frequent(frame(spark, docs), rule, scratch).filter("words > 0").collect()}
    want = Counter()
    for lang, text in docs:
        want.update((lang or "und", " ".join(p)) for p in grams(text))
    assert got == {p: c for p, c in want.items() if c >= 3}
    assert scratch.n == 4  # proposals, the full pass, its failures, what they make possible


def test_hashes_of_other_languages_differ():
    one, two = (list(phrases.phrases_of([(x, b"a b c", 0)], phrases.Rules(), spell=True)) for x in ("en", "de"))
    assert not {h for *_, hashed, _ in one for h in hashed.tolist()} & {h for *_, hashed, _ in two for h in hashed.tolist()}
    assert pa.array(one[1][2]).to_pylist() == ["a b", "b c"]


def test_query_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = queries.QUERIES["op12_phrases"](spark, sf_dir)
    want = con.execute(queries.ORACLE_SQL["op12_phrases"])
    order = [d[0] for d in want.description]
    assert sorted(order) == sorted(got.columns)
    rows = sorted(map(tuple, got.select(*order).collect()))
    assert rows and rows == sorted(want.fetchall())
