import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np

from tidemark.llm import importance, queries, ranges

SCHEMA = "doc_id long, text string, rank string, score int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_features(text):
    words = WORD.findall(lowered(text))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, target, rule=importance.Rules()):
    bucket = lambda f: zlib.crc32(f.encode()) % rule.buckets
    have, want = (Counter(bucket(f) for t in texts for f in brute_features(t)[1]) for texts in ([t for _, t in docs], target))
    d, t = sum(have.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * (d + rule.buckets) / ((have[b] + 1) * (t + rule.buckets)))) for b in range(rule.buckets)}
    rows = []
    for i, text in docs:
        words, found = brute_features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= rule.least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, *r[1:]))
    n = len(able) * rule.drawn_percent // 100
    return [(*r, k + 1 if k < n else None) for k, r in enumerate(able)] + [(*r, None) for r in rows if r[1] < rule.least_words]


def keyed(rows):
    return sorted(rows, key=repr)


def test_crc_of_spans():
    rnd = random.Random(2)
    words = [bytes(rnd.randrange(97, 256) for _ in range(n)) for n in (1, 2, 3, 254, 255, 256, 257, 258, 511, 512, 513, 5000, 1, 70_000, 4)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    data = np.frombuffer(b" ".join(words), np.uint8)
    paired = np.arange(len(words) - 1)
    one, two = importance.crcs(data, starts, ends, paired)
    assert one.tolist() == [zlib.crc32(w) for w in words]
    assert two.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])]
    assert importance.folded(data, starts, ends).tolist() == one.tolist()


def test_parts_have_the_features_of_the_whole():
    rnd = random.Random(3)
    texts = ["", "a", "  ", "ab  cd", "x" * 50, "x" * 50 + " y", " ".join("w" * rnd.randrange(1, 30) for _ in range(60)), "é" * 40 + "-ß a" * 20, "... " * 30 + "end " + "!" * 40]
    for size in (1, 2, 7, 16, 1000):
        parts = [(i, p, again) for i, t in enumerate(texts) for p, again in importance._parts(t.encode(), size)]
        got = Counter((int(r), int(c)) for rows, crc in importance.features(parts) for r, c in zip(rows, crc))
        assert got == Counter((i, zlib.crc32(f.encode())) for i, t in enumerate(texts) for f in brute_features(t)[1])
    assert list(importance.features([(0, b"", False), (1, b" ,", False)])) == []


def docs_of(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    long = " ".join(f"W{i % 700}é" for i in range(60_000)) + " " + "z" * 3000
    return docs + [(90_001, None), (90_002, ""), (90_003, "?! -"), (None, "one two " * 15), (None, None), (90_004, long)] + [(90_005, "same words " * 12)] * 30 + [(90_006 + i, "same words " * 12) for i in range(30)]


def test_brute_force(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [None, ""]
    frame = spark.createDataFrame([(i, t, "r", 0) for i, t in docs], SCHEMA)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    rule = importance.Rules(slice_bytes=5000)
    small = ranges.Ranges(rows=20, most=5, draws=5)
    got = [tuple(r) for r in importance.resampled(frame, aim, rule, ranges=small).collect()]
    assert keyed(got) == keyed(brute(docs, target))
    ids = {r[0] for r in got if r[5]}
    drawn = importance.drawn(frame, aim)
    assert drawn.columns == frame.columns and {r.doc_id for r in drawn.collect()} == ids


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(i, f"word{i} " * 25, "", 0) for i in range(9)], SCHEMA)
    assert importance.resampled(none, none).count() == 0 and importance.resampled(none, some).count() == 0
    got = [tuple(r) for r in importance.resampled(some, none).collect()]
    assert keyed(got) == keyed(brute([(i, f"word{i} " * 25) for i in range(9)], [])) and sum(r[5] is not None for r in got) == 2


def test_draws_lean_to_the_target(spark):
    rnd = random.Random(6)
    near, far = [f"n{i}" for i in range(200)], [f"f{i}" for i in range(200)]
    docs = [(i, " ".join(rnd.choice(near if i % 4 == 0 else far) for _ in range(40)), "", 0) for i in range(800)]
    aim = [(i, " ".join(rnd.choice(near) for _ in range(40)), "", 0) for i in range(50)]
    got = importance.resampled(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(aim, SCHEMA)).filter("rank is not null").collect()
    assert len(got) == 200 and sum(r.doc_id % 4 == 0 for r in got) > 100  # a draw at random: 50


def test_query_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    got = queries.QUERIES["op13_importance"](spark, sf_dir)
    want = con.execute(queries.ORACLE_SQL["op13_importance"])
    order = [d[0] for d in want.description]
    assert sorted(order) == sorted(got.columns)
    assert keyed(map(tuple, got.select(*order).collect())) == keyed(want.fetchall())
