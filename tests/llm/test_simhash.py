import random
import re

import pandas as pd
import xxhash

from tidemark.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs).toPandas()
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(fps)
    first = {}
    for (doc_id, *_), f in zip(rows, fps):
        if doc_id is not None:
            first[roots[f]] = min(doc_id, first.get(roots[f], doc_id))
    want = sorted((str(r[0]), f"{f:016x}", str(first.get(roots[f]))) for r, f in zip(rows, fps))
    have = sorted((str(None if pd.isna(a) else int(a)), b, str(None if pd.isna(c) else int(c))) for a, b, c in got.itertuples(index=False))
    assert have == want


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, None, None) for r in docs]
    words = docs[0].text.split()[:150]
    rnd = random.Random(1)
    for k in range(60):  # a dense group of near copies
        own = list(words)
        own[rnd.randrange(len(own))] = f"w{k}"
        rows.append((10_000 + k, " ".join(own), None, None))
    check(spark, rows)


def test_edges(spark):
    rows = [(5, None, "x", 1), (3, "", "x", 1), (9, " \n\t", "x", 1), (None, "only two", "x", 1), (4, "Only TWO", "x", 1), (4, "Only TWO", "x", 1), (8, "É é É", None, None), (7, "a b c " * 20_000, None, None)]
    check(spark, rows)
    check(spark, [(None, "nobody", None, None), (None, "nobody", None, None)])
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_at_every_distance(spark):
    rnd = random.Random(2)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        f = rnd.getrandbits(64)
        fps.add(f)
        for d in (1, 2, 3, 4):
            g = f
            for b in rnd.sample(range(64), d):
                g ^= 1 << b
            fps.add(g)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(simhash.with_company(frame))).collect()}
    want = brute_components(fps)
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(signed(f))
    for members in groups.values():
        assert {roots.get(f, f) for f in members} == {min(members)}


def test_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 41)} | {(100, 90)}


def test_screening_leaves_out_what_has_no_link(spark):
    rnd = random.Random(3)
    alone = [rnd.getrandbits(63) for _ in range(200)]
    pairs = [(f, f ^ 7 << 3 * k) for k, f in enumerate(rnd.getrandbits(50) for _ in range(10))]
    frame = spark.createDataFrame([(f,) for f in alone] + [(f,) for p in pairs for f in p], "fp long")
    assert {r.fp for r in simhash.with_company(frame).collect()} == {f for p in pairs for f in p}


def test_first_of_classes(spark):
    text = "one two three four five six seven eight"
    rows = [(4, text, "a", 1), (2, text, "b", 2), (None, text, "c", 3), (9, "something else entirely here now", "d", 4), (9, "something else entirely here now", "d", 4), (None, "no id for this one at all", "e", 5)]
    got = simhash.first_of_classes(spark.createDataFrame(rows, "doc_id long, text string, fp string, key int"))
    assert got.columns == ["doc_id", "text", "fp", "key"]
    assert sorted((str(r.doc_id), r.fp, r.key) for r in got.collect()) == [("2", "b", 2), ("9", "d", 4), ("None", "e", 5)]


def test_ids_and_names_of_any_kind(spark):
    text = "one two three four five six seven eight"
    rows = [("b", text, 1, 1, 1, 1), ("a", text, 2, 2, 2, 2), (None, text, 3, 3, 3, 3), ("z", "something else entirely here now", 4, 4, 4, 4), ("z", "something else entirely here now", 4, 4, 4, 4)]
    frame = spark.createDataFrame(rows, "doc_id string, text string, _key int, _doc int, root int, n int")
    got = simhash.first_of_classes(frame)
    assert got.columns == frame.columns and sorted(r.doc_id for r in got.collect()) == ["a", "z"]
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()} == {"a": "a", "b": "a", None: "a", "z": "z"}
    assert simhash.first_of_classes(frame.limit(0)).count() == 0


def test_slices_of_long_texts():
    rnd = random.Random(12)
    texts = [" ".join("".join(rnd.choice("abÉ ") for _ in range(rnd.randrange(1, 9))) for _ in range(n)) for n in (0, 1, 2, 3, 50, 400)]
    texts += [" \n" * 40, "one  two" + " " * 60, " " * 50 + "a b c", "x" * 200, "x" * 200 + " y z"]
    want = [brute_fingerprint(t) for t in texts]
    for long in (5, 17, 64, 1 << 20):
        got = simhash.fingerprints_of(texts[:3] + [None] + texts[3:], long=long).astype("uint64").tolist()
        assert got[:3] + got[4:] == want and got[3] == 0


def test_a_very_long_text_takes_bounded_memory():
    """34 million characters in a process of their own: what is held beside the text is a few slices."""
    import subprocess
    import sys

    code = """
import resource
from tidemark.llm import simhash
text = "".join(f"w{i % 99991} " for i in range(5_000_000))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
print(simhash.fingerprints_of([text])[0], (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True).stdout.split()
    assert int(out[1]) < 300
