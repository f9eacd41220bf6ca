import random

import numpy as np

from tidemark.llm import urlfilter as u

SCHEMA = "page_id long, url string, host string, key int"
URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.NET/en/x?y", "https://a.example.net/de/", "http://net/", "http://inet/x", "http://x.org/fr/1#top", "http://x.org/fr", "http://org?x",
    "http://" + "a." * 60_000 + "net/" + "x" * 200_000, "y" * 200_000,
    "http://example.com/de/1", "http://example.com/DE/1", "http://m.example.com:80/de/", "a://b://c/d", "http://É.NET/ß?q", "x\n://q.net\n/r",
]


def brute(url):
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", "", None
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in u.RULES for n, _, p in [r.partition("/")] if (host == n or host.endswith("." + n)) and path.startswith("/" + p)]
    return host, path, max(fits, key=len, default=None)


def test_parts_and_rules(spark):
    rows = [(i, x, "clash", 1) for i, x in enumerate(URLS)] + [(None, URLS[4], "", 1), (4, URLS[4], "", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    listed = spark.createDataFrame([("org",), ("org",), ("nowhere",), ("x.org",), (None,)], "host string")
    got = u.judged(frame, listed).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            host, path, rule = brute(URLS[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == (dict(u.RULES)[rule] if rule else "block" if host in ("org", "x.org") else "allow")
    assert u.judged(spark.createDataFrame([], SCHEMA), listed).count() == 0
    assert {r.verdict for r in u.judged(frame, listed.limit(0)).collect() if r.rule is None} == {"allow"}


def test_cascade_is_exact(spark):
    rnd = random.Random(8)
    keys = [(f"host{k}.example", rnd.random() < 0.05) for k in range(20_000)]
    frame = spark.createDataFrame(keys, "key string, listed boolean")
    cascade = u.build(frame)
    assert len(cascade.levels) > 2
    hashed = frame.select("listed", *u.key_hashes(frame.key)).toPandas()
    assert (u.listed(cascade, hashed["one"].to_numpy(np.int64), hashed["two"].to_numpy(np.int64)) == hashed["listed"]).all()
    assert cascade.n_bytes() < 3000  # smaller than the list's hashes
    assert u.build(frame, most_bytes=100) is None
    for all_listed in (True, False):
        own = u.build(spark.createDataFrame([("a", all_listed), ("b", all_listed)], "key string, listed boolean"))
        assert (u.listed(own, hashed["one"].to_numpy(np.int64)[:0], hashed["two"].to_numpy(np.int64)[:0]).size) == 0


def test_join_beyond_the_bound(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 50}.org/x", "", 0) for k in range(500)], SCHEMA)
    listed = spark.createDataFrame([(f"h{k}.org",) for k in range(0, 50, 3)], "host string")
    one, two = (sorted(map(tuple, u.judged(pages, listed, most_bytes=m).collect())) for m in (1 << 20, 1))
    assert one == two and any(r[-1] == "block" for r in one)
