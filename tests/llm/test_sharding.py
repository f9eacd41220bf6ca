import random
import zlib
from hashlib import md5

from tidemark.llm import ranges, sharding
from tidemark.llm.shared import Scratch

SCHEMA = "doc_id long, text string, shard string, size int"
SMALL = ranges.Ranges(rows=20, most=6, draws=4)


def brute(docs, n):
    """(doc_id, size, crc, shard, slot) of every document: laid end to end by key, a shard where its middle is."""
    keyed = []
    for i, t in docs:
        body = (t or "").encode()
        keyed.append((int(md5(body).hexdigest()[:15], 16), -(10**9) if i is None else i, len(body) + 1, zlib.crc32(body), i))
    total, at, slots, out = sum(k[2] for k in keyed), 0, {}, []
    for _, _, size, crc, i in sorted(keyed, key=lambda k: k[:4]):
        shard = min(n - 1, (2 * at + size) * n // (2 * total))
        out.append((i, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        at += size
    return out


def rows_of(df):
    return [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in df.collect()]


def docs_of(n=400):
    rnd = random.Random(4)
    docs = [(i, "w" * rnd.randrange(90)) for i in range(n)] + [(n + i, "the same copy") for i in range(n)]
    docs += [(-1 - i, None) for i in range(3)] + [(None, "x")] * 40 + [(None, None), (7000, ""), (7001, "é" * 3000), (7002, "long " * 20_000)]
    return docs + [(9, "again")] * 150


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_brute_force(spark):
    docs = docs_of()
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], SCHEMA)
    for n, rule in ((8, ranges.Ranges()), (8, SMALL), (3, SMALL), (1, SMALL)):
        assert sorted(rows_of(sharding.shards(df, n, rule)), key=key) == sorted(brute(docs, n), key=key)
    assert sharding.shards(spark.createDataFrame([], SCHEMA)).count() == 0
    assert rows_of(sharding.shards(df.limit(1))) == brute(docs[:1], 8)


def test_sizes_are_near_equal_and_copies_are_neighbours(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sharding.shards(docs, 8, SMALL).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and (sums - got["size"].sum() / 8).abs().max() <= got["size"].max()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
        by_slot = own.sort_values("slot")
        assert list(by_slot.text_hash) == sorted(own.text_hash)


def test_overfull_ranges_are_divided(spark):
    """Weight and rows disagree: few heavy rows take nearly all ranges, many light ones share one until it is divided."""
    rows = spark.range(3000).selectExpr("case when id < 100 then id else id + 100000 end as k", "case when id < 100 then 1000000L else 1L end as w")
    scratch = Scratch(spark, "test")
    rule = ranges.Ranges(rows=200, most=20, draws=8)
    got = ranges.positions(rows, ("k", "w"), scratch, "w", rule)
    want = sorted((r.k, r.w) for r in rows.collect())
    assert sorted((r.k, r.w, r.rows_before) for r in got.collect()) == [(k, w, i) for i, (k, w) in enumerate(want)]
    sizes = [r._rows for r in spark.read.parquet(f"{scratch.folder}/{max(p for p in names(scratch) if p.endswith('sizes'))}").collect()]
    assert max(sizes) <= 2 * rule.rows and sum(sizes) == 3000 and len(names(scratch, "keys")) > 1


def names(scratch, kind="sizes"):
    import os

    folder = scratch.folder.removeprefix("file:")
    return [p for p in os.listdir(folder) if p.endswith(kind)]


def test_written_shards(spark, tmp_path):
    docs = [(i, t) for i, t in docs_of(100)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], SCHEMA)
    sums = sharding.write(df, str(tmp_path / "out"), 4, SMALL, file_bytes=20_000)
    assert sums.agg({"documents": "sum"}).first()[0] == len(docs)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {"doc_id", "text", "shard", "size", "_shard"} == set(back.columns)
    rows = back.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(docs, key=repr)
    # Rows that are not repeated are where `shards` has them.
    once = {d for d in docs if docs.count(d) == 1}
    told = {(r[0], r[2]): r[3] for r in brute(docs, 4)}
    assert all(told[r.doc_id, zlib.crc32((r.text or "").encode())] == r._shard for r in rows if (r.doc_id, r.text) in once)
    plain = df.select("doc_id", "text")
    sharding.write(plain, str(tmp_path / "plain"), 4, SMALL)
    assert "shard" in spark.read.parquet(str(tmp_path / "plain")).columns


def test_query_against_sql(spark, sf_dir):
    import duckdb

    from tidemark.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = queries.QUERIES["op11_sharding"](spark, sf_dir)
    want = con.execute(queries.ORACLE_SQL["op11_sharding"])
    order = [d[0] for d in want.description]
    assert sorted(order) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(want.fetchall())
