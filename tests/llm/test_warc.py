import hashlib
from collections import Counter

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, tie int"


def rows():
    big, other = "<p>é</p>" * 200, "x" * 1000
    out = [(i, f"http://a/{i}", big) for i in (5, 900, 17)] + [(i, None, "y" * 999) for i in (1, 2)] + [(31, "http://b\r\nX: y", other), (32, "", other)]
    out += [(40, "u", None), (41, "u", ""), (None, "u", "z" * 2000), (None, "v", "w" * 1500), (77, "v", "w" * 1500), (50, "b", "q" * 1200), (50, "a", "q" * 1200), (60, "long", "r\r\n\r\n" * 300_000)]
    return out + [(2**60 + i, "far", "k" * 1100) for i in (1, 2)]


def test_archive(spark, tmp_path):
    frame = spark.createDataFrame([(*r, "clash", 3) for r in rows()], SCHEMA)
    rules = warc.Rules(frame_bytes=3000, bundle_bytes=9000)
    index = warc.write(frame.repartition(3), f"file://{tmp_path}/w", rules)
    got = warc.read(index, f"file://{tmp_path}/w").collect()
    body = lambda h: (h or "").encode()
    largest = {}
    for i, _, h in rows():
        if len(body(h)) >= 1000 and i is not None:
            largest[h] = max(i, largest.get(h, i))
    want, seen = [], set()
    for i, u, h in sorted(rows(), key=lambda r: str(r[1])):
        to = largest.get(h)
        first = i == to and (i, h) not in seen
        seen.add((i, h))
        again = to is not None and not first
        want.append((i, len(body(h)), hashlib.sha1(body(h)).hexdigest(), "revisit" if again else "response", to if again else None))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(want)
    texts = {i: body(h) for i, _, h in rows()}
    assert all(r.payload == texts[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    for entry in index.collect():
        fields, block = warc.fetch(f"file://{tmp_path}/w", entry)
        assert fields["WARC-Record-ID"] == f"<{entry.record_id}>" and len(block) == int(fields["Content-Length"])
    assert index.select("bundle").distinct().count() > 2 and index.agg({"frame": "max"}).first()[0] > 0


def test_frames_stand_alone(spark, tmp_path):
    import zstandard

    data, index = warc.bundle([(f"r{k}", bytes([65 + k]) * 300) for k in range(10)], 1000, 3)
    table = warc.frames(data)
    assert len(table) == 3 and [x[:3] for x in index][4] == ("r4", 1, 0)
    raw = b"".join(zstandard.ZstdDecompressor().decompress(data[a : a + n], max_output_size=size) for a, n, size in table)
    assert raw == b"".join(bytes([65 + k]) * 300 for k in range(10))
    assert zstandard.ZstdDecompressor().decompressobj().decompress(data)[:300] == b"A" * 300
    empty = warc.write(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none")
    assert warc.read(empty, f"{tmp_path}/none").count() == 0


def test_many_shared_digests(spark, tmp_path):
    """Beyond the bound only payloads whose digest may be shared move; the verdicts are the same."""
    frame = spark.createDataFrame([(*r, "clash", 3) for r in rows()], SCHEMA)
    tables = [{(r.page_id, r.url, r.digest, r.tie, r.refers_to) for r in warc.verdicts(frame, warc.Rules(most_broadcast=most)).collect()} for most in (1000, 2)]
    assert tables[0] == tables[1] and len(tables[0]) == len(rows())
    index = warc.write(frame, f"{tmp_path}/c")
    few = warc.read(index.union(index), f"{tmp_path}/c", ("page_id", "record_type"))
    assert few.columns == ["page_id", "record_type"] and few.count() == len(rows())
