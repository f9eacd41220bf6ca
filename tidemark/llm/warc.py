"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some records,
and a seek table in a skippable frame at its end. An index maps every record to
its bundle, frame and place within the frame, so one record costs one frame.

Pages with equal payloads of some size are stored once: the page with the
largest id is the response, the others are revisit records that refer to it.
Each attempt of a task writes bundles of its own names, moved into place whole;
the index, which Spark commits, names those that count.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import bitmap_place, hash_bitmap, small_batches, written

#: Fixed values of the seekable format: magic numbers of a skippable frame and of the seek table's footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
SUFFIX = ".warc.zst"


@dataclass(frozen=True)
class Rules:
    #: Smaller payloads are never revisited.
    least_bytes: int = 1000
    frame_bytes: int = 1 << 18
    bundle_bytes: int = 1 << 25
    level: int = 3
    #: Shared digests (a hash and an id each) are broadcast up to so many.
    most_broadcast: int = 500_000
    date: str = "2024-01-01T00:00:00Z"


def record_id(page_id: str | None, tie: int) -> str:
    """A record's identifier; rows that share a page_id are told apart by a count."""
    return f"urn:page:{'' if page_id is None else page_id}" + (f":{tie}" if tie else "")


def verdicts(pages: DataFrame, rules: Rules) -> DataFrame:
    """page_id (as text), url, payload, digest, tie and refers_to (null: a response).

    Sizes and digests are gathered first. Digests that several pages share are
    broadcast up to `most_broadcast`, and no payload moves; if they are more, a
    bitmap of their hashes is, and only payloads move whose digest it may hold.
    Of rows that share an id and a payload the first by url comes first; only
    where there are such rows are they numbered.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    rows = rows.withColumn("large", F.octet_length("payload") >= rules.least_bytes)
    slim = written(rows.select("page_id", "digest", "large"), "digests")
    often = slim.filter("large").groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1")
    shared = written(often.select(F.col("digest").alias("_digest"), "largest"), "shared")
    same = F.col("digest") == F.col("_digest")
    if shared.count() <= rules.most_broadcast:
        met = rows.join(F.broadcast(shared), same, "left")
    else:
        hashed = rows.withColumn("_hash", F.xxhash64("digest"))
        bits = F.broadcast(hash_bitmap(shared.select(F.xxhash64("_digest").alias("hash")), rules.most_broadcast))
        word, held = bitmap_place(F.col("_hash"), rules.most_broadcast)
        told = hashed.join(bits, word == F.col("word"), "left").withColumn("_maybe", F.coalesce(F.col("bits").bitwiseAND(held) != 0, F.lit(False))).drop("word", "bits", "_hash")
        alone = told.filter("not _maybe").drop("_maybe").withColumn("_digest", F.lit(None).cast("string")).withColumn("largest", F.lit(None).cast("long"))
        met = told.filter("_maybe").drop("_maybe").join(shared, same, "left").unionByName(alone)
    if slim.groupBy("digest", "page_id").count().filter("count > 1").isEmpty():
        counted = met.withColumn("tie", F.lit(0))
    else:
        counted = met.withColumn("tie", F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url")) - 1)
    first = F.coalesce((F.col("page_id") == F.col("largest")) & (F.col("tie") == 0), F.lit(False))
    return counted.select(
        F.col("page_id").cast("string"), "url", "payload", "digest", "tie", F.when(~first, F.col("largest")).cast("string").alias("refers_to")
    )


def _record(row, rules: Rules) -> bytes:
    """One WARC record: an HTTP response, or its head with a reference."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(row.payload)}\r\n\r\n".encode()
    again = row.refers_to is not None
    block = head if again else head + row.payload
    fields = [
        ("WARC-Type", "revisit" if again else "response"),
        ("WARC-Record-ID", f"<{record_id(row.page_id, row.tie)}>"),
        ("WARC-Date", rules.date),
        ("WARC-Target-URI", " ".join((row.url or "").split())),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row.digest)).decode()),
    ]
    if again:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_id(row.refers_to, 0)}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def bundle(records: list[tuple[str, bytes]], frame_bytes: int, level: int) -> tuple[bytes, list[tuple[str, int, int, int]]]:
    """A seekable bundle, and record id, frame, offset in the frame and length of each record."""
    packer = zstandard.ZstdCompressor(level=level)
    out, table, index, own, size = [], [], [], [], 0

    def close() -> None:
        raw = b"".join(own)
        packed = packer.compress(raw)
        out.append(packed)
        table.append(struct.pack("<II", len(packed), len(raw)))
        own.clear()

    for name, record in records:
        index.append((name, len(table), size, len(record)))
        own.append(record)
        size += len(record)
        if size >= frame_bytes:
            close()
            size = 0
    if own:
        close()
    entries = b"".join(table) + struct.pack("<IBI", len(table), 0, SEEKABLE)
    return b"".join([*out, struct.pack("<II", SKIPPABLE, len(entries)), entries]), index


def frames(data: bytes) -> list[tuple[int, int, int]]:
    """Place, packed and raw size of each frame, from the seek table at the end."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    entry = 12 if flags & 0x80 else 8  # with or without checksums
    table = np.frombuffer(data[-9 - n * entry : -9], "<u4").reshape(n, entry // 4).astype(np.int64)
    ends = np.cumsum(table[:, 0])
    return list(zip((ends - table[:, 0]).tolist(), table[:, 0].tolist(), table[:, 1].tolist()))


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _records(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, fields and block of each record of a frame, one after the other."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at) + 4
        fields, _ = parsed(raw[at:end])
        size = int(fields["Content-Length"])
        yield at, fields, raw[end : end + size]
        at = end + size + 4


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)


def _write(folder: str, rules: Rules):
    """For mapInPandas over `verdicts`: writes bundles; gives their index."""

    def stored(name: str, records: list[tuple[str, bytes]]) -> pd.DataFrame:
        data, index = bundle(records, rules.frame_bytes, rules.level)
        store, root = _filesystem(folder)
        draft = f"{root}/.{name}"
        with store.open_output_stream(draft) as out:
            out.write(data)
        store.move(draft, f"{root}/{name}{SUFFIX}")
        return pd.DataFrame(index, columns=["record_id", "frame", "offset", "length"]).assign(bundle=name + SUFFIX)

    def bundled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, attempt, n, own, size = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, [], 0
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                own.append((record_id(row.page_id, row.tie), _record(row, rules)))
                size += len(own[-1][1])
                if size >= rules.bundle_bytes:
                    yield stored(f"part-{part:06d}-{n:04d}-{attempt}", own)
                    n, own, size = n + 1, [], 0
        if own:
            yield stored(f"part-{part:06d}-{n:04d}-{attempt}", own)

    return bundled


INDEX = "record_id string, frame int, offset long, length long, bundle string"


def write(pages: DataFrame, folder: str, rules: Rules = Rules()) -> DataFrame:
    """Writes `pages` (page_id, url, html) as bundles below `folder`; gives the index.

    The index is a table in `folder`/index: record_id, bundle, frame, offset
    and length. The folder must be one that all executors reach. Null html is
    an empty payload, a null url an empty target; rows without page_id are
    records without a number, referred to by none; repeated rows are records of
    their own (revisits, if large enough). No rows: no bundles.
    """
    spark = pages.sparkSession
    small_batches(spark)
    store, root = _filesystem(folder)
    store.create_dir(f"{root}/bundles")
    rows = verdicts(pages, rules).mapInPandas(_write(f"{folder}/bundles", rules), INDEX)
    rows.write.parquet(f"{folder}/index")
    return spark.read.schema(rows.schema).parquet(f"{folder}/index")


RECORDS = "page_id long, record_id string, record_type string, refers_to long, url string, payload binary, payload_bytes long, payload_digest string"
RECORD_COLUMNS = [x.split()[0] for x in RECORDS.split(", ")]


def _page(name: str) -> int | None:
    number = name.strip("<>").split(":")[2]
    return int(number) if number else None


def _read(folder: str, columns: list[str]):
    """For mapInPandas over bundle names: their records, one frame at a time, each checked."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _filesystem(f"{folder}/bundles")
        unpack = zstandard.ZstdDecompressor()
        for name in (x for pdf in parts for x in pdf["bundle"]):
            with store.open_input_file(f"{root}/{name}") as f:
                for at, packed, size in _seek_table(f):
                    raw = unpack.decompress(f.read_at(packed, at), max_output_size=max(size, 1))
                    rows = [_told(fields, block) for _, fields, block in _records(raw)]
                    yield pd.DataFrame(rows, columns=RECORD_COLUMNS, dtype=object)[columns]

    return read


def _told(fields: dict[str, str], block: bytes) -> tuple:
    """A record's row; a response's payload is checked against its digest and size."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.rsplit(b"Content-Length: ", 1)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    again, name = fields["WARC-Type"] == "revisit", fields["WARC-Record-ID"]
    if not again and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {name}")
    refers_to = _page(fields["WARC-Refers-To"]) if again else None
    return _page(name), name.strip("<>"), fields["WARC-Type"], refers_to, fields["WARC-Target-URI"], None if again else payload, size, digest


def _seek_table(f) -> list[tuple[int, int, int]]:
    size = f.size()
    n, flags, _ = struct.unpack("<IBI", f.read_at(9, size - 9))
    table = n * (12 if flags & 0x80 else 8) + 9
    return frames(f.read_at(table, size - table))


def read(index: DataFrame, folder: str, columns: tuple[str, ...] = tuple(RECORD_COLUMNS)) -> DataFrame:
    """The records of the bundles that `index` names, or some of their columns.

    A revisit has no payload of its own; its size and digest are those of the
    response that it refers to. Every payload is checked against its digest,
    whatever the columns. Rows of `index` that repeat, and its other columns,
    don't matter; an empty index gives an empty result. Names are few bytes but
    much work, so they are dealt out in turn, and not by size or hash.
    """
    names = index.select("bundle").distinct()
    tasks = min(max(1, names.count()), 16 * index.sparkSession.sparkContext.defaultParallelism)
    types = dict(x.split() for x in RECORDS.split(", "))
    return names.repartition(tasks).mapInPandas(_read(folder, list(columns)), ", ".join(f"{c} {types[c]}" for c in columns))


def fetch(folder: str, entry) -> tuple[dict[str, str], bytes]:
    """One record by its index row: reads the seek table and one frame of the bundle."""
    store, root = _filesystem(folder)
    with store.open_input_file(f"{root}/bundles/{entry.bundle}") as f:
        at, packed, size = _seek_table(f)[entry.frame]
        raw = zstandard.ZstdDecompressor().decompress(f.read_at(packed, at), max_output_size=max(size, 1))
    return parsed(raw[entry.offset : entry.offset + entry.length])
