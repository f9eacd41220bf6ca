"""Secrets in texts, told from examples by who else publishes them.

Three patterns find base spans. A fourth finds opaque strings (long runs of
letters and digits); of these, and of the base spans' values, the hashes are
counted over the whole corpus by distinct repositories and owners. A value that
several owners publish is a copied example; one that few do looks live, however
often they publish it. Live opaque strings become spans of their own. DataFrame
functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import fresh_names, text_key, written

#: Kinds in the order that breaks ties, their patterns, the group that holds the value, its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs end where others begin, so shorter ones can be left out at once
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24), ("opaque", OPAQUE, 0, 20))
OPAQUE_AT = 3

SPAN = "array<struct<start:int,kind:int,end:int,hash:bigint>>"


@dataclass(frozen=True)
class Ownership:
    #: An opaque value of at most so many owners looks live, in however many repositories.
    max_owners: int = 2
    #: Spans of up to so many texts and places in all are broadcast to be taken out; more are joined by a shuffle.
    most_broadcast: int = 500_000


def found(text: Column, kind: int) -> Column:
    """Spans of one kind: leftmost matches that don't overlap, short ones dropped.

    The pieces between matches and the matches themselves give the places, in
    code points.
    """
    _, pattern, group, least = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    parts = F.zip_with(
        F.zip_with(pieces, whole, lambda p, w: F.struct(F.length(p).alias("gap"), F.length(w).alias("n"))),
        value,
        lambda x, v: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), v.alias("v")),
    )
    none = F.expr(f"cast(array() as {SPAN})")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["n"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.xxhash64(x["v"]).alias("hash"))
        good = F.coalesce(F.length(x["v"]) >= least, F.lit(False))
        if kind == OPAQUE_AT:
            good = good & x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]")
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(parts, zero, step, lambda acc: acc["out"])).otherwise(none)


def spans_of(docs: DataFrame, id_col: str, text_col: str, repo: Column, owner: Column) -> DataFrame:
    """doc_id, key, repo, owner, base and opaque spans of every row.

    Opaque spans that touch a base span are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"),
        F.concat(*(found(text, k) for k in range(OPAQUE_AT))).alias("b"), found(text, OPAQUE_AT).alias("o"),
    )
    free = F.filter("o", lambda x: ~F.exists("b", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return rows.select("doc_id", "key", "repo", "owner", F.array_sort("b").alias("base"), free.alias("opaque"))


def ownership(rows: DataFrame, rule: Ownership) -> DataFrame:
    """hash, owners, repositories, live: of every value in the corpus.

    Two steps of distinct keys, each summed where it is read, so that a value
    in a third of all rows costs one row a task and owner.
    """
    each = rows.select("repo", "owner", F.explode(F.array_distinct(F.concat(F.transform("base", lambda x: x["hash"]), F.transform("opaque", lambda x: x["hash"])))).alias("hash"))
    pairs = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories")).withColumn("live", F.col("owners") <= rule.max_owners)


def told(rows: DataFrame, rule: Ownership) -> DataFrame:
    """doc_id, key and spans (base and added ones, sorted) of the rows of `spans_of` that have any candidate."""
    some = rows.filter((F.size("base") > 0) | (F.size("opaque") > 0))
    verdicts = ownership(some, rule)
    each = some.select("doc_id", "key", F.explode(F.concat("base", "opaque")).alias("x")).distinct().select("doc_id", "key", "x", F.col("x.hash").alias("hash"))
    good = each.join(verdicts, "hash").filter((F.col("x.kind") < OPAQUE_AT) | F.col("live"))
    span = F.struct(F.col("x.start").alias("start"), F.col("x.kind").alias("kind"), F.col("x.end").alias("end"), "live", "owners", "repositories")
    return good.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(span)).alias("spans"))


NO_SPANS = "cast(array() as array<struct<start:int,kind:int,end:int,live:boolean,owners:bigint,repositories:bigint>>)"


def scanned(
    docs: DataFrame, rule: Ownership = Ownership(), id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source"
) -> DataFrame:
    """doc_id, key, base and spans (base and added ones, sorted) of every row.

    A span has start and end in code points, its kind's number, the owners and
    repositories of its value in the corpus and whether that looks live. Null
    texts are empty; null repositories and owners count as one each; rows
    without doc_id and repeated rows keep their own results; other columns
    don't matter. An empty table gives an empty result.
    """
    rows = written(spans_of(docs, id_col, text_col, F.col(repo_col), F.col(owner_col)), "secrets")
    left, right = rows.alias("l"), told(rows, rule).alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("l.key").eqNullSafe(F.col("r.key"))
    return left.join(right, same, "left").select("l.doc_id", "l.key", "base", F.coalesce("spans", F.expr(NO_SPANS)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def digest(scans: DataFrame) -> DataFrame:
    """The counts, the base spans' hash and the span list of each row of `scanned`, each span's number of owners, and how many spans look live."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return scans.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k][0]}") for k in range(OPAQUE_AT)),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda x: x["owners"].cast("string")), ",").alias("owners"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """`text` with its spans replaced by `mark`; spans that overlap become one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        new = x["start"] >= acc["at"]
        out = F.when(new, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, rule: Ownership = Ownership(), id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """The rows and columns of `docs`, every span of `scanned` replaced in the text.

    Null texts stay null; columns may have any names; the rest is as in
    `scanned`. Texts don't move: the spans go to them, unless they are many.
    """
    rows = written(spans_of(docs, id_col, text_col, F.col(repo_col), F.col(owner_col)).filter((F.size("base") > 0) | (F.size("opaque") > 0)), "secrets")
    doc, key, spans = fresh_names(docs, "doc", "key", "spans")
    marked = written(told(rows, rule).select(F.col("doc_id").alias(doc), F.col("key").alias(key), F.col("spans").alias(spans)), "marked")
    size = marked.agg(F.coalesce(F.sum(F.size(spans) + 1), F.lit(0))).first()[0]
    same = F.col(id_col).eqNullSafe(F.col(doc)) & (text_key(F.col(text_col)) == F.col(key))
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(redacted(F.col(text_col), F.col(spans)))
    joined = docs.join(F.broadcast(marked) if size <= rule.most_broadcast else marked, same, "left")
    return joined.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
