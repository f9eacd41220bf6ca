"""Benchmark decontamination by templates.

Numbers, units after numbers and names (capitalised words inside a sentence)
become typed placeholders; what is left are lower-cased words. Windows of five
template tokens of the documents are hash-joined with those of the benchmark
items. A document that holds four fifths of an item's windows holds the item,
copied or with other values in its slots, if the slots agree: along one
alignment, each of the item's values must stand for one value of the document.

A window that is mostly placeholders says nothing by itself. An item that has
no other windows (a sum, a list of names) or fewer tokens than a window is
found by its values: all its windows of plain tokens, of its own length if that
is less, and then its whole token sequence must stand in the document.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bitmap_place, fresh_names, hash_bitmap, small_or_shuffled, text_key
from tidemark.sources.tables import Scratch, written

#: Units that count as such after a number.
UNITS = (
    "mm", "cm", "dm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "yd", "yards", "mi", "mile", "miles",
    "mg", "g", "kg", "t", "gram", "grams", "oz", "ounces", "lb", "lbs", "pounds", "ml", "cl", "l", "litre", "litres",
    "liter", "liters", "gal", "gallons", "ms", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr",
    "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "hz", "khz", "mhz", "ghz",
    "w", "kw", "mw", "j", "kj", "v", "a", "k", "c", "f", "kb", "mb", "gb", "tb", "usd", "eur", "dollars", "cents", "euros",
)
NUMBER, UNIT, NAME = "\u0001", "\u0002", "\u0003"
NUMBER_PATTERN = r"\p{N}+(?:[.,]\p{N}+)*"
#: An upper-case letter after a lower-case one (or a comma or semicolon) and a space, and lower-case ones.
NAME_PATTERN = r"\p{Lu}(?<=[\p{Ll},;] .)\p{Ll}+"
UNIT_PATTERN = "(" + NUMBER_PATTERN + r")\x20?((?i:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")\b|[%°€$£])"
BETWEEN = r"[^\p{L}\p{M}\x{1}-\x{3}]+"
BETWEEN_PLAIN = r"[^\p{L}\p{M}\p{N}]+"
#: Characters of scripts that are written without spaces: each is a token of its own.
UNSPACED = r"([\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FFFF}])"


@dataclass(frozen=True)
class Templates:
    window: int = 5
    #: Of a window's tokens, so many are words at least: placeholders alone say nothing.
    least_words: int = 3
    least_share: float = 0.8
    #: Share of an item's slot values that must stand for one value each.
    least_consistent: float = 0.8
    #: Tables of up to so many rows (a few numbers each) are broadcast; larger ones are joined by a shuffle.
    most_broadcast: int = 2_000_000


def _spaced(text: Column) -> Column:
    return F.when(text.rlike(UNSPACED), F.regexp_replace(text, UNSPACED, " $1 ")).otherwise(text)


def tokens(text: Column) -> Column:
    """Template tokens: placeholders and lower-cased words."""
    text = F.regexp_replace(_spaced(text), NAME_PATTERN, f" {NAME} ")
    text = F.regexp_replace(text, UNIT_PATTERN, f" {NUMBER} {UNIT} ")
    text = F.regexp_replace(text, NUMBER_PATTERN, f" {NUMBER} ")
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def plain_tokens(text: Column) -> Column:
    """Lower-cased words and numbers, as they are."""
    return F.array_remove(F.split(F.lower(_spaced(text)), BETWEEN_PLAIN), "")


def _every(hashes: str, size: int, kind: Column) -> Column:
    """(at, hash) of all windows of `size` hashes; null for a shorter array."""
    places = F.sequence(F.lit(0), F.size(hashes) - size)
    return F.when(F.size(hashes) >= size, F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(kind, F.slice(hashes, i + 1, size)).alias("hash"))))


def _windows(df: DataFrame, ids: list[str], rule: Templates) -> DataFrame:
    """ids, at and hash of the windows, of words enough, of the text in `_t`."""
    marks = [F.xxhash64(F.lit(m)) for m in (NUMBER, UNIT, NAME)]
    hashed = df.select(*ids, F.transform(tokens(F.col("_t")), lambda x: F.xxhash64(x)).alias("_h"))
    own = lambda i: F.slice("_h", i + 1, rule.window)
    placed = hashed.select(*ids, "_h", _every("_h", rule.window, F.lit(0)).alias("_w"), F.exists("_h", lambda h: h.isin(*marks)).alias("_marked"))
    spoken = F.filter("_w", lambda x: F.size(F.filter(own(x["at"]), lambda h: ~h.isin(*marks))) >= rule.least_words)
    kept = F.when(F.col("_marked"), spoken).otherwise(F.col("_w"))
    return placed.select(*ids, F.explode(kept).alias("x")).select(*ids, "x.at", "x.hash")


def _plain_windows(df: DataFrame, ids: list[str], sizes: list[int]) -> DataFrame:
    """ids, at and hash of the windows of plain tokens of the text in `_t`, of each of the sizes."""
    hashed = df.select(*ids, F.transform(plain_tokens(F.col("_t")), lambda x: F.xxhash64(x)).alias("_h"))
    every = F.concat(*(F.coalesce(_every("_h", k, F.lit(k)), F.expr("cast(array() as array<struct<at:int,hash:bigint>>)")) for k in sizes))
    return hashed.select(*ids, F.explode(every).alias("x")).select(*ids, "x.at", "x.hash")


def slots(df: DataFrame, ids: list[str]) -> DataFrame:
    """ids, at, kind and value of every placeholder of the text in `_t`."""
    text = _spaced(F.col("_t"))
    names = F.regexp_extract_all(text, F.lit(NAME_PATTERN), F.lit(0))
    numbers = F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(0))
    units = F.regexp_extract_all(text, F.lit(UNIT_PATTERN), F.lit(2))
    placed = df.select(*ids, tokens(F.col("_t")).alias("_k"), names.alias("_names"), numbers.alias("_numbers"), units.alias("_units")).withColumn(
        "_p", F.transform("_k", lambda t, i: F.struct(i.alias("at"), t.alias("kind")))
    )

    def filled(kind: str, values: str) -> Column:
        places = F.filter("_p", lambda x: x["kind"] == kind)
        return F.zip_with(places, values, lambda p, v: F.struct(p["at"].alias("at"), p["kind"].alias("kind"), v.alias("value")))

    parts = [filled(NAME, "_names"), filled(NUMBER, "_numbers"), filled(UNIT, "_units")]
    return placed.select(*ids, F.explode(F.concat(*parts)).alias("x")).select(*ids, "x.*").filter("at is not null")


def _met(windows: DataFrame, side: DataFrame, rule: Templates) -> DataFrame:
    """The windows that the benchmark has (side: item_id, item_at, hash), with its rows.

    Many benchmark windows are not broadcast. A bitmap of their hashes is: its
    64-bit words are at most as many, and only windows that it may hold are
    shuffled.
    """
    if side.count() <= rule.most_broadcast:
        return windows.join(F.broadcast(side), "hash")
    word, bit = bitmap_place(F.col("hash"), rule.most_broadcast)
    maybe = windows.withColumn("_word", word).join(F.broadcast(hash_bitmap(side, rule.most_broadcast)), F.col("_word") == F.col("word"))
    return maybe.filter(F.col("bits").bitwiseAND(bit) != 0).drop("_word", "word", "bits").join(side, "hash")


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of `names` (null equals null), the right ones with an r_ in front."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"r_{n}"))
    return out


def _named(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(F.col(n).alias(f"r_{n}") for n in names)).distinct()


def matches(docs: DataFrame, benchmark: DataFrame, rule: Templates = Templates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, item_id, n_windows, n_matched of each item that a document holds.

    `key` is the text's hash, so rows that repeat give one result, and rows
    that share a doc_id (or have none) have their own. Null texts hold nothing;
    an item without a letter or digit has nothing to find, any other has. Very
    long texts are nothing special. Other columns don't matter. Either table
    empty gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    ids = ["doc_id", "key"]
    # Items are told apart by id and text, so that those without id, or with an id used twice, are found too.
    own_id = F.xxhash64("item_id", "text")
    items = benchmark.filter("text is not null").select(own_id.alias("item_id"), F.col("text").alias("_t")).distinct()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("_t")).filter("_t is not null")

    first = lambda found: found.groupBy("item_id", "hash").agg(F.min("at").alias("item_at"))
    wanted = scratch.written(first(_windows(items, ["item_id"], rule)), "windows")
    bare = scratch.written(items.join(wanted.select("item_id").distinct(), "item_id", "left_anti"), "bare")
    size = F.least(F.size(plain_tokens(F.col("_t"))), F.lit(rule.window))
    sizes = sorted(r[0] for r in bare.select(size).distinct().collect() if r[0] > 0)

    found = [_held(_met(_windows(rows, ids, rule), wanted, rule), rows, items, wanted, rule, scratch)]
    if sizes:
        plain = bare.select("item_id", "_t", size.alias("_n"))
        each = None
        for k in sizes:
            own = _plain_windows(plain.filter(F.col("_n") == k), ["item_id"], [k])
            each = own if each is None else each.union(own)
        side = scratch.written(first(each), "plain")
        found.append(_spelled(_met(_plain_windows(rows, ids, sizes), side, rule), rows, bare, side, rule, scratch))
    names = benchmark.select(own_id.alias("_own"), F.col("item_id").alias("_name")).distinct()
    every = (found[0].union(found[1]) if sizes else found[0]).join(names, F.col("item_id") == F.col("_own"))
    out = written(every.select(*ids, F.col("_name").alias("item_id"), "n_windows", "n_matched"), "held")
    scratch.drop()
    return out


def _shared(met: DataFrame, wanted: DataFrame, least: float) -> DataFrame:
    """doc_id, key, item_id, n_windows and n_matched where enough of an item's windows are met."""
    sizes = wanted.groupBy("item_id").agg(F.count("*").alias("n_windows"))
    met = met.groupBy("doc_id", "key", "item_id").agg(F.count_distinct("hash").alias("n_matched"))
    return met.join(sizes, "item_id").filter(F.col("n_matched") >= least * F.col("n_windows")).select("doc_id", "key", "item_id", "n_windows", "n_matched")


def _held(windows: DataFrame, rows: DataFrame, items: DataFrame, wanted: DataFrame, rule: Templates, scratch: Scratch) -> DataFrame:
    """Items whose windows are met, along alignments whose slots agree."""
    ids, three = ["doc_id", "key"], ["doc_id", "key", "item_id"]
    met = scratch.written(windows.distinct(), "met")
    held = scratch.written(_shared(met, wanted, rule.least_share), "candidates")
    few = small_or_shuffled(scratch.written(_named(held, ids), "few"), rule.most_broadcast)
    of_docs = slots(rows.join(few, _same(rows, few, ids), "left_semi").dropDuplicates(ids), ids).withColumnRenamed("value", "doc_value")
    of_items = slots(items, ["item_id"]).withColumnsRenamed({"at": "item_at", "value": "item_value"})
    sure = _named(held, three)
    aligned = met.join(sure, _same(met, sure, three), "left_semi").withColumn("shift", F.col("at") - F.col("item_at"))
    pairs = aligned.select(*three, "shift").distinct().join(of_items, "item_id").withColumn("at", F.col("item_at") + F.col("shift"))
    d = of_docs.select(*(F.col(n).alias(f"r_{n}") for n in (*ids, "at", "kind")), "doc_value")
    filled = pairs.join(d, _same(pairs, d, [*ids, "at", "kind"]))
    values = filled.groupBy(*three, "shift", "kind", "item_value").agg(F.countDistinct("doc_value").alias("n"))
    agree = values.groupBy(*three, "shift").agg(F.avg((F.col("n") == 1).cast("double")).alias("agree"))
    bad = _named(agree.filter(F.col("agree") < rule.least_consistent), [*three, "shift"])
    return _shared(aligned.join(bad, _same(aligned, bad, [*three, "shift"]), "left_anti"), wanted, rule.least_share)


def _spelled(windows: DataFrame, rows: DataFrame, items: DataFrame, wanted: DataFrame, rule: Templates, scratch: Scratch) -> DataFrame:
    """Items all of whose plain windows are met, and whose whole token sequence stands in the document."""
    ids = ["doc_id", "key"]
    held = scratch.written(_shared(windows.select(*ids, "item_id", "hash").distinct(), wanted, 1.0), "spelled")
    few = small_or_shuffled(scratch.written(_named(held, ids), "few"), rule.most_broadcast)
    line = lambda text: F.concat(F.lit(" "), F.array_join(plain_tokens(text), " "), F.lit(" "))
    texts = rows.join(few, _same(rows, few, ids), "left_semi").dropDuplicates(ids).select(F.col("doc_id").alias("r_doc_id"), F.col("key").alias("r_key"), line(F.col("_t")).alias("_line"))
    own = items.select("item_id", line(F.col("_t")).alias("_item"))
    return held.join(texts, _same(held, texts, ids)).join(own, "item_id").filter(F.contains("_line", "_item")).select(*held.columns).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, rule: Templates = Templates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows, n_matched: the result of `matches` by doc_id."""
    return matches(docs, benchmark, rule, id_col, text_col).drop("key").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, rule: Templates = Templates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns, whatever their names."""
    doc, key = fresh_names(docs, "doc", "key")
    bad = matches(docs, benchmark, rule, id_col, text_col).select(F.col("doc_id").alias(doc), F.col("key").alias(key)).distinct()
    few = small_or_shuffled(written(bad, "contaminated"), rule.most_broadcast)
    return docs.join(few, F.col(id_col).eqNullSafe(F.col(doc)) & (text_key(F.col(text_col)) == F.col(key)), "left_anti")
