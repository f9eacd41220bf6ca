"""A global order without a global sort: sampled splitters, ranges, and every row's place.

Keys are drawn with chances in proportion to their rows' weight, the quantiles
of the draw become boundaries, and rows are put into the ranges between them.
Ranges that turn out to hold too many rows are divided further by keys drawn
from them alone. Sums of the ranges then tell where each one begins, and a
window within a range tells the rest. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import Scratch


@dataclass(frozen=True)
class Ranges:
    #: Rows that a range should have, and ranges at most before some are divided: boundaries are held by the driver and every task.
    rows: int = 200_000
    most: int = 8192
    #: Keys drawn for each range.
    draws: int = 24
    #: A range is overfull with so many times its share of rows.
    overfull: float = 2.0
    seed: int = 11


def boundaries(rows: DataFrame, order: Sequence[str], weight: Column, total: Column, parts: Column, rule: Ranges, within: Sequence[str] = ()) -> DataFrame:
    """`key`: first keys of the parts of nearly equal weight, of all rows or of each group `within`.

    A key is drawn by a hash of itself, so the draw is the same when a task
    runs again. About draws keys for each part are sorted; no row is left out
    of what follows from them.
    """
    share = total / (parts * rule.draws)
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(rule.seed), *order), 11) / float(1 << 53)
    drawn = rows.withColumn("_share", share).filter(unit < weight / F.col("_share"))
    by = Window.partitionBy(*within)
    held = drawn.select(*within, *order, F.greatest(weight, F.col("_share")).alias("_weight"), parts.alias("_parts"))
    before = F.sum("_weight").over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_weight")
    part = F.floor(before * F.col("_parts") / F.sum("_weight").over(by))
    return held.withColumn("_part", part).filter("_part > 0").groupBy(*within, "_part").agg(F.min(F.struct(*order)).alias("key")).select("key")


def number(rows: DataFrame, order: Sequence[str], keys: DataFrame) -> tuple[Column, int]:
    """How many of `keys` are not after a row's key, by bisection in an array of them; and how many there are.

    The array has `most` keys and those of divided ranges: it is read by the
    driver and goes with the plan, as a constant.
    """
    got = keys.agg(F.to_json(F.array_sort(F.collect_set("key"))).alias("keys"), F.count_distinct("key").alias("n")).first()
    if not got.n:
        return F.lit(0), 0
    kind = rows.select(F.array(F.struct(*order))).schema[0].dataType
    sorted_keys, key = F.from_json(F.lit(got["keys"]), kind), F.struct(*order)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(got.n.bit_length()))))
    taken = lambda at, step: (at + step <= got.n) & (F.get(sorted_keys, at + step - 1) <= key)
    return F.reduce(steps, F.lit(0), lambda at, step: F.when(taken(at, step), at + step).otherwise(at)), got.n


def positions(rows: DataFrame, order: Sequence[str], scratch: Scratch, weight: str | None = None, rule: Ranges = Ranges()) -> DataFrame:
    """`order` columns, weight_before and rows_before of every row, in ascending order (nulls first), as a table's rows.

    `order` names all columns that tell rows apart, and `weight` (a column of
    whole numbers of them; default 1 each) what the splitters make equal. Rows
    that are equal in all are counted before anything is shuffled and are
    repeated at the end, each with a place of its own. An empty table stays
    empty. What comes back is lazy and reads tables of `scratch`.
    """
    weigh = F.lit(1) if weight is None else F.col(weight)
    names = [*order, "_copies"]
    counted = scratch.written(rows.groupBy(*order).agg(F.count("*").alias("_copies")), "counted")
    whole = weigh * F.col("_copies")
    sums = counted.agg(F.count("*").alias("rows"), F.sum(whole).alias("weight")).first()
    parts = max(1, min(rule.most, -(-sums.rows // rule.rows)))
    limit = max(rule.rows, sums.rows / parts) * rule.overfull
    keys = scratch.written(boundaries(counted, order, whole, F.lit(sums.weight or 1), F.lit(parts), rule), "keys")
    while True:
        of, n = number(counted, order, keys)
        ranged = counted.withColumn("_range", of)
        sizes = scratch.written(ranged.groupBy("_range").agg(F.count("*").alias("_rows"), F.sum("_copies").alias("_n"), F.sum(whole).alias("_w")), "sizes")
        full = sizes.filter(F.col("_rows") > limit)
        if full.isEmpty():
            break
        pieces = F.ceil(2 * F.col("_rows") / limit)
        inside = ranged.join(F.broadcast(full.select("_range", "_rows")), "_range")
        keys = scratch.written(keys.union(boundaries(inside, order, F.lit(1), F.col("_rows"), pieces, rule, ("_range",))).distinct(), "keys")
        if number(counted, order, keys)[1] == n:
            break
    # One row a range: their running sums are small.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("_n", "_w")))
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = lambda c: F.coalesce(F.sum(c).over(inner), F.lit(0))
    placed = ranged.join(F.broadcast(starts), "_range").withColumn("_whole", whole).select(
        *names, weigh.alias("_weight"), (F.col("_n0") + within("_copies")).alias("_n"), (F.col("_w0") + within("_whole")).alias("_w")
    )
    each = placed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    return each.select(*order, (F.col("_w") + F.col("_copy") * F.col("_weight")).alias("weight_before"), (F.col("_n") + F.col("_copy")).alias("rows_before"))
