"""Chat formatting in budgeted windows.

A conversation's turns are laid out in windows of at most `budget` tokens. A
window holds the system turns, some history, and its own turns:

* Own turns come from prefix sums of turn tokens. Turns of over half the room
  stand alone; runs of shorter turns are cut where their prefix sum passes a
  multiple of the room less the run's longest turn, so every window fits unless
  a single turn doesn't.
* History is the turns just before, as far back as `history` tokens reach. It
  is masked: its targets count in the window that owns them.
* The loss mask has the assistant texts among a window's own turns: each once
  over all windows.

A turn reads ``<s>[role]text</s>``. Inside roles and texts the characters
``\\ < [ ]`` are written ``\\s \\l \\b \\e``, so no text can hold a control
string, and reading it back is exact. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import SPACE

#: What stands around a turn, and the escapes in the order that writes them.
OPEN, MIDDLE, CLOSE = "<s>[", "]", "</s>"
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"), ("]", "\\e"))
#: Tokens that a turn's marks count as.
MARK_TOKENS = 4


@dataclass(frozen=True)
class Windows:
    budget: int = 512
    history: int = 128
    system_role: str = "system"
    target_role: str = "assistant"


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def token_count(text: Column) -> Column:
    """Words, and the marks of the turn: what the budget counts."""
    return F.size(F.array_remove(F.split(text, SPACE), "")) + MARK_TOKENS


def spans(turns: DataFrame, rule: Windows) -> DataFrame:
    """Turns (conv_id, turn, role, text) with their place n and their window.

    `first` and `last` are the first and last turn that the window owns, `back`
    is the first turn whose distance in tokens the history reaches. System
    turns stand in every window.
    """
    by = Window.partitionBy("conv_id")
    sofar = by.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    sized = (
        turns.withColumn("n", F.row_number().over(by.orderBy("turn", "role", "text")) - 1)
        .withColumn("system", F.col("role") == rule.system_role)
        .withColumn("tokens", token_count(F.col("text")).cast("long"))
        .withColumn("own_tokens", F.when(~F.col("system"), F.col("tokens")).otherwise(0))
        .withColumn("room", F.greatest(F.lit(1), rule.budget - rule.history - F.sum(F.col("tokens") - F.col("own_tokens")).over(by)))
        .withColumn("long", (F.col("own_tokens") * 2 > F.col("room")).cast("int"))
        .withColumn("before", F.sum("own_tokens").over(sofar) - F.col("own_tokens"))
    )
    # A long turn opens a run, and so does what follows it; a system turn never does.
    follows = F.coalesce(F.lag("long").over(Window.partitionBy("conv_id", "system").orderBy("n")), F.lit(0))
    runs = sized.withColumn("opens", F.when(F.col("system"), 0).otherwise(F.col("long") + follows)).withColumn("run", F.sum("opens").over(sofar))
    run = Window.partitionBy("conv_id", "system", "run")
    return (
        runs.withColumn("stride", F.greatest(F.lit(1), F.col("room") - F.max("own_tokens").over(run)))
        .withColumn("cut", F.floor((F.col("before") - F.min("before").over(run)) / F.col("stride")))
        .withColumn("first", F.min("n").over(Window.partitionBy("conv_id", "system", "run", "cut")))
        .withColumn("last", F.max("n").over(Window.partitionBy("conv_id", "system", "run", "cut")))
        .withColumn("back", F.min(F.when(~F.col("system"), F.col("n"))).over(by.orderBy("before").rangeBetween(-rule.history, 0)))
    )


def windows(conversations: DataFrame, rule: Windows = Windows()) -> DataFrame:
    """conv_id, window, formatted and turns of every window.

    `turns` has, for each turn in the window, its place in the conversation,
    the code points where its text starts and ends in `formatted`, whether the
    text is a target here and whether the window owns the turn. A conversation
    of system turns alone has one window. Turns are ordered by (turn, role,
    text), nulls first; null roles and texts are empty; a null conv_id names a
    conversation; repeated rows are turns like others; other columns don't
    matter. An empty table gives an empty result. Each window is gathered by
    itself, so a conversation may have any number of turns.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = Window.partitionBy("conv_id")
    head = ~F.col("system") & (F.col("n") == F.col("first"))
    at = spans(turns, rule).withColumn("mine", F.sum(head.cast("int")).over(by.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    # A turn stands in its own window and, as history, in those whose heads are within reach; a system turn in all.
    reach = F.greatest("mine", F.max(F.when(head, F.col("mine"))).over(by.orderBy("before").rangeBetween(0, rule.history)))
    last = F.greatest(F.lit(0), F.max("mine").over(by))
    places = F.when(F.col("system"), F.sequence(F.lit(0).cast("long"), last.cast("long"))).otherwise(F.sequence("mine", reach))
    placed = at.withColumn("places", places)
    each = placed.select("conv_id", "n", "system", "role", "text", "mine", F.explode("places").alias("window"))
    mine = F.when(F.col("system"), F.col("window") == 0).otherwise(F.col("window") == F.col("mine"))
    turn = F.struct(
        (~F.col("system")).alias("spoken"), "n", escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"), mine.alias("own"),
        (~F.col("system") & mine & (F.col("role") == rule.target_role)).alias("target"),
    )
    laid_out = each.groupBy("conv_id", F.col("window").cast("int").alias("window")).agg(F.array_sort(F.collect_list(turn)).alias("shown"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<n:int,start:int,end:int,target:boolean,own:boolean>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["role"]) + len(OPEN + MIDDLE)
        end = start + F.length(x["text"])
        place = F.struct(x["n"].alias("n"), start.alias("start"), end.alias("end"), x["target"].alias("target"), x["own"].alias("own"))
        return F.struct((end + len(CLOSE)).alias("at"), F.concat(acc["out"], F.array(place)).alias("out"))

    return laid_out.select(
        "conv_id", "window",
        F.array_join(F.transform("shown", lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(MIDDLE), x["text"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("shown", zero, step, lambda acc: acc["out"]).alias("turns"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted and `read` of every window: the turns that it owns.

    A turn has its place n, role, text and, if it is one, target. Roles and
    texts come from `formatted` alone, by its marks; targets by the mask's code
    points.
    """
    parts = F.filter(F.split("formatted", CLOSE, -1), lambda x: x != "")
    both = F.filter(F.zip_with(parts, "turns", lambda p, t: F.struct(p.alias("part"), t.alias("turn"))), lambda x: x["turn"]["own"])

    def turn(x: Column) -> Column:
        body = F.substring(x["part"], F.lit(len(OPEN) + 1), F.length(x["part"]))
        at = x["turn"]
        masked = F.substring("formatted", at["start"] + 1, at["end"] - at["start"])
        return F.struct(
            at["n"].alias("n"),
            unescaped(F.split_part(body, F.lit(MIDDLE), F.lit(1))).alias("role"),
            unescaped(F.split_part(body, F.lit(MIDDLE), F.lit(2))).alias("text"),
            F.when(at["target"], unescaped(masked)).alias("target"),
        )

    return formatted.select("conv_id", "formatted", F.transform(both, turn).alias("read"))


def digest(conversations: DataFrame, rule: Windows = Windows()) -> DataFrame:
    """One row a conversation, of what reading its windows back gives."""
    read = (
        read_back(windows(conversations, rule))
        .groupBy("conv_id")
        .agg(F.array_sort(F.flatten(F.collect_list("read"))).alias("t"), F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    )
    target = F.array_join(F.transform("t", lambda x: F.coalesce(x["target"], F.lit(""))), "")
    turns = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("t").cast("long").alias("n_turns"), turns.alias("turns"), target.alias("loss"), "formatted_chars").select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
