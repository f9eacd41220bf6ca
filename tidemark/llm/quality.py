"""Quality rules on documents, and on the hosts that publish them.

Text rules count words, symbols, repeated lines and repeated word windows. A
host's rule failures are then summed, its failure rate is shrunk towards the
rate of all hosts by a beta prior fitted to the hosts themselves (method of
moments), and a host loses all its documents if even the lower end of what its
rate may be is far from the rate of all hosts: nothing absolute is asked, so a
clean corpus rejects a host at a few per cent of failures, a bad one only far
above. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import SPACE, written

#: Characters of the symbol rule.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A host is rejected if the odds of its failure rate, at its lower end, are over so many times the corpus' odds.
    max_odds_ratio: float = 3.0
    #: The lower end is so many standard deviations of the posterior under its mean.
    deviations: float = 2.0
    #: Bounds of the prior's weight, in documents.
    least_weight: float = 2.0
    most_weight: float = 1000.0


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def text_counts(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """`keep`, and the counts of every text (null: as an empty one).

    A repeated window is found by sorting the text's window hashes; positions
    are sorted along only where some window repeats.
    """
    names = [docs.select(c).columns[0] for c in keep]
    body = F.coalesce(text, F.lit(""))
    base = docs.select(*keep, body.alias("_t")).select(
        *names,
        F.array_remove(F.split("_t", SPACE), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0).alias("_lines"),
        F.length(F.translate("_t", WHITE, "")).cast("long").alias("word_chars"),
        _without(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
    )
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_w") - 3),
        lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
    )
    hashed = base.select(
        *names, "word_chars", "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= 3, windows).alias("_h"),
    )
    some = hashed.withColumn("_any", F.size(F.array_distinct("_h")) < F.size("_h"))
    placed = some.withColumn("_p", F.when(F.col("_any"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    hit = F.filter(
        "_p",
        lambda x, i: (F.get("_p", i - 1)["h"] == x["h"]) | (F.get("_p", i + 1)["h"] == x["h"]),
    )
    starts = placed.withColumn("_at", F.transform(hit, lambda x: x["i"]))
    covered = F.size(F.array_distinct(F.concat("_at", F.transform("_at", lambda i: i + 1), F.transform("_at", lambda i: i + 2))))
    return starts.select(
        *names, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("_any"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def beta_prior(hosts: DataFrame, rules: QualityRules) -> tuple[float, float]:
    """(failures, documents) that the prior adds to each host's counts.

    From sums over `hosts` (n, failed) alone: the variance between hosts beyond
    what their sizes explain gives the weight. No hosts: (0, least_weight).
    """
    n, f = F.col("n"), F.col("failed")
    sums = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff"), F.count("*").alias("hosts")).first()
    if not sums.n:
        return 0.0, rules.least_weight
    mean = sums.f / sums.n
    spread = mean * (1 - mean)
    between = (sums.ff / sums.n - mean * mean) - spread * sums.hosts / sums.n
    weight = spread / between - 1 if between > 0 else rules.most_weight
    weight = min(max(weight, rules.least_weight), rules.most_weight)
    return mean * weight, weight


def judged(
    docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """doc_id, counts, base_failed, kept, host_rate and host_low (the lower end) of every row.

    Null texts count as empty and fail; rows without host form a host of their
    own; rows without doc_id, repeated rows and further columns are nothing
    special. An empty table gives an empty result.
    """
    counts = text_counts(docs, F.col(text_col), [F.col(id_col).alias("doc_id"), F.col(host_col).alias("host")])
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    rows = written(counts.withColumn("base_failed", failed), "quality")
    hosts = written(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    more_failed, more = beta_prior(hosts, rules)
    rate, weight = (F.col("failed") + more_failed) / (F.col("n") + more), F.col("n") + more
    low = F.greatest(rate - rules.deviations * F.sqrt(rate * (1 - rate) / (weight + 1)), F.lit(0.0))
    verdicts = hosts.select(F.col("host").alias("_host"), rate.alias("host_rate"), low.alias("host_low"))
    mean = more_failed / more
    # Odds without a division: low / (1 - low) against mean / (1 - mean).
    far = F.col("host_low") * (1 - mean) > rules.max_odds_ratio * mean * (1 - F.col("host_low"))
    return rows.join(verdicts, F.col("host").eqNullSafe(F.col("_host"))).withColumn("kept", ~F.col("base_failed") & ~far).drop("_host")
