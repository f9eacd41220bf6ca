import re
from collections import Counter

from tidemark.llm import quality

SCHEMA = "doc_id long, text string, source string, host string, n_words int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(1, None), (2, ""), (3, " \n\n "), (4, "a b"), (5, "a b c"), (None, "a a a a"), (7, "x y z x y z  x y z\nq\nq\n q"), (7, "same"), (7, "same"), (8, "n w " * 30_000), (9, "é é #\x1c")]
    rows = [(i, t, "s", "other", 3) for i, t in docs]
    got = quality.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    have = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert have == Counter((i, *brute(t)) for i, t in docs)
    assert quality.judged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hosts(spark):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(i, "short", "bad", "h", 0) for i in range(40)] + [(100 + i, good, "bad", "h", 0) for i in range(2)]
    rows += [(1000 + 100 * h + i, good if i else "short", f"h{h}", "h", 0) for h in range(6) for i in range(20)]
    rows += [(5000, good, None, "h", 0), (5001, "short", "tiny", "h", 0), (5002, good, "tiny", "h", 0)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert not got[100].kept and not got[100].base_failed and got[100].host_rate > 0.6
    assert got[1001].kept and got[5000].kept and not got[1000].kept
    assert got[5001].host_rate < 0.5 and got[5002].kept  # two rows don't condemn a host


def test_hosts_are_judged_against_the_corpus(spark):
    """A host that fails a few times as often as the others goes, whatever the level; hosts that are alike stay."""
    good = " ".join(f"w{k}" for k in range(60))
    text = lambda i, every: "short" if i % every == 0 else good
    alike = [(1000 * h + i, text(i, 10), f"h{h}", "", 0) for h in range(8) for i in range(300)]
    got = quality.judged(spark.createDataFrame(alike, SCHEMA)).collect()
    assert all(r.kept != r.base_failed for r in got)
    worse = alike + [(90_000 + i, text(i, 2), "worse", "", 0) for i in range(300)] + [(95_000 + i, text(i, 2), "few", "", 0) for i in range(4)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(worse, SCHEMA)).collect()}
    assert not got[90_001].kept and 0.4 < got[90_001].host_rate < 0.5 and got[1001].kept and got[95_001].kept
    assert got[90_001].host_low < got[90_001].host_rate
    clean = [(1000 * h + i, text(i, 100), f"h{h}", "", 0) for h in range(8) for i in range(400)] + [(90_000 + i, text(i, 8), "worse", "", 0) for i in range(400)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(clean, SCHEMA)).collect()}
    assert not got[90_001].kept and got[1001].kept
    same = quality.judged(spark.createDataFrame([(i, "short", f"h{i % 3}", "", 0) for i in range(30)] , SCHEMA)).collect()
    assert {r.kept for r in same} == {False} and {round(r.host_rate, 6) for r in same} == {1.0}
