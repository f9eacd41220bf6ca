"""Each stage of the pipeline against a brute-force version, on what its predecessor kept."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_secrets import brute as brute_spans
from test_simhash import brute_components, brute_fingerprint


def rows(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [(9001, None, "en", "s", 0), (9002, "123 456", "en", "s", 7), (9003, "password=abcdef1 is in this text of some words", None, "s", 0), (9004, "", "de", None, 0), (None, "these words have no id and no source", None, None, None)]
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more.select(*(F.col(f.name).cast(f.dataType) for f in docs.schema)))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf_dir).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_columns(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert after.columns == before.columns


def test_language(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert set(before) - set(after) == {9001, 9002, 9004}
    assert after[9003].lang is not None and all(after[i].text == before[i].text for i in after)


def test_near_duplicates(stages):
    before, after = rows(stages[1]), rows(stages[2])
    fps = {i: brute_fingerprint(r.text) for i, r in before.items()}
    roots = brute_components(list(fps.values()))
    first = {}
    for i in sorted(fps, key=lambda i: (i is None, i)):
        first.setdefault(roots[fps[i]], i)
    assert set(after) == set(first.values()) and len(after) < len(before)


def test_decontamination(spark, sf_dir, stages):
    before, after = rows(stages[2]), rows(stages[3])
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    windows = lambda t: {tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)}
    items = [windows(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    own = {i: windows(r.text) for i, r in before.items()}
    assert set(before) - set(after) == {i for i, w in own.items() if any(h and len(w & h) >= 0.8 * len(h) for h in items)}


def test_secrets(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for i, r in after.items():
        spans = brute_spans(before[i].text)
        text, at = "", 0
        for start, _, end, _ in spans:
            if start >= at:
                text += before[i].text[at:start] + "[SECRET]"
            at = max(at, end)
        text += before[i].text[at:]
        if not re.search(r"[A-Za-z0-9+/_-]{20,}", text):  # no opaque strings beside the base ones
            assert r.text == text
        assert r.n_chars == len(r.text) and not brute_spans(r.text)
    assert "[SECRET]" in after[9003].text


def test_tokens(stages):
    from tidemark.llm import sentencepiece as sp

    v = sp.load()
    before, after = rows(stages[4]), rows(stages[5])
    assert set(before) == set(after)
    for i, r in after.items():
        assert sp.decoded(r.ids, v) == before[i].text and r.n_ids == len(r.ids)


def test_run(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in stages[5].collect()} - {9003, None}


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_edges_and_clashing_columns(spark, sf_dir):
    """Long and repeated rows, null columns, and column names that the operators use themselves."""
    long = "une phrase assez longue pour tout le monde ici " * 3000
    rows = [(1, long, None, None), (2, "der hund und die katze password=abcdef1 sind hier im haus und im garten", "de", "s"), (2, "der hund und die katze password=abcdef1 sind hier im haus und im garten", "de", "s"), (None, "el perro y el gato viven en la casa grande", "es", None), (3, None, None, None), (4, "", None, "s")]
    names = ("score", "lang_pred", "spans", "_found", "_key", "_doc", "_spans", "_none", "_id", "_again", "key", "fp", "root", "ids", "exact", "hash", "item_id", "n")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*r, 0, *names) for r in rows], schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        kept[name] = sorted(str(r.doc_id) for r in out.collect())
        if name != "sentencepiece":
            assert out.columns == docs.columns
            assert all(r[n] == n for r in out.collect() for n in names)
    assert kept["language_id"] == ["1", "2", "2", "None"] and kept["near_duplicates"] == ["1", "2", "3", "None"]
    assert kept["decontaminate"] == kept["secrets"] == kept["sentencepiece"] == sorted(str(r[0]) for r in rows)
    assert not any("abcdef1" in (r.text or "") for r in corpus_pipeline.secret_scan(spark, docs, sf_dir).collect())
