from collections import defaultdict

import regex

from tidemark.llm import decontaminate as d

DOCS = "doc_id long, text string, item_id string, key int"
ITEMS = "item_id long, text string, doc_id int"
ITEM = "a train with Maria leaves for the far town at 5 km every hour and Maria pays 12 dollars, so how much does Maria pay in 7 hours of travel along that line"


def found(spark, docs, items):
    got = d.contaminated(spark.createDataFrame([(*x, "c", 1) for x in docs], DOCS), spark.createDataFrame([(*x, 1) for x in items], ITEMS))
    return sorted((str(r.doc_id), r.item_id) for r in got.collect())


def test_copies_and_other_parameters(spark):
    pad = "some words before it and "
    other = ITEM.replace("Maria", "Anton").replace("5", "6,5").replace("12", "99").replace("7", "8").replace("km", "miles")
    docs = [
        (1, pad + ITEM + " and after"), (2, pad + other), (4, pad + ITEM[:60]), (5, None), (6, ""), (None, ITEM), (1, pad + ITEM + " and after"),
        (7, pad * 3000 + ITEM), (8, pad + ITEM.upper()), (9, ITEM.replace("far", "near").replace("much", "often")), (10, ITEM + ". " + other), (1, "clean text under an id that was used"),
    ]
    assert found(spark, docs, [(20, ITEM), (21, None), (22, "too short here"), (23, ""), (24, " -- ")]) == sorted([("1", 20), ("2", 20), ("None", 20), ("7", 20), ("10", 20)])
    assert found(spark, [], [(20, ITEM)]) == [] and found(spark, docs, []) == []


def test_slots_must_agree(spark):
    item = "it is known that Maria told us how Maria went with old friends to see where Maria lived before, and what Maria did there"
    torn = item
    for name in ("Anton", "Berta", "Carla"):
        torn = torn.replace("Maria", name, 1)
    docs = [(1, "so " + item), (2, "so " + item.replace("Maria", "Anton")), (3, "so " + torn), (4, torn + ". so " + item.replace("Maria", "Anton"))]
    assert found(spark, docs, [(20, item)]) == [("1", 20), ("2", 20), ("4", 20)]


def test_clean_keeps_the_rest(spark):
    rows = [(1, ITEM, "c", 1), (1, "clean text", "c", 1), (None, None, "c", 1), (None, ITEM, "c", 1), (2, "clean text", "c", 1), (2, "clean text", "c", 1)]
    got = d.clean(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(20, ITEM, 1)], ITEMS))
    assert got.columns == ["doc_id", "text", "item_id", "key"]
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted([("1", "clean text"), ("None", "None"), ("2", "clean text"), ("2", "clean text")])


def test_against_brute_force(spark, sf_dir):
    """Plain sets of five-word windows find the same documents where nothing was re-parameterised."""
    import re

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    windows = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    held = {i.item_id: windows(words(i.text)) for i in items}
    want = {(r.doc_id, i) for r in docs for own in [windows(words(r.text))] for i, h in held.items() if h and len(own & h) >= 0.8 * len(h)}
    got = d.contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()
    assert want and {(r.doc_id, r.item_id) for r in got} == want


def units():
    return "|".join(sorted(d.UNITS, key=len, reverse=True))


def brute_tokens(text):
    """Template tokens with the value of each placeholder, by one pass over the text's own pieces."""
    text = regex.sub(r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}+", lambda m: f" \3<{m[0]}> ", text)
    held = regex.findall(r"\x03<([^>]*)>", text)
    text = regex.sub(r"\x03<[^>]*>", " \3 ", text)
    number = r"\p{N}+(?:[.,]\p{N}+)*"
    values = {"\3": held, "\1": regex.findall(number, text), "\2": [m[2] for m in regex.finditer(f"({number}) ?((?i:{units()})\\b|[%°€$£])", text)]}
    text = regex.sub(f"{number} ?((?i:{units()})\\b|[%°€$£])", " \1 \2 ", text)
    text = regex.sub(number, " \1 ", text)
    out, turn = [], defaultdict(int)
    for t in regex.findall(r"[\p{L}\p{M}\x01-\x03]+", text.lower()):
        out.append((t, values[t][turn[t]] if t in values else None))
        turn[t] += t in values
    return out


def brute(docs, items, window=5, words=3, share=0.8):
    """(doc, item) of what `contaminated` must find: (number, text) each."""

    def windows(tokens):
        names = [t for t, _ in tokens]
        every = [(i, tuple(names[i : i + window])) for i in range(len(names) - window + 1)]
        return [(i, w) for i, w in every if sum(t not in "\1\2\3" for t in w) >= words]

    out = set()
    own = {n: brute_tokens(t) for n, t in docs if t is not None}
    plain = {n: regex.findall(r"[\p{L}\p{M}\p{N}]+", t.lower()) for n, t in docs if t is not None}
    for item, text in items:
        if text is None:
            continue
        tokens = brute_tokens(text)
        first = {}
        for i, w in windows(tokens):
            first.setdefault(w, i)
        for n in own:
            if not first:
                bare = regex.findall(r"[\p{L}\p{M}\p{N}]+", text.lower())
                if bare and any(plain[n][i : i + len(bare)] == bare for i in range(len(plain[n]) - len(bare) + 1)):
                    out.add((n, item))
                continue
            met = [(i - first[w], w) for i, w in windows(own[n]) if w in first]
            if len({w for _, w in met}) < share * len(first):
                continue
            good = set()
            for shift in {s for s, _ in met}:
                values = defaultdict(set)
                for i, (kind, value) in enumerate(tokens):
                    if kind in "\1\2\3" and 0 <= i + shift < len(own[n]) and own[n][i + shift][0] == kind:
                        values[kind, value].add(own[n][i + shift][1])
                if not values or sum(len(v) == 1 for v in values.values()) >= 0.8 * len(values):
                    good.add(shift)
            if len({w for s, w in met if s in good}) >= share * len(first):
                out.add((n, item))
    return out


def test_whole_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [(i.item_id, i.text) for i in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    sum_, names, short = "If 12 + 30 * 4 = x, 7 - 2 = 5", "they are Anna Berta Carla Dora and Emil", "why not now"
    other = "they are Franz Georg Hans Iris and Jan"
    items += [(900, ITEM), (901, sum_), (902, names), (903, short), (904, "1, 2, 3, 4, 5, 6, 7"), (905, "?!"), (906, "是谁写的这本书呢"), (907, "ha ha ha ha ha ha ha ha")]
    pad = "some words before it and then "
    docs += [
        (9001, pad + sum_ + " it is"), (9002, pad + sum_.replace("12", "13")), (9003, pad + names), (9004, pad + other), (9005, "So " + short + "?"), (9006, "why not. and now"),
        (9007, "0 1 2 3 4 5 6 7 8"), (9008, "1 2 3 4 5 6"), (9009, pad + ITEM.replace("Maria", "Anton").replace("12", "13")), (9010, pad + ITEM.replace("Maria", "Anton", 1)),
        (9011, "昨天是谁写的这本书呢我忘了"), (9012, "昨天谁写的这本书"), (9013, "ha " * 5000), (9014, None), (9015, ""), (9016, pad * 4000 + sum_),
    ]
    spaced = lambda rows: [(n, t and regex.sub(r"(\p{Han})", r" \1 ", t)) for n, t in rows]
    want = brute(spaced(docs), spaced(items))
    assert {(9001, 901), (9016, 901), (9003, 902), (9005, 903), (9007, 904), (9009, 900), (9011, 906), (9013, 907)} <= want
    assert not {n for n, _ in want} & {9002, 9004, 9006, 9008, 9012}
    frames = spark.createDataFrame([(*x, "c", 1) for x in docs], DOCS), spark.createDataFrame([(*x, 1) for x in items], ITEMS)
    assert {(r.doc_id, r.item_id) for r in d.contaminated(*frames).collect()} == want
    narrow = d.Templates(most_broadcast=64)  # shuffles, after a bitmap
    assert {(r.doc_id, r.item_id) for r in d.contaminated(*frames, narrow).collect()} == want


def test_items_without_id_and_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a " + ITEM, "c", 1), (2, "clean", "c", 1)], "doc_id long, text string, _doc string, _key int")
    items = spark.createDataFrame([(None, ITEM, 1), (5, "other text that is not there at all", 1), (5, ITEM, 1)], ITEMS)
    assert sorted(str(r.item_id) for r in d.contaminated(docs, items).collect()) == ["5", "None"]
    got = d.clean(docs, items)
    assert got.columns == docs.columns and [r.doc_id for r in got.collect()] == [2]
    assert d.clean(docs.limit(0), items).count() == 0 and d.clean(docs, items.limit(0)).count() == 2
