import random
import re

from tallywright.llm import decontaminate as dc

SCHEMA = "doc_id long, text string, item string, n_hit int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(text, items, window=10):
    """(n_words, n_hit, item ids) by comparing every window with every place."""
    doc, hit, names = words(text), set(), set()
    for name, item in items:
        own = words(item)
        n = min(window, len(own))
        for i in range(len(own) - n + 1) if own else ():
            for p in range(len(doc) - n + 1):
                if doc[p:p + n] == own[i:i + n]:
                    hit.update(range(p, p + n))
                    names.add(name or "")
    return len(doc), len(hit), sorted(names)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "c3", "Ωmega", "the", "of", "naïve", "x"]
    draw = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"b{i:02d}", draw(rng.randrange(1, 40))) for i in range(12)] + [("none", None), ("blank", "..."), (None, draw(12)), ("b00", "a second text under one id " * 3)]
    docs = [(0, None), (1, ""), (2, "!!"), (2, draw(30)), (None, draw(20)), (3, items[0][1]), (4, items[5][1].upper() + ", " + draw(5)), (5, items[0][1] + " " + items[0][1]), (6, "tail " * 4_000 + items[3][1])]
    docs += [(10 + i, draw(5) + "; " + " ".join(words(items[i % 12][1])[i % 3:]) + " " + draw(8)) for i in range(40)]
    frame = spark.createDataFrame([(i, t, "clash", 7) for i, t in docs], SCHEMA)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, extra int")
    for limit in (500_000, 0):
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_hit"], r["items"]) for r in dc.decontaminate(frame, bench, broadcast_fingerprints=limit).collect())
        assert got == sorted((i if i is not None else -1, *brute(t, items)) for i, t in docs)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert [(r["n_words"], r["n_hit"]) for r in dc.decontaminate(docs, none).collect()] == [(3, 0)]
    assert dc.decontaminate(docs.limit(0), none).collect() == []


def test_spans_leave_the_text_with_the_words_between_them(spark):
    df = spark.createDataFrame([("one, two three; four", [{"start": 1, "end": 3}])], "text string, spans array<struct<start:int,end:int>>")
    assert df.select(dc.without_spans(df.text, df.spans)).first()[0] == "one, ; four"


def test_texts_of_one_repeated_word(spark):
    docs = spark.createDataFrame([(1, "yes " * 20_000), (2, "no yes no"), (3, "yes " * 9)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "yes " * 50), ("b", "no"), ("c", "Yes")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in dc.decontaminate(docs, bench).collect()}
    assert got == {1: (20_000, 20_000, ["a", "c"]), 2: (3, 3, ["b", "c"]), 3: (9, 9, ["c"])}


def test_rows_without_id_are_matched_one_by_one(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve "
    docs = [(None if i % 2 else 7, f"w{i} " * 3 + passage * (i % 3) + f"v{i}") for i in range(600)] + [(None, passage)] * 50
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([("a", passage), ("b", passage * 2)], "item_id string, text string")
    for limit in (500_000, 0):
        got = sorted((r["n_words"], r["n_hit"], r["items"]) for r in dc.decontaminate(frame, bench, broadcast_fingerprints=limit).collect())
        assert got == sorted(brute(t, [("a", passage), ("b", passage * 2)]) for _, t in docs)
