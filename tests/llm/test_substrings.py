import random
import re

from tallywright.llm import substrings

SCHEMA = "doc_id long, text string, bucket int, cells string"


def brute(rows, window):
    docs = [(i, re.findall(r"[^ \t-\r]+", t or "")) for i, t in rows]
    least = {}
    for i, w in docs:
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            least[key] = min(least.get(key, float("inf")), float("inf") if i is None else i)
    out = []
    for i, w in docs:
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p:p + window])] < (float("inf") if i is None else i):
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def run(spark, rows, window=13):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.dedup_substrings(df, window=window).collect()), key=str)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 500)
    rng = random.Random(9)
    words = ["a", "B", "b", "ß", "word", "漢字", "x.y", "c"]
    passages = [[rng.choice(words) for _ in range(rng.randrange(4, 40))] for _ in range(12)]
    rows = [(None, " ".join(passages[0])), (3, None), (4, ""), (5, " \n\t"), (6, "one two")]
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randrange(20))] for _ in range(rng.randrange(1, 6))]
        rows.append((rng.randrange(10, 90), rng.choice([" ", "\n", "  "]).join(" ".join(p) for p in parts)))
    rows += [(95, rows[20][1])] * 3
    rng.shuffle(rows)
    for window in (5, 13):
        assert run(spark, rows, window) == brute(rows, window)


def test_one_window_in_every_document_and_one_long_text(spark):
    shared = " ".join(f"s{i}" for i in range(15))
    rows = [(i, f"own{i} {shared} tail{i}") for i in range(300)] + [(1000, "w " * 50_000)]
    got = {r[0]: r for r in run(spark, rows)}
    assert got[0][2] == 0 and all(got[i][2:] == (15, f"own{i} tail{i}") for i in range(1, 300))
    assert got[1000][2] == 0


def test_empty_table(spark):
    assert run(spark, []) == []


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_words_whose_hashes_agree_modulo_powers_of_two(spark):
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{one} {rest}")]
    assert run(spark, rows) == brute(rows, 13)
    assert [r[2] for r in run(spark, rows)] == [0, 0, 13]
