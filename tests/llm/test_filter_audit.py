import itertools
import random
import re

from tallywright.llm import filter_audit as fa

DOCS = "doc_id long, text string, source string, mask int, id string, part string"
LABELS = "doc_id long, quality int, toxic int, n string"


def brute(docs, labels):
    """{(part, order, step): figures}, a document at a time."""
    def failed(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {x for x, bad in {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }.items() if bad}

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, rows = {}, [(i, s or "", failed(i, t or "")) for i, t, s in docs]
    for part in {s for _, s, _ in rows}:
        own = [(i, f) for i, s, f in rows if s == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, x in enumerate(order, start=1):
                removed = [i for i, f in own if x in f and not f & set(order[:step - 1])]
                shapley[x] += len(removed)
                out[part, order, step] = (
                    sum(not f & set(order[:step]) for _, f in own), len(removed), sum(x in f and bool(f & set(order[:step - 1])) for _, f in own),
                    sum(f == {x} for _, f in own), sum(i in good for i in removed), sum(i in toxic for i in removed),
                )
        for order, step in [k[1:] for k in out if k[0] == part]:
            out[part, order, step] += (shapley[order[step - 1]],)
    return out


def audited(spark, docs, labels):
    frame = spark.createDataFrame([(i, t, s, 3, "x", "y") for i, t, s in docs], DOCS)
    marks = spark.createDataFrame([(*row, "z") for row in labels], LABELS)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in fa.audit(frame, marks).collect()}


def test_equals_brute_force(spark):
    rng = random.Random(11)
    long = " ".join(f"w{i}" for i in range(220))
    texts = [None, "", " \t\n", "short", "SHOUT", long, long + " SHOUTING" * 3, "a b " * 150, long + " #", "Große Wörter " * 120, "100 % sure | or not", long.upper(), "x" * 50_000, "a\x0bb\x0cc " * 80, "nb\u00a0sp " * 210]
    docs = [(i, rng.choice(texts), rng.choice(["web", "Web", "", None, "a'b"])) for i in range(120)]
    docs += [(None, long, "web"), (None, long, None), (3, long, "web"), (3, long, "web"), (-1, "short", "only"), (500, "short", "only")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    got = audited(spark, docs, labels)
    assert got == brute(docs, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in docs})


def test_of_copies_only_those_under_the_smallest_id_pass(spark):
    text = " ".join(f"w{i}" for i in range(200))
    got = audited(spark, [(5, text, "a"), (5, text, "b"), (6, text, "b"), (None, text, "b")], [])
    assert got["a", "EABCD", 1][:4] == (1, 0, 0, 0)
    assert got["b", "EABCD", 1][:4] == (2, 1, 0, 1)


def test_empty_tables(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    assert audited(spark, [(1, "few words", None)], [])["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
