import math
import random
import re
import string
import time
from collections import Counter

from tallywright.llm import secrets as se

SCHEMA = "doc_id long, text string, spans string, base int"
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    """The contract's base spans, as (start, kind rank, end)."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def beside_samples(value):
    """(offset, text) of what the pieces with a sample word leave of a candidate."""
    blocked = set()
    for m in re.finditer(r"[A-Za-z0-9+]+", value):
        piece = m[0].lower() + value[m.end():m.end() + 1]
        if any(w in piece for w in ("example", "placeholder", "changeme", "sample", "dummy", "abcdefgh", "01234567", "12345678")):
            blocked.update(range(m.start(), m.end()))
        if piece.endswith(("your-", "your_")):
            # the mark belongs to the word, and the piece behind it to the sample
            end = re.compile(r"[A-Za-z0-9+]*").match(value, m.end() + 1).end()
            blocked.update(range(m.start(), end))
    out, start = [], 0
    for i in range(len(value) + 1):
        if i == len(value) or i in blocked:
            if i > start:
                out.append((start, value[start:i]))
            start = i + 1
    return out


def added(text, found):
    """Hot windows counted anew each, merged, without those inside a base span."""
    out = []
    parts = [(m.start() + at, part) for m in re.finditer(se.CANDIDATE, text) if not re.search(se.ALLOW, m[0]) for at, part in beside_samples(m[0])]
    for begin, part in parts:
        if len(part) < se.WINDOW or re.search(se.ALLOW, part):
            continue
        kind, _, _, bits = next(c for c in se.CLASSES if re.search(c[1], part))
        value = part.lower() if kind == "entropy_hex" else part
        spans = []
        for i in range(len(value) - se.WINDOW + 1):
            total = sum(round(1_000_000 * c * math.log2(c)) for c in Counter(value[i:i + se.WINDOW]).values())
            if total <= se.most(bits, se.WINDOW):
                start = begin + i
                if spans and start <= spans[-1][2]:
                    spans[-1] = (spans[-1][0], spans[-1][1], start + se.WINDOW)
                else:
                    spans.append((start, se.KINDS.index(kind), start + se.WINDOW))
        out += spans
    return [s for s in out if not any(b[0] <= s[0] and s[2] <= b[2] for b in found)]


def test_equals_brute_force(spark):
    rng = random.Random(11)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    parts = [
        lambda: "password: " + pick(string.ascii_letters, rng.randrange(3, 12)), lambda: "API_key='" + pick(string.ascii_letters + string.digits, 30) + "'", lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, rng.randrange(8, 24)),
        lambda: pick("0123456789abcdef", rng.randrange(15, 50)), lambda: pick(string.ascii_letters + string.digits + "+/", 44), lambda: "plain-words-with-dashes-between-them", lambda: "deadbeef" * 5,
        lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "= " * 10, lambda: "Grüße 😀 ſecret=abcdefgh", lambda: "token=token=abcdefgh", lambda: "example" + pick(string.ascii_letters, 30), lambda: "-" * 40,
        lambda: "sample_key=" + pick(string.ascii_letters + string.digits, 39), lambda: "/examples/" + pick(string.ascii_letters + string.digits + "+/", 40) + "/dummy", lambda: "my-Your_" + pick(string.ascii_letters, 25) + "-" + pick(string.ascii_letters, 25),
        lambda: pick(string.ascii_letters, 20) + "EXAMPLE/" + pick(string.digits, 22), lambda: "12345678-e89b-12d3-a456-426614174000", lambda: "your-your_your-" + pick(string.ascii_letters + string.digits, 30),
    ]
    texts = [None, "", " ", "secret=", "password=password=longenough"] + [" ".join(rng.choice(parts)() for _ in range(rng.randrange(1, 7))) for _ in range(150)]
    texts.append("filler 😀 " * 3_000 + "passwd=hunter2222 " + pick("0123456789abcdef", 64))
    rows = [(i if i % 40 else None, t, "clash", 0) for i, t in enumerate(texts)]
    got = sorted((r["doc_id"] or 0, [(s["start"], s["rank"], s["end"]) for s in r["base"]], [(s["start"], s["rank"], s["end"]) for s in r["spans"]]) for r in se.scan(spark.createDataFrame(rows, SCHEMA)).collect())
    want = []
    for i, t, _, _ in rows:
        own = base(t or "")
        want.append((i or 0, own, sorted(own + added(t or "", own))))
    assert got == sorted(want)


def test_masking_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a token=abcdefgh b"), (2, "nothing"), (3, None)], "doc_id long, text string")
    out = se.scan(df).join(df, "doc_id")
    assert {r[0]: r[1] for r in out.select("doc_id", se.masked(out.text, out.spans)).collect()} == {1: "a [SECRET] b", 2: "nothing", 3: None}
    assert se.scan(df.limit(0)).collect() == []


def test_a_run_of_a_million_characters_is_walked_once(spark):
    rng = random.Random(4)
    run = "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(1_000_000))
    text = f"data {run} end"
    started = time.monotonic()
    row = se.scan(spark.createDataFrame([(1, text, "", 0)], SCHEMA)).first()
    assert time.monotonic() - started < 90
    assert [(s["start"], s["rank"], s["end"]) for s in row["spans"] if s["rank"] > 2] == added(text, base(text))


def test_sample_words_hide_no_key_beside_them(spark):
    key = "q7Rz0LmXv3TfB9sYkWd2HnJ8cGaP5uEiO4xKtQ1"
    texts = [key, "sample_key=" + key, "/examples/" + key, key + "/sample", "example" + key, "sample_" + "plain_words_" * 4, "example/" + "x1" * 300_000]
    rows = [(i, t, "", 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"]:s["end"]] for s in r["spans"]] for r in se.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(len(got[i]) == 1 and key in got[i][0] and "ample" not in got[i][0].replace(key, "") for i in range(4))
    assert got[4] == got[5] == got[6] == []
