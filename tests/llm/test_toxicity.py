import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallywright.llm import toxicity as x

SCHEMA = "doc_id long, text string, score double, label string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (c != d)))
        row = new
    return row[-1]


TERMS = ["loser", "idiot", "pathetic", "worthless", "disgusting", "abcab", "abcabcabc"]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(TERMS), st.lists(st.tuples(st.integers(0, 10), st.sampled_from(["", "a", "b", "s", "t"]), st.booleans()), max_size=3))
def test_trie_walk_equals_edit_distance(term, changes):
    word = term
    for at, c, insert in changes:
        word = word[:at] + c + word[at + (not insert):]
    trie = x.Trie([x.Term(t, edits=x.edits(t)) for t in TERMS])
    within = [(distance(word, t), t) for t in TERMS if distance(word, t) <= x.edits(t)]
    got = trie.near(word)
    assert (None if got is None else (got[1], got[0].text)) == min(within, default=None)


def test_context_tells_quotation_from_abuse():
    model = x.Model([x.Term("idiot", edits=1), x.Term("zork", beginning=True)], [1, 1, 1, 1, -1, 0, 0, -1])
    scorer = x.Scorer(model)
    abuse, plain, quoted = (scorer.hits(t)[0]["context"] for t in ("You are an idiot", "the idiot of it", 'He wrote "idiot" as a word'))
    assert abuse > plain > quoted and quoted < 0.5
    assert scorer.score("you idiot") > scorer.score("nothing here") and scorer.score('he said "idiot"') < scorer.score("you idiot")
    assert scorer.hits("an 1d1ot, an idi0t, zorkish, zork") and [h["feature"] for h in scorer.hits("an 1d1ot zorkish zork")] == [1, 2]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    plain = ["".join(rng.choice("bdklmnorst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(800)]
    families = ["zw" + rng.choice("aeiou") + "g" + s for s in plain[:40]]
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(rng.randrange(10, 120))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["loser", "idiot", "losser", "worthles", rng.choice(families)]))
        rows.append((i, " ".join(words), 0.0, "l"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, corpus):
    rows, labels = corpus
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = x.fit(docs, known)
    scored = {r["doc_id"]: r["score"] for r in x.score(docs, model).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((scored[i] >= x.THRESHOLD) == (labels[i][2] == 1) for i in held)
    assert len(held) > 200 and right / len(held) > 0.96
    assert {r["doc_id"] for r in docs.where(x.held_out("doc_id")).collect()} == set(held)


def test_nulls_empty_tables_and_repeats(spark, corpus):
    rows, labels = corpus
    odd = [(None, "some idiot", None, None), (1, None, None, None), (1, "", None, None), (1, "word " * 200_000, None, None)]
    docs = spark.createDataFrame(odd, SCHEMA)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = x.fit(docs, empty)
    assert all(0 <= r["score"] < 0.01 for r in x.score(docs, none).collect())
    assert x.score(spark.createDataFrame([], SCHEMA), none).collect() == []
    nulls = spark.createDataFrame([(None, None, 1), (1, 1, None), (5, 0, 1), (5, 0, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    model = x.fit(spark.createDataFrame(rows, SCHEMA), nulls)
    assert len(x.score(docs, model).collect()) == 4


def test_every_kept_word_may_be_misspelled():
    words = [f"{a}{b}{c}rk{d}" for a in "bdfgh" for b in "aeiou" for c in "lmnpr" for d in ("a", "o", "eto", "isten")]
    chosen = [(w, False, False) for w in words] + [("zwigga", True, False), ("zwiggabem", False, False), ("zwiggadol", False, False)]
    scorer = x.Scorer(x.Model(x._lexicon(chosen)))
    assert len(words) == 500
    for w in words:
        if len(w) > 4:
            assert scorer.hit(w)[0] == 0
            assert scorer.hit(w[:2] + "q" + w[2:])[0] == 1 and scorer.hit(w[:2] + "q" + w[3:])[0] == 1
    # inside a learned beginning too, while the beginning keeps the words it covers
    assert scorer.hit("zvwiggabem")[::2] == (1, "zwiggabem") and scorer.hit("zqiggadol")[::2] == (1, "zwiggadol")
    assert [scorer.hit(w)[0] for w in ("zwiggabem", "zwiggadul", "zwiggaxyz")] == [2, 2, 2]


@settings(max_examples=200, deadline=None)
@given(st.text("abs", min_size=1, max_size=12), st.lists(st.text("abs", min_size=5, max_size=11), max_size=30, unique=True))
def test_near_is_the_closest_of_many(word, terms):
    trie = x.Trie([x.Term(t, edits=x.edits(t)) for t in terms])
    within = [(distance(word, t), t) for t in terms if distance(word, t) <= x.edits(t)]
    got = trie.near(word)
    assert (None if got is None else (got[1], got[0].text)) == min(within, default=None)
