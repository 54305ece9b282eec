import random

import public_tokenizers
import pytest

from tallywright.llm.token_counts import count_tokens
from tallywright.llm.vocabulary import head_cutoff

SCHEMA = "doc_id long, text string, pieces int, key string"


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("head", [0, 40, 1 << 17])
def test_equals_the_library(spark, definition, head):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    bits = ["word", "Wörter", " ", "  ", "\n", "\n\n", "\t", "don't", "we'll", "'s", "123", "漢字", "😀", "<|endoftext|>", "<|endof", " ", "\u0085", "\x00", "a" * 300, "...", " ", "x=1;", " <|endoftext|> "]
    texts = [None, "", " ", "one two three", "trailing ", " leading", "a  b", "<|endoftext|>"]
    texts += ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    texts += ["one two three"] * 3 + ["very long words here " * 20_000]
    rows = [(i % 100 or None, t, 7, "k") for i, t in enumerate(texts)]
    tokenizer = Tokenizer.from_str(definition)
    want = sorted((r[0] or 0, len((r[1] or "").encode()), n := len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids), n > 1024) for r in rows)
    got = count_tokens(spark.createDataFrame(rows, SCHEMA), definition, head=head).collect()
    assert sorted((r[0] or 0, *r[1:]) for r in got) == want


def test_empty_table(spark, definition):
    assert count_tokens(spark.createDataFrame([], SCHEMA), definition).collect() == []


def test_head_cutoff_is_bounded(spark):
    df = spark.createDataFrame([(n,) for n in [1] * 50 + [2] * 20 + [5000] * 3 + [5001] * 2 + [10**9]], "n long")
    for head in (0, 1, 6, 25, 26, 76, 100):
        assert df.where(df.n >= head_cutoff(df, head)).count() <= head
    assert head_cutoff(df, 100) == 1 and head_cutoff(df, 26) == 2


@pytest.mark.parametrize("head", [0, 1 << 17])
def test_texts_are_read_once(spark, definition, head):
    from tokenizers import Tokenizer

    tokenizer, read = Tokenizer.from_str(definition), spark.sparkContext.accumulator(0)
    texts = [f"thenre{i % 7}qx ontionerwhx,\nthe end {i}" for i in range(300)]

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in enumerate(texts)], SCHEMA)
    got = count_tokens(docs.mapInArrow(count, docs.schema), definition, head=head).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(tokenizer.encode(t).ids) for i, t in enumerate(texts)}
    assert read.value == len(texts)
