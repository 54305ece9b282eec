import itertools
import random

import public_tokenizers
import pytest

from tallywright.llm import pieces

SCHEMA = "doc_id long, text string, ids string, unit int"


@pytest.fixture(scope="module")
def model():
    return pieces.default_model()


@pytest.mark.parametrize("head", [0, 100, 1 << 17])
def test_ids_equal_the_library_and_come_back(spark, model, head):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    bits = ["word", "Wörter", " ", "  ", "   ", "\n", "\t", "thon.", "blerer,", "123", "漢字", "😀", "a" * 90, "ﬁ", "ＡＢ", "\x01", "http://x.y/z?q=1", "=" * 30, "é", "Thntblere"]
    texts = [None, "", " ", "  ", "a", " a", "a ", "one two three", "x" * 3000]
    texts += ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 30))) for _ in range(120)]
    texts += ["one two three"] * 2 + ["long text of words " * 5_000]
    rows = [(i if i % 50 else None, t, "c", 1) for i, t in enumerate(texts)]
    encoded = pieces.encode(spark.createDataFrame(rows, SCHEMA), model, head=head)
    got = sorted((r["doc_id"] or 0, r["ids"]) for r in encoded.collect())
    assert got == sorted((r[0] or 0, sp.encode(r[1] or "")) for r in rows)
    back = sorted((r["doc_id"] or 0, r["text"]) for r in pieces.decode(encoded, model).collect())
    assert back == sorted((r[0] or 0, r[1] or "") for r in rows)


def test_empty_table(spark, model):
    assert pieces.encode(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_viterbi_fold_finds_the_best_path(spark):
    rng = random.Random(2)
    alphabet = "ab▁"
    names = ["".join(p) for n in (1, 2, 3) for p in itertools.product(alphabet, repeat=n) if n == 1 or rng.random() < 0.5]
    toy = pieces.PieceModel({p: (i + 256, -rng.random() * 10 * len(p) ** 0.5) for i, p in enumerate(names)}, list(range(256)))
    units = ["".join(rng.choice(alphabet + "é") for _ in range(rng.randrange(1, 9))) for _ in range(60)]

    def best(unit):
        scores = [(0.0, [])]
        for end in range(1, len(unit) + 1):
            options = [(scores[end - 1][0] - 1e6, [*scores[end - 1][1], *unit[end - 1].encode()])] if unit[end - 1] not in toy.pieces else []
            for start in range(max(0, end - 3), end):
                if (known := toy.pieces.get(unit[start:end])) is not None:
                    options.append((scores[start][0] + known[1], [*scores[start][1], known[0]]))
            scores.append(max(options, key=lambda o: o[0]))
        return scores[-1][1]

    df = spark.createDataFrame([(u,) for u in set(units)], "unit string")
    assert {r["unit"]: r["ids"] for r in pieces.lattice(df, toy, "viterbi").collect()} == {u: best(u) for u in units}


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    import sentencepiece

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    lines = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(2000)]
    prefix = str(tmp_path_factory.mktemp("unigram") / "toy")
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(lines), model_prefix=prefix, model_type="unigram", vocab_size=600, byte_fallback=True,
        normalization_rule_name="identity", remove_extra_whitespaces=False, hard_vocab_limit=False, minloglevel=2,
    )
    return f"{prefix}.model", words


@pytest.mark.parametrize("head", [0, 1 << 17])
def test_unigram_model_from_documents_to_ids(spark, unigram, head):
    import sentencepiece

    path, words = unigram
    sp, toy = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel.load(path)
    rng = random.Random(9)
    texts = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(60)] + ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (61, 90, 400)] + ["abé", "漢字 ab", "", None]
    assert toy.fold == "viterbi" and pieces.default_model().fold == "merge"
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], SCHEMA), toy, head=head).collect()}
    assert got == {i: sp.encode(t or "") for i, t in enumerate(texts)}


def test_viterbi_at_the_longest_units(spark):
    rng = random.Random(3)
    toy = pieces.PieceModel({p: (i + 256, -1.0 - rng.random() * len(p)) for i, p in enumerate(["a", "b", "ab", "ba", "aab", "bba"])}, list(range(256)))
    units = {"".join(rng.choice("ab") for _ in range(n)) for n in (5, 58, 59, 60)}
    got = {r["unit"]: r["ids"] for r in pieces.lattice(spark.createDataFrame([(u,) for u in units], "unit string"), toy, "viterbi").collect()}
    got |= {u: pieces.ids_of(pieces.viterbi(u, toy), toy) for u in ("".join(rng.choice("ab") for _ in range(n)) for n in (61, 65, 200))}
    score = {i: s for i, s in toy.pieces.values()}
    for unit in got:
        best = [0.0]
        for end in range(1, len(unit) + 1):
            best.append(max(best[end - len(p)] + s for p, (_, s) in toy.pieces.items() if unit[:end].endswith(p)))
        assert sum(score[i] for i in got[unit]) == pytest.approx(best[-1])


def test_lattice_merges_as_the_rule_does(spark, model):
    rng = random.Random(12)
    toy = pieces.PieceModel({p: (i + 256, -float(i)) for i, p in enumerate(["abc", "bc", "ab", "aa", "aaaa", "ca", "a", "b", "c", "▁"])}, list(range(256)))
    assert "abc" in toy.late and len(model.late) == 13
    for m, letters in ((toy, "abc▁é"), (model, "▁▁thenios,漢é")):
        units = {"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 9, 30, 60]))) for _ in range(80)}
        got = {r["unit"]: r["ids"] for r in pieces.lattice(spark.createDataFrame([(u,) for u in units], "unit string"), m).collect()}
        assert got == {u: pieces.ids_of(pieces.merge(u, m), m) for u in units}


@pytest.mark.parametrize("head", [0, 1 << 17])
def test_texts_are_read_once_and_every_distinct_unit_is_looked_up_once(spark, model, monkeypatch, head):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [f"thenre{i % 7}qx ontionerwhx the {'y' * 70}" for i in range(300)]
    read, looked_up, lattice = spark.sparkContext.accumulator(0), [], pieces.lattice

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    def watched(units, *args, **kwargs):
        looked_up.append(units)
        return lattice(units, *args, **kwargs)

    monkeypatch.setattr(pieces, "lattice", watched)
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], SCHEMA)
    got = pieces.encode(docs.mapInArrow(count, docs.schema), model, head=head).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: sp.encode(t) for i, t in enumerate(texts)}
    assert read.value == len(texts)
    units = [r["unit"] for df in looked_up for r in df.select("unit").collect()]
    assert len(units) == len(set(units))
