"""Toxicity by a lexicon that misspelled terms cannot slip past.

The lexicon is a trie. Every distinct word of a text is matched by walking the trie
together with the word's Levenshtein automaton: for each number of edits a set of the
word's prefixes, kept as bits and moved by shifts, and a branch of the trie is left as
soon as all sets are empty. Terms that share letters with the word after as many deletions
as they allow edits are the only ones within reach, so the walk keeps to their branches.
Each hit is scored in its window of context words:
marks of quotation or report around it count for quotation, second-person words for
abuse. A logistic model over those sums gives the score.

Terms are learned: words, and word beginnings (inflected families share them), that
labelled toxic texts hold far oftener than chance allows. How many edits a term may be
away is learned too: a term whose near misses turn up in clean texts is matched exactly.
All of it, and the model's weights, is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Labelled rows that are fitted on, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
#: Words that no beginning covers, and beginnings, kept at most: the most frequent ones.
TERMS = 4_000
#: Of texts with a term, both classes taken as alike large, so many must be toxic; and the
#: odds of finding the term in toxic texts only by chance must be below this, over all terms.
LEAST_SHARE, CHANCE = 0.97, 0.01
LEAST_TEXTS = 3
#: Beginnings that fall short of it are suggestive from this share on: ordinary words begin
#: so too, and only several of them tell.
SUGGESTIVE_SHARE = 0.7
BEGINNINGS = range(3, 10)
#: Words of context on either side of a hit.
CONTEXT = 4
THRESHOLD = 0.3
#: Distinct words whose hits a worker remembers.
MEMO = 1 << 18

# Words around a hit that tell report from address.
REPORT = frozenset("said says wrote writes called calls quote quoted quotes term word slur reported reports dijo escribió palabra sagte schrieb wort genannt dit écrit mot".split())
ADDRESS = frozenset("you your youre u ur du dich dein ihr tu ti te toi vous usted vosotros".split())
# Digits and signs read as the letters they stand for.
LEET = str.maketrans("013457@$", "oieastas")

_WORD = re.compile(r"[^\W_](?:[\w@$'’*]*[^\W_])?", re.UNICODE)
_QUOTES = "\"'“”„«»‘’`"


def words_of(text: str) -> list[str]:
    """Lower-case words with their insides."""
    return _WORD.findall(text.lower())


def edits(term: str) -> int:
    """Edits that a term of this length allows at most."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def deletions(word: str, n: int) -> set[str]:
    """The word and all that up to ``n`` deleted letters leave of it."""
    out = last = {word}
    for _ in range(n):
        last = {w[:i] + w[i + 1:] for w in last for i in range(len(w))}
        out = out | last
    return out


@dataclass(frozen=True)
class Term:
    """A lexicon entry: a whole word with the edits it allows, or a word beginning."""

    text: str
    beginning: bool = False
    edits: int = 0
    suggestive: bool = False


class Trie:
    """Terms by their letters, for walks together with a Levenshtein automaton."""

    def __init__(self, terms: list[Term]):
        self.whole: dict[str, Term] = {}
        self.starts: dict[str, Term] = {}
        #: by edits: what deletions leave of the terms that allow them, and those terms
        self.left: dict[int, dict[str, list[Term]]] = {}
        #: by edits: the lengths of words within reach
        self.reach: dict[int, range] = {}
        #: by edits: a term with e edits keeps one of e + 1 parts whole: what words must begin with, end with or hold
        self.heads: dict[int, dict[int, set[str]]] = {}
        self.tails: dict[int, dict[int, set[str]]] = {}
        self.middles: dict[int, dict[int, set[str]]] = {}
        for term in terms:
            if term.beginning:
                self.starts[term.text] = term
                continue
            self.whole[term.text] = term
            e, n = term.edits, len(term.text)
            if not e:
                continue
            left = self.left.setdefault(e, {})
            for rest in deletions(term.text, e):
                left.setdefault(rest, []).append(term)
            known = self.reach.get(e, range(n, n + 1))
            self.reach[e] = range(min(known.start, n - e), max(known.stop, n + e + 1))
            cuts = [n * i // (e + 1) for i in range(e + 2)]
            parts = [term.text[i:j] for i, j in zip(cuts, cuts[1:])]
            for kept, part in [(self.heads, parts[0]), (self.tails, parts[-1]), *((self.middles, m) for m in parts[1:-1])]:
                kept.setdefault(e, {}).setdefault(len(part), set()).add(part)
        self.lengths = sorted({len(s) for s in self.starts})

    def begins(self, word: str) -> Term | None:
        """The longest beginning of the word, and of those one that is not just suggestive."""
        found = [self.starts[word[:n]] for n in self.lengths if n < len(word) and word[:n] in self.starts]
        return max(found, key=lambda t: (not t.suggestive, len(t.text)), default=None)

    def within_reach(self, word: str) -> list[Term]:
        """Every term that may be within its own edits of the word; few others."""
        out: dict[str, Term] = {}
        for e, left in self.left.items():
            if len(word) not in self.reach[e]:
                continue
            if not (
                any(word[:n] in part for n, part in self.heads[e].items()) or any(word[-n:] in part for n, part in self.tails[e].items())
                or any(word[i:i + n] in part for n, part in self.middles.get(e, {}).items() for i in range(1, len(word) - n))
            ):
                continue
            for rest in deletions(word, e):
                for term in left.get(rest, ()):
                    out[term.text] = term
        return list(out.values())

    def near(self, word: str) -> tuple[Term, int] | None:
        """The closest whole-word term within its own edits, and its distance."""
        term = self.whole.get(word)
        if term is not None:
            return term, 0
        terms = self.within_reach(word)
        if not terms:
            return None
        root: dict = {}
        for term in terms:
            node = root
            for c in term.text:
                node = node.setdefault(c, {})
            node[""] = term
        most = max(t.edits for t in terms)
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        end = 1 << len(word)
        best: tuple[Term, int] | None = None
        # sets[j]: prefixes of the word that the walk so far equals but for j edits
        stack = [(root, tuple((1 << j + 1) - 1 for j in range(most + 1)))]
        while stack:
            node, sets = stack.pop()
            term = node.get("")
            if term is not None:
                for j in range(term.edits + 1):
                    if sets[j] & end:
                        if best is None or (j, term.text) < (best[1], best[0].text):
                            best = (term, j)
                        break
            for c, child in node.items():
                if c == "":
                    continue
                here, moved, before, last = at.get(c, 0), [], 0, 0
                for s in sets:
                    last = (s & here) << 1 | before | before << 1 | last << 1
                    moved.append(last)
                    before = s
                if last & (end * 2 - 1):
                    stack.append((child, tuple(moved)))
        return best


@dataclass
class Model:
    """Terms and weights; ``weights`` belong to ``FEATURES`` with the constant last."""

    terms: list[Term]
    weights: list[float] = field(default_factory=list)


FEATURES = ("abusive words", "misspelled words", "abusive beginnings", "suggestive beginnings", "quoted hits", "density", "suggestive density")


class Scorer:
    """Features and scores of whole texts under one model."""

    def __init__(self, model: Model):
        self.trie, self.model, self.memo = Trie(model.terms), model, {}

    def hit(self, word: str) -> tuple[int, float, str] | None:
        """(feature, strength, term) of one word."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) >= MEMO:
            self.memo.clear()
        found = None
        plain = word.translate(LEET).replace("*", "").replace("'", "")
        for form in (word,) if plain == word else (word, plain):
            near = self.trie.near(form)
            start = self.trie.begins(form)
            # what a full beginning covers counts as that beginning, word or misspelling
            if near is not None and not (start is not None and not start.suggestive and near[0].text.startswith(start.text)):
                found = (0, 1.0, near[0].text) if near[1] == 0 and form == word else (1, 1.0 / (1 + near[1]), near[0].text)
                break
            if start is not None:
                found = (3 if start.suggestive else 2, 1.0, start.text)
                break
        self.memo[word] = found
        return found

    def hits(self, text: str) -> list[dict]:
        """Every hit with its place among the words, its strength and its context score.

        The context score is 1 for plain use, less where the window reports or quotes, more
        where it addresses the reader.
        """
        if not any(self.hit(w) for w in set(words_of(text))):
            return []
        low = text.lower()
        spans = [m.span() for m in _WORD.finditer(low)]
        words, out = [low[a:b] for a, b in spans], []
        for i, word in enumerate(words):
            found = self.hit(word)
            if found is None:
                continue
            a, b = spans[i]
            quoted = a > 0 and b < len(low) and low[a - 1] in _QUOTES and low[b] in _QUOTES
            window = words[max(0, i - CONTEXT):i] + words[i + 1:i + 1 + CONTEXT]
            report = sum(w in REPORT for w in window) + 2 * quoted
            address = sum(w in ADDRESS for w in window)
            out.append({"word": i, "feature": found[0], "strength": found[1], "term": found[2], "context": max(0.0, min(2.0, 1.0 - 0.5 * report + 0.25 * address))})
        return out

    def features(self, text: str) -> list[float]:
        sums = [0.0] * len(FEATURES)
        for h in self.hits(text):
            if h["context"] < 0.5:
                sums[4] += h["strength"]
            else:
                sums[h["feature"]] += h["strength"] * h["context"]
        per_word = 100.0 / (20 + text.count(" "))
        return [*(float(np.log1p(s)) for s in sums[:5]), min(4.0, sum(sums[:3]) * per_word), min(4.0, sums[3] * per_word)]

    def score(self, text: str) -> float:
        z = float(np.dot(self.features(text), self.model.weights[:-1]) + self.model.weights[-1])
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def _mapped(df: DataFrame, per_batch, schema: str) -> DataFrame:
    """``df`` through ``per_batch(state, batch) -> dict of columns``; state lives as long as the task."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows = per_batch(state, part)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[t.split()[1]]) for i, t in enumerate(schema.split(", "))], names=names)

    return df.mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def _text_counts(texts: DataFrame, asked) -> DataFrame:
    """(term, beginning, n): in how many texts each word and beginning stands; ``asked``: only those of a broadcast set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = None if asked is None else asked.value, Counter()

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([counts[k] for k in keys], pa.int64())], names=["term", "beginning", "n"]
            )

        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = set(words_of(text))
                keys = {(w, False) for w in words} | {(w[:n], True) for w in words for n in BEGINNINGS if len(w) > n}
                counts.update(keys if wanted is None else keys & wanted)
                if len(counts) >= MEMO:
                    yield flush()
                    counts.clear()
        yield flush()

    return texts.select("text").mapInArrow(run, "term string, beginning boolean, n long").groupBy("term", "beginning").agg(F.sum("n").alias("n"))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, int]]:
    return zip(batch.column("text").to_pylist(), batch.column("label").to_pylist())


def _chosen(counts: DataFrame, toxic: int, clean: int, tested: int) -> list[tuple[str, bool, bool]]:
    """(term, beginning, suggestive) of the terms that toxic texts hold beyond chance."""
    share = (F.col("bad") / toxic) / (F.col("bad") / toxic + (F.col("good") + 0.5) / max(1, clean))
    # relative entropy bounds the chance that so large a part of the texts is toxic
    p, n = toxic / (toxic + clean), F.col("bad") + F.col("good")
    q = F.col("bad") / n
    log_chance = -n * (q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0))
    sure = (F.col("bad") >= LEAST_TEXTS) & (q > p) & (log_chance <= math.log(CHANCE / max(1, tested)))
    kept = counts.where(sure & ((share >= LEAST_SHARE) | F.col("beginning") & (share >= SUGGESTIVE_SHARE)))
    rows = kept.select("term", "beginning", (share < LEAST_SHARE).alias("suggestive"), "bad").orderBy(F.desc("bad"), "beginning", "term").limit(4 * TERMS).collect()
    return [(r["term"], r["beginning"], r["suggestive"]) for r in rows]


def _lexicon(chosen: list[tuple[str, bool, bool]]) -> list[Term]:
    """Shortest beginnings first stand for longer ones; words that start so stay, for their misspellings."""
    words = [t for t, beginning, _ in chosen if not beginning]
    starts: dict[str, Term] = {}
    for text, beginning, suggestive in sorted(chosen, key=lambda c: (c[2], len(c[0]), c[0])):
        # a beginning that only one known word has adds nothing to that word
        if beginning and sum(w.startswith(text) for w in words) != 1 and not any(text[:n] in starts and starts[text[:n]].suggestive == suggestive for n in range(1, len(text))):
            starts[text] = Term(text, beginning=True, suggestive=suggestive)
    covered = [t for t in words if any(t[:n] in starts and not starts[t[:n]].suggestive for n in range(1, len(t)))]
    known = set(covered)
    kept = [t for t in words if t not in known][:TERMS]
    return [Term(t, edits=edits(t)) for t in kept + covered] + sorted(starts.values(), key=lambda t: (t.suggestive, t.text))[:TERMS]


def fit_weights(rows: np.ndarray, labels: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> list[float]:
    """Logistic weights by Newton steps with a ridge."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * rows.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (p - labels) + penalty @ w)
        w = w - step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
    return [float(v) for v in w]


def held_out(id_col: str):
    """Rows never fitted on: those whose id, as text, has CRC-32 with remainder 2 by 4."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Terms and weights from at most ``sample_rows`` labelled rows that are not held out.

    The sample takes the smallest hashes of the id, so it does not depend on partitions; its
    words are counted in Spark, and only terms and a few numbers a row reach the driver. Rows
    without text or label are left out; without a toxic sample nothing is toxic.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out("id"))
    known = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.col("id").cast("string"))).limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sample = materialise(texts.join(F.broadcast(known), "id").select("text", "label"), "toxicity-sample")
    toxic, total = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    nothing = Model([], [0.0] * len(FEATURES) + [-30.0])
    if not toxic or toxic == total:
        return nothing

    bad = materialise(_text_counts(sample.where("label = 1"), None).where(F.col("n") >= LEAST_TEXTS), "toxicity-terms")
    tested = bad.count()
    # even without a clean text a term needs so many toxic ones to be beyond chance
    need = math.log(max(1, tested) / CHANCE) / math.log(total / toxic)
    bad = bad.where(F.col("n") >= need).withColumnRenamed("n", "bad")
    asked = spark.sparkContext.broadcast({(r["term"], r["beginning"]) for r in bad.select("term", "beginning").toLocalIterator()})
    good = _text_counts(sample.where("label = 0"), asked).withColumnRenamed("n", "good")
    counts = bad.join(good, ["term", "beginning"], "left").fillna(0, ["good"])
    model = Model(_lexicon(_chosen(counts, toxic, total - toxic, tested)))

    def missed(state: dict, batch: pa.RecordBatch) -> list[tuple]:
        scorer = state.setdefault("scorer", Scorer(model))
        found: Counter = Counter()
        for text, label in _texts(batch):
            found.update({(h["term"], label) for h in scorer.hits(text) if h["feature"] == 1})
        return [(term, label, n) for (term, label), n in found.items()]

    near = {(r["term"], r["label"]): r["n"] for r in _mapped(sample, missed, "term string, label int, n long").groupBy("term", "label").agg(F.sum("n").alias("n")).collect()}
    model.terms = [
        Term(t.text, t.beginning, suggestive=t.suggestive, edits=0 if near.get((t.text, 0), 0) / (total - toxic) > (1 - LEAST_SHARE) * near.get((t.text, 1), 0) / toxic else t.edits) for t in model.terms
    ]

    def measured(state: dict, batch: pa.RecordBatch) -> list[tuple]:
        scorer = state.setdefault("scorer", Scorer(model))
        return [(label, *scorer.features(text)) for text, label in _texts(batch)]

    rows = np.array(_mapped(sample, measured, "label int, " + ", ".join(f"f{i} double" for i in range(len(FEATURES)))).collect(), dtype=float)
    rows = rows[np.lexsort(rows.T)]
    model.weights = fit_weights(rows[:, 1:], rows[:, 0])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of ``docs``.

    Null texts score as empty ones; repeated and null ids keep a row each; nothing but the
    text is looked at.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array([scorer.score(t) for t in texts], pa.float64())], names=["id", "score"]
            )

    schema = T.StructType([T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: the model fitted on the labels, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
