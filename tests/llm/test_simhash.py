import random

import numpy as np
import xxhash

from tallywright.llm.simhash import components, fingerprints, forest, near_duplicates, search


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min(groups[find(i)]) for i in range(len(ids))]


def test_search_equals_brute_force():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 17, 300):
        base = rng.integers(0, 2**64, size=max(1, n // 10), dtype=np.uint64)
        fps = base[rng.integers(0, len(base), n)]
        for _ in range(3):
            fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * (rng.random(n) < 0.5).astype(np.uint64)
        rank = fps = np.unique(fps)
        for s in (1, 2, 4, 8, 16, 32):
            rank = rank ^ (rank >> np.uint64(s))
        fps = fps[np.argsort(rank)]
        got = {(int(i), int(j)) for a, b in search(fps, block=3) for i, j in zip(a, b)}
        want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}
        assert got == want
        assert len(forest(fps)) == len(fps) - len(set(brute_components(list(range(len(fps))), [int(x) for x in fps])))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["wort", "Été", "THE", "a", "b", "c", "dd", "ee", "fff", "漢字"]
    texts = [None, "", " \n", "one", "one two", "one two three", "x y z"]
    for _ in range(40):
        own = [rng.choice(words) for _ in range(rng.randrange(4, 60))]
        texts.append(" ".join(own))
        for _ in range(rng.randrange(3)):
            own = list(own)
            own[rng.randrange(len(own))] = rng.choice(words)
            texts.append("\n".join(own))
    texts += ["same text of several words"] * 5
    rows = [(100 - i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, root int")
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in near_duplicates(docs).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    comps = brute_components([r[0] for r in rows], prints)
    assert got == {r[0]: (p, c) for r, p, c in zip(rows, prints, comps)}


def test_hot_nodes_split_without_losing_links(spark, monkeypatch):
    from tallywright.llm import simhash

    monkeypatch.setattr(simhash, "NODE_LIMIT", 8)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(24), rng.randrange(5))) for _ in range(150)})
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in components(simhash.links(df)).collect()}
    comps = brute_components(fps, fps)
    of = {}
    for f, c in zip(fps, comps):
        of.setdefault(roots.get(f, f), set()).add(c)
    assert all(len(c) == 1 for c in of.values()) and len(of) == len(set(comps))


def test_empty_null_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (2, None)]
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, 5), (2, 2), (5, 5), (5, 5)]
    long_text = "word " * 200_000
    assert fingerprints(spark.createDataFrame([(1, long_text)], schema)).first()["fp"] != 0
