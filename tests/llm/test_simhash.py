import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from quiverlake.llm import simhash as S


def fingerprint(text, k=4):
    words, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    words += [word] * bool(word)
    if not words:
        return 0
    k = min(k, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, prints, distance=4):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        r = find(i)
        least[r] = min([x for x in (least.get(r), ids[i]) if x is not None], default=None)
    return [least[find(i)] for i in range(len(ids))]


def test_cover():
    triples = S.cover()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_fingerprints_and_components(spark, docs_of):
    rng = random.Random(2)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(50)]
    texts = [None, "", " \t\n", "one", "One  two", "one two", "a b c d", "A\x0bB\x0cC D"]
    long = [rng.choice(vocabulary) for _ in range(3000)]
    for n in (1, 2, 5, 20, 400):
        copy = list(long)
        for _ in range(n):
            copy[rng.randrange(len(copy))] = "x"
        texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    texts += [texts[8], texts[8], "x" * 100_000]
    want = [fingerprint(t) for t in texts]
    rows = {r.doc_id: r for r in S.components(docs_of(texts)).collect()}
    assert [rows[i].fp % (1 << 64) for i in range(len(texts))] == want
    assert [rows[i].component for i in range(len(texts))] == classes(list(range(len(texts))), want)
    assert rows[1].component == rows[2].component == 0


@pytest.mark.parametrize("block", [8, 2048])
def test_links_connect_all_near_fingerprints(spark, block):
    from quiverlake.llm.components import connected_components

    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = set(seeds.tolist())
    walk = int(seeds[0])
    for _ in range(150):  # a long chain, and a dense ball
        for b in rng.choice(64, 4, replace=False):
            walk ^= 1 << int(b)
        prints.add(walk)
        ball = int(seeds[1])
        for b in rng.choice(64, 2, replace=False):
            ball ^= 1 << int(b)
        prints.add(ball)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = S.links(spark.createDataFrame([(p,) for p in signed], "fp long"), "fp", 4, block)
    rows = edges.collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() >= 1 for r in rows)
    root = {r.node: r.root for r in connected_components(edges).collect()}
    want = classes(list(range(len(prints))), prints)
    got = [root.get(p, p) for p in signed]
    assert {(a, b) for a, b in zip(want, got, strict=True)} and len(set(want)) == len(set(got)) == len(set(zip(want, got, strict=True)))


def test_keep_one(docs_of):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [(5, base), (3, base), (3, base), (9, base + " more"), (1, "another text of its own"), (1, "this one has a repeated id"), (None, None), (None, ""), (7, "alone"), (None, "null id with words")]
    df = docs_of(texts)
    out = S.keep_one(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in out.collect() if r.text)
    assert got == sorted([(3, base), (1, "another text of its own"), (1, "this one has a repeated id"), (7, "alone"), (-1, "null id with words")])
    assert sum(not r.text for r in out.collect()) == 1
    assert S.keep_one(docs_of([])).count() == 0 and S.components(docs_of([])).count() == 0
