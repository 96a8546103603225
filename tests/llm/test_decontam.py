import random

import pytest
from pyspark.sql import functions as F

from quiverlake.llm import decontam as D


def words_of(text):
    out, word = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) >= 128:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + [word] * bool(word)


def brute(text, items, n=10):
    words, hit, found = words_of(text), set(), set()
    for i, t in items:
        w = words_of(t)
        if i is None or not w:
            continue
        size = min(n, len(w))
        windows = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                found.add(str(i))
    return len(words), len(hit), sorted(found)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog again and again until night"), (2, "short one"), (3, None), (4, "?!"), (5, "the quick brown fox jumps over the lazy dog again"), (None, "ghost words"), (2, "short one"), (10, "é ü 𝒜 x y z a b c d e f")]
BASE = ITEMS[0][1]
TEXTS = [None, "", "...", BASE.upper(), f"before. {BASE}, after", "a short-one here, SHORT one", BASE + " " + BASE, "the quick brown fox jumps over the lazy dog", "É ü 𝒜 x y z a b c d e f", "é ü 𝒜 x y z a b c d e f g", "filler " * 60_000 + BASE + " tail" * 1000, "ghost words"]


@pytest.mark.parametrize("bound", [256_000_000, 700])
def test_against_brute_force(spark, docs_of, bound):
    bench = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, source string")
    rng = random.Random(1)
    pool = words_of(" ".join(t for _, t in ITEMS if t))
    texts = TEXTS + [" ".join(rng.choice(pool) for _ in range(40)) for _ in range(80)] + [BASE]
    out = D.annotate(docs_of(texts), bench, max_index_bytes=bound).withColumn("n_hit", D.n_hit())
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, found = brute(texts[r.doc_id], ITEMS)
        assert (r.decontam.n_words, r.n_hit, r.decontam["items"]) == (n, hit, found), texts[r.doc_id][:80]
        assert r.score == 7.0


def test_index_is_as_small_as_its_bound_says():
    rng = random.Random(3)
    for length in (1, 6):
        items = [(str(i), " ".join("".join(rng.choice("abcdefgh") for _ in range(length)) for _ in range(300))) for i in range(40)]
        index = D.WindowIndex(items, 10)
        assert index.nbytes <= D.WindowIndex.MOST_BYTES_A_BYTE * sum(len(t) + 1 for _, t in items)


def test_slabs_and_clashing_names(spark, docs_of):
    index = D.WindowIndex([(str(i), t) for i, t in ITEMS if i and t], 10)
    text = "filler " * 37 + BASE + " x" * 50 + " short one " + BASE
    want = D._scanner(index)(text.encode())
    assert all(D._scanner(index, slab)(text.encode()) == want for slab in (11, 16, 64))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = docs_of([BASE, "clean"]).withColumn("Decontam", F.lit(1))
    out = D.annotate(df, bench)
    assert [c for c in out.columns if c.lower() == "decontam"] == ["decontam"] and out.where(D.n_hit() > 0).count() == 1


def test_removal(spark, docs_of):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = docs_of([(1, f"keep this. {BASE}! and this"), (2, "clean text"), (None, None), (1, f"keep this. {BASE}! and this")])
    gone = D.remove(df, bench)
    assert gone.columns == df.columns and sorted(r.text or "" for r in gone.collect()) == ["", "clean text"]
    cut = sorted(r.text or "" for r in D.remove(df, bench, mode="spans").collect())
    assert cut == ["", "clean text", "keep this. ! and this", "keep this. ! and this"]
    with pytest.raises(ValueError):
        D.remove(df, bench, mode="x")


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.annotate(docs_of([]), bench).count() == 0
    rows = D.annotate(docs_of(TEXTS), bench.limit(0)).where(F.size("decontam.hits") > 0).count()
    assert rows == 0
