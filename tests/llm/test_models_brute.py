"""The queries of the trained operators against plain versions of them: one row, one word, one tree at a time."""

import math
import re
import zlib

import numpy as np
import zstandard

from quiverlake.llm import langid, quality, queries, toxicity
from quiverlake.llm.common import read_table


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def texts_of(spark, sf):
    return {r.doc_id: r.text for r in read_table(spark, sf, "documents").select("doc_id", "text").collect()}


def test_language_query_against_encoding_each_text(spark, small):
    content = langid.train(read_table(spark, small, "documents"))
    assert len(content) > 1
    rows = queries.op7_langid(spark, small).collect()
    texts = texts_of(spark, small)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        data = f" {' '.join(words)} ".encode()
        size = {}
        for lang, known in content.items():
            raw = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            size[lang] = 0
            for at in range(0, len(data), 2048):  # a new compressor a block: nothing is carried over
                size[lang] += len(zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_dict_id=False).compress(data[at : at + 2048]))
        least = min(size.values())
        want = next(lang for lang in content if size[lang] == least)
        assert (r.held_out, r.lang_pred) == (fold(r.doc_id, 5) == 0, want)
        assert math.isclose(r.score, 1 / sum(math.exp(-min(60.0, 0.35 * (s - least))) for s in size.values()))


def test_toxicity_query_against_looking_up_each_feature(spark, small):
    docs = read_table(spark, small, "documents")
    model = toxicity.train(docs, read_table(spark, small, "labels"))
    rows = queries.op8_toxicity(spark, small).collect()
    texts = texts_of(spark, small)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        words = set(re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda c: c[0].lower(), (texts[r.doc_id] or "").encode())))
        total = 0.0
        for feature, column in model.vocabulary.items():
            if feature.startswith(b"^"):
                held = any(w.startswith(feature[1:]) and len(w) >= len(feature) for w in words)
            else:
                held = feature in words
            total += model.weights[column] * held
        above = [1 / (1 + math.exp(-(total - cut))) for cut in model.thresholds]
        assert math.isclose(r.severity, sum(above), rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(r.p_toxic, above[0] if above else 0.0, rel_tol=1e-9, abs_tol=1e-12) and r.toxic == (r.p_toxic >= 0.5)
        assert r.held_out == (fold(r.doc_id, 5) == 0)


def plain_statistics(text):
    """quality.STATISTICS by their names, counted character by character."""
    if not text:
        return [0.0] * len(quality.STATISTICS)
    data = text.encode()
    n = len(data)
    words = [w for w in re.split(rb"[ \t\n\r\x0b\x0c]+", data) if w]
    lines = [x for x in data.split(b"\n") if x.strip()]
    m, k = max(len(words), 1), max(len(lines), 1)
    share = lambda test: sum(1 for b in data if test(b)) / n
    upper = lambda b: 65 <= b <= 90
    alnum = lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122
    marks = lambda s: sum(data.count(c.encode()) for c in s) / m
    freq = [data.count(bytes([b])) / n for b in set(data)]
    return [
        math.log(1 + n), math.log(1 + len(words)), sum(map(len, words)) / m, share(upper), share(lambda b: 97 <= b <= 122), share(lambda b: 48 <= b <= 57),
        share(lambda b: b in b" \t"), share(lambda b: b == 10), share(lambda b: 33 <= b <= 126 and not alnum(b)), share(lambda b: b >= 128),
        marks("."), marks(","), marks("!"), marks("|_"), marks("{}<>;"), marks("@/"),
        sum(len(w) > 14 for w in words) / m, sum(len(w) <= 3 for w in words) / m, sum(len(w) > 1 and upper(w[0]) and upper(w[1]) for w in words) / m,
        sum(not alnum(w[-1]) and w[-1] < 128 and w[-1] not in b".,;:!?" for w in words) / m,
        len(set(words)) / m, max((words.count(w) for w in set(words)), default=0) / m if len(words) < 3000 else None, len(set(lines)) / k, math.log(1 + n / k),
        sum(len(x) < 25 for x in lines) / k, math.log(1 + len(lines)), -sum(f * math.log2(f) for f in freq), sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
    ]


def test_quality_query_against_walking_each_tree(spark, small):
    model = quality.train(read_table(spark, small, "documents"), read_table(spark, small, "labels"))
    rows = queries.op9_quality(spark, small).collect()
    texts = texts_of(spark, small)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r.doc_id]
        got = quality.statistics(text.encode() if text else None)
        if text and not text.strip():
            continue
        for name, a, b in zip(quality.STATISTICS, got, plain_statistics(text), strict=True):
            assert b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), name
        total = model.prior
        for at in model.roots:
            while model.left[at] >= 0:
                at = model.left[at] + int(got[model.feature[at]] > model.threshold[at])
            total += model.value[at]
        assert math.isclose(r.score, 1 / (1 + math.exp(-max(-30.0, min(30.0, total)))), rel_tol=1e-9)
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (fold(r.doc_id, 3) == 1)


def test_first_split_against_trying_every_one():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, (300, 4)).astype(float)
    y = (x[:, 2] + rng.normal(0, 3, 300) > 11).astype(float)
    trees = quality.fit_trees(x, y, rounds=1, depth=1, rate=1.0, ridge=2.0, least=8)
    p = (y.sum() + 1) / (len(y) + 2)
    leaf = lambda rows: (p - y[rows]).sum() ** 2 / (rows.sum() * p * (1 - p) + 2.0)
    tried = {}
    for j in range(4):
        for cut in np.unique(x[:, j])[:-1]:
            low = x[:, j] <= cut
            if min(low.sum(), (~low).sum()) >= 8:
                tried[j, cut] = leaf(low) + leaf(~low)
    best = max(tried, key=tried.get)
    low = x[:, trees.feature[0]] <= trees.threshold[0]
    assert trees.feature[0] == best[0] and math.isclose(leaf(low) + leaf(~low), tried[best])
    assert math.isclose(trees.value[1], -(p - y[low]).sum() / (low.sum() * p * (1 - p) + 2.0))
