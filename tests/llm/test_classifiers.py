import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.llm import langid, quality, queries, toxicity
from quiverlake.llm.common import read_table

BIG = "/root/testdata/sf0.01"


def fold(i, m):
    return zlib.crc32(b"" if i is None else str(i).encode()) % m


@pytest.fixture(scope="module")
def truth(spark):
    docs = {r.doc_id: r for r in read_table(spark, BIG, "documents").select("doc_id", "lang", "text").collect()}
    labels = {r.doc_id: r for r in read_table(spark, BIG, "labels").collect()}
    return docs, labels


def test_language_held_out(spark, truth):
    docs, _ = truth
    rows = queries.op7_langid(spark, BIG).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([docs[r.doc_id].lang == r.lang_pred for r in held]) >= 0.96


def test_language_cases(spark):
    content = {"aa": langid.normalise("alpha beta gamma delta " * 40), "bb": langid.normalise("uno dos tres cuatro cinco " * 40)}
    texts = [None, "", "12 34 !!", "alpha gamma delta", "DOS, tres... cinco?", "uno tres " * 60_000, "alpha"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "dos tres cuatro", "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in langid.identify(df, content, ["doc_id"]).collect()}
    assert [got[i].lang for i in (0, 1, 2, 3, 4, 5, None)] == ["und", "und", "und", "aa", "bb", "bb", "bb"]
    assert got[0].rejected and got[0].score == 0 and not got[3].rejected
    assert {r.lang for r in langid.identify(df, {}, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(df.limit(0), content, ["doc_id"]).count() == 0
    empty = df.limit(0).withColumn("lang", F.lit("a"))
    assert langid.train(empty) == {}


def test_languages_learn_from_training_rows_alone(spark):
    rows = [(i, "only seen in held out rows" if fold(i, 5) == 0 else "common words", "zz" if fold(i, 5) == 0 else "en") for i in range(60)] + [(61, "text", None), (62, None, "fr")]
    content = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(content) == {"en"} and b"held" not in content["en"]


def test_quality_held_out(spark, truth):
    docs, labels = truth
    rows = queries.op9_quality(spark, BIG).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([labels[r.doc_id].quality == r.predicted for r in held]) >= 0.95
    again = {r.doc_id: r.score for r in queries.op9_quality(spark, BIG).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_trees_against_walking_them():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality.fit_trees(x, y, rounds=30)

    def walk(row):
        total = trees.prior
        for at in trees.roots:
            while trees.left[at] >= 0:
                at = trees.left[at] + int(row[trees.feature[at]] > trees.threshold[at])
            total += trees.value[at]
        return total

    assert np.allclose(trees.margin(x), [walk(r) for r in x])
    assert np.mean((trees.score(x) > 0.5) == y) > 0.97


def test_quality_cases(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate([None, "", " ", "\n", "x" * 300_000, "é ü", "a b c", "a b c"])] + [(None, "a b c", "s")], "doc_id long, text string, score_ string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(None, 1), (3, None), (4, 1), (4, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model, out="score").collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.text == "a b c"}) == 1 and rows[0].score == rows[1].score
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, none).count() == 9 and quality.keep_good(docs, none).columns == docs.columns
    assert quality.score(docs.limit(0), model).count() == 0
    one = quality.train(docs, spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, quality int"))
    assert all(r.score > 0.5 for r in quality.score(docs, one).collect())


def test_toxicity_held_out(spark, truth):
    docs, labels = truth
    rows = queries.op8_toxicity(spark, BIG).collect()
    assert len(rows) == len(docs)
    held = [(r, labels[r.doc_id].toxic) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.toxic == bool(y) for r, y in held]) >= 0.93
    assert np.mean([r.toxic for r, y in held if not y]) <= 0.02
    assert all(0 <= r.severity <= 3 and r.grade in (0, 1, 2, 3) for r in rows)


def test_toxicity_cases(spark):
    clean, bad = "a calm walk by the lake in the sun", "you are a vile rotten crook"
    texts = [(i, clean + f" {i}", 0) for i in range(60)] + [(100 + i, clean + " " + bad, 1) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in texts] + [(500, None, "s"), (501, "", "s"), (None, bad, "s"), (502, "word " * 50_000 + bad, "s")], "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.grade(docs, model, ["doc_id"]).collect()}
    assert len(got) == 124
    assert list(model.thresholds) == sorted(model.thresholds)
    none = toxicity.train(docs, labels.limit(0))
    assert {r.severity for r in toxicity.grade(docs, none, ["doc_id"]).collect()} == {0.0}
    assert toxicity.grade(docs.limit(0), model, ["doc_id"]).count() == 0
    assert got[500].severity == got[501].severity


def test_ordinal_severity_rises_with_telling_words():
    rng = np.random.default_rng(3)
    calm = [f"word{i}" for i in range(200)]
    vile = [f"vile{i}" for i in range(6)]
    texts, y = [], []
    for _ in range(900):
        words = rng.choice(calm, 20).tolist()
        n = int(rng.integers(0, 6)) if rng.random() < 0.4 else 0
        words += rng.choice(vile, n, replace=False).tolist()
        texts.append(" ".join(words).encode())
        y.append(int(n > 0))
    model = toxicity.fit(texts, y)
    up = model.above([" ".join(vile[:k]).encode() for k in (0, 1, 3, 6)]).sum(axis=1)
    assert up[0] < 0.3 and all(np.diff(up) > 0) and up[3] > 2.5
