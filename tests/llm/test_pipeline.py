import importlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.llm import quality, secrets
from quiverlake.llm.common import read_table

from .test_decontam import brute as leaks
from .test_secrets import base as secret_spans
from .test_simhash import classes, fingerprint

pipeline = importlib.import_module("corpus_pipeline")


def staged(spark, docs, sf_dir, tmp_path):
    kept = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, kept[-1], sf_dir).write.parquet(f"file://{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"file://{tmp_path}/{k}"))
    return kept


def test_stages_against_brute_force(spark, small, tmp_path):
    docs = read_table(spark, small, "documents")
    kept = staged(spark, docs, small, tmp_path)
    rows = [{r.doc_id: r for r in k.collect()} for k in kept]
    assert all(k.columns == docs.columns for k in kept[:-1])
    model = quality.train(docs, read_table(spark, small, "labels"))
    good = {i for i, r in rows[0].items() if model.score(np.stack([quality.statistics(r.text.encode())]))[0] >= 0.5}
    assert set(rows[1]) == good and 0 < len(good) < len(rows[0])
    ids = sorted(good)
    least = classes(ids, [fingerprint(rows[1][i].text) for i in ids])
    assert set(rows[2]) == set(least)
    items = [(r.item_id, r.text) for r in read_table(spark, small, "benchmark").collect()]
    clean = {i for i in rows[2] if not leaks(rows[2][i].text, items)[1]}
    assert set(rows[3]) == clean
    assert set(rows[4]) == clean
    for i, r in rows[4].items():
        assert not secret_spans(r.text) and r.n_chars == (len(r.text) if r.text != rows[3][i].text else rows[3][i].n_chars)
    taken = kept[-1]
    assert set(taken.columns) == {*docs.columns, "copies", "taken"}
    assert taken.agg(F.sum("taken")).first()[0] == pytest.approx(sum(len(r.text.split()) for r in rows[4].values()), rel=0.15)
    again = pipeline.run(spark, small).collect()
    assert sorted(map(str, again)) == sorted(map(str, taken.select(again[0].__fields__).collect()))


def test_stages_survive_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, component string, decontam string, secrets string, copies string"
    rows = [(i, t, None, s, None, 1.0, "c", "d", "s", "x") for i, t, s in [(1, None, None), (2, "", "a"), (None, None, None), (None, "token=abcdefgh some words", "a"), (3, "token=abcdefgh some words", "a"), (3, "token=abcdefgh some words", "a"), (4, "long " * 50_000, "b")]]
    folder = f"file://{tmp_path}/in"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for k, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, schema)
        kept = staged(spark, docs, folder, tmp_path / str(k))
        assert all(x.columns == docs.columns for x in kept[:-1])
        if data:
            assert kept[1].count() == 7 and kept[2].count() == 3
            assert {r.text for r in kept[4].collect()} >= {"[SECRET] some words"}
        else:
            assert kept[-1].count() == 0


def test_no_stage_hides_an_import():
    assert [n for n, _ in pipeline.STAGES] and pipeline.ORACLE_SQL is None and secrets.RULES
