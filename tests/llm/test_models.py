"""The trained operators: gradients, calibration, bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import language_id, mixing, quality_model

SF = "/root/testdata/sf0.1"


def test_gradients_are_the_derivatives():
    r = np.random.RandomState(2)
    begin = np.array([0, 3, 4, 9])
    x, y, weight = r.normal(size=(9, quality_model.WIDTH)), np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.3, 0.2])
    model = quality_model.Model(np.zeros(quality_model.WIDTH), np.ones(quality_model.WIDTH))
    model.p["w"] = r.normal(size=quality_model.GATE)
    loss = lambda: float(-(weight * np.where(y > 0, np.log(s := model.forward(x, begin)["s"]), np.log(1 - s))).sum())
    grad = model.gradients(x, model.forward(x, begin), y, weight)
    for name, g in grad.items():
        flat = model.p[name].reshape(-1)
        for k in r.choice(len(flat), min(6, len(flat)), replace=False):
            keep = flat[k]
            flat[k] = keep + 1e-6
            up = loss()
            flat[k] = keep - 1e-6
            down = loss()
            flat[k] = keep
            assert g.reshape(-1)[k] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_training_texts_are_bounded(spark, monkeypatch):
    rows = [(i, ("good words here " if i % 2 else "## $$ %% ") * 30) for i in range(200)] + [(999, "good words here " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality_model, "TRAIN_BYTES", 20_000)
    got = {x.doc_id: x.predicted for x in quality_model.score(docs, labels).collect()}
    assert len(got) == 201 and np.mean([got[i] == i % 2 for i in range(200)]) > 0.98 and got[999] == 1


def test_language_is_calibrated_on_rows_not_counted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(8)
    noise = [(10**9 + i, " ".join("".join(r.choice("qxzwkjvh") for _ in range(7)) for _ in range(60)), None) for i in range(50)]
    got = language_id.identify(docs.unionByName(spark.createDataFrame(noise, docs.schema))).join(docs.select("doc_id", "lang"), "doc_id", "left")
    own = got.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert own[0] > 0.98 and own[1] < 0.03  # RATE is 0.005 of clean calibration rows
    assert got.where("doc_id >= 1000000000").agg(F.avg(F.col("rejected").cast("int"))).first()[0] > 0.95


def test_language_with_few_rows_and_a_small_model(spark):
    rows = [(i, "the cat and the dog and the house", "en") for i in range(60)] + [(100, "el gato y el perro y la casa", "es"), (101, "el perro", None), (102, "12 34", "en"), (103, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for cells in (language_id.CELLS, 40):
        got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, cells).collect()}
        assert got[0] == "en" and got[102] == got[103] == "und" and len(got) == len(rows)
        if cells == language_id.CELLS:
            assert got[100] == got[101] == "es"


def test_language_beyond_what_a_task_holds_is_the_same(spark):
    """No n-gram is left out where the model is larger than a task may hold: with some keys held, and with none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = [(10**9 + i, t, v) for i, (t, v) in enumerate([("a", None), ("El", "es"), ("12 34", "en"), ("", "en"), (None, "en"), ("漢字仮名交じり文を書く", "ja"), ("漢字", None), ("\U00010400\U00010401 \U00010428", None), ("qxz " * 40, None), ("the cat", "en"), ("the cat", "en")])] + [(None, "la casa", "es")]
    docs = docs.unionByName(spark.createDataFrame(odd * 2, docs.schema))
    rows = lambda cells: sorted((tuple(r) for r in language_id.identify(docs, cells).collect()), key=lambda r: (str(r[0]), r[2]))
    want = rows(language_id.CELLS)
    assert {r[2] for r in want} == {"de", "en", "es", "fr", "ja", "und"} and any(r[4] for r in want)
    for cells in (20_000, 1):
        got = rows(cells)
        assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
        assert np.abs(np.array([r[3] for r in got]) - [r[3] for r in want]).max() < 1e-4


def test_emit_gives_the_copies_that_the_digest_takes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({c: F.lit("own") for c in ("__mix_size", "__mix_copies", "__mix_source")})
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.digest(docs).collect()}
    out = mixing.emit(docs)
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert out.columns == docs.columns and out.where("__mix_size <> 'own' or __mix_copies <> 'own' or __mix_source <> 'own'").count() == 0
    assert all(t == s * counts.get(d, 0) for d, (t, s) in taken.items())
