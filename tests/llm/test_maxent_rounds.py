"""What a gradient round sends to the driver: one row of the model's size, from however many tasks."""

import numpy as np

from moments.llm import maxent

RULES = maxent.MaxentRules(frequent=100, own_forms=8, endings=8, classes=4, own_previous=8, previous=16, trigrams=8, rounds=3)


def test_rounds_send_one_row(spark, tmp_path, monkeypatch):
    rnd = np.random.RandomState(1)
    table = rnd.randint(0, 50, (RULES.previous, RULES.classes**2))
    rows = [(k, blob.as_py()) for k, blob in enumerate(maxent._blobs(table))]
    spark.createDataFrame(rows, "key long, counts binary").repartition(8).write.parquet(str(tmp_path / "t"))
    tables = spark.read.parquet(str(tmp_path / "t"))
    sent, collect = [], type(tables).collect

    def counted(df):
        out = collect(df)
        sent.append(len(out))
        return out

    monkeypatch.setattr(type(tables), "collect", counted)
    model = maxent.train(tables, RULES)
    monkeypatch.undo()
    assert sent == [1] * RULES.rounds

    # the first step by hand: from no weights all classes have one chance, and each weight moves by the rate in the direction of its gradient
    counts = table.reshape(-1, RULES.classes)
    one = maxent.train(tables, maxent.MaxentRules(**{**RULES.__dict__, "rounds": 1}))
    bias = (counts - counts.sum(axis=1, keepdims=True) / RULES.classes).sum(axis=0)
    assert np.allclose(one.weights[0][0], RULES.rate * np.sign(bias), atol=1e-3)
    assert all(np.isfinite(w).all() for w in model.weights)


def test_no_histories(spark):
    none = spark.createDataFrame([], "key long, counts binary")
    assert all((w == 0).all() for w in maxent.train(none, RULES).weights)
