import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.plans import layers
from tabulon.plans.api import Data, Model, Train


def test_regression_and_split(spark, tmp_path):
    d = spark.range(200).select((F.col("id") / 100).alias("x"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("c"), (2 * F.col("id") / 100 + F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0)).alias("y"))
    data = Data.load().set(d).target("y").split(0.75)
    run = Train().epochs(60).run(spark, Model().layer(1).loss("mse").lr(0.1), data)
    assert run.history[-1] < 0.01 and run.history[0] > run.history[-1]
    s = run.scored()
    assert s.filter("__train").count() == 150
    assert s.filter("not __train").agg(F.avg(F.abs(F.col("raw") - F.col("prediction")))).first()[0] < 0.2
    run.save(str(tmp_path / "m.json"))


def test_text_test_source_resume_and_saved_models(spark, tmp_path):
    words = ["good", "fine", "bad", "poor"]
    rows = [(f"{words[k % 4]} thing {words[(k + k // 4) % 2]}", float(k % 9), 3.0 if k % 4 < 2 else -3.0) for k in range(120)]
    d = spark.createDataFrame([(f"{t} number {k} of the list", x, y) for k, (t, x, y) in enumerate(rows)], "note string, x double, y double")
    test = spark.createDataFrame([("unseen words only", None, 0.0), ("good thing", 2.0, 3.0)], "note string, x double, y double")
    data = Data.load().set(d).test(test).target("y")
    model = Model().layer(8, "tanh").layer(1).loss("mse").lr(0.1).optimizer("adam")
    run = Train().epochs(20).log(str(tmp_path / "log")).log_every(5).run(spark, model, data)
    assert [c["kind"] for c in run.schema.columns][0] == "text" and any("#t0" in n for n in run.schema.names)
    s = run.scored()
    assert s.filter("__train").count() == 120 and s.filter("not __train").count() == 2 and len((tmp_path / "log").read_text().splitlines()) == 4
    path = str(tmp_path / "m.json")
    assert run.save(path)
    again = Train.load(path)
    ask = d.withColumn("k", F.monotonically_increasing_id())
    assert dict(map(tuple, again.predict(ask, "k").collect())) == pytest.approx(dict(map(tuple, run.predict(ask, "k").collect())))
    assert again.predict(ask.drop("y"), "k").count() == 120
    more = Train().epochs(3).resume(path).run(spark, model, data)
    assert more.history[0] <= run.history[-1] * 1.5
    wide = Model().conv(3, 4, "relu").layer(1).loss("mse").lr(0.05)
    convolved = Train().epochs(6).run(spark, wide, data)
    assert convolved.history[-1] < convolved.history[0] and not Model().conv(2, 2).problems(0) == []
    worse = Train().epochs(1).run(spark, model, data, seed=9)
    assert not worse.save(path) and Train.load(path).history == [min(run.history)]


def test_folder_of_groups(spark, tmp_path):
    (tmp_path / "H1__meas.csv").write_text("a,y\n1,2\n2,4\n3,6\n")
    (tmp_path / "H2__meas.csv").write_text("a,y\n4,8\n5,10\n6,12\n7,14\n")
    (tmp_path / "H1__site.csv").write_text("height\n10\n")
    (tmp_path / "H2__site.csv").write_text("height\n20\n")
    (tmp_path / "H1__step.csv").write_text("s\n1\n2\n3\n")
    (tmp_path / "H2__step.csv").write_text("s\n4\n5\n6\n7\n")
    (tmp_path / "H9__odd.csv").write_text("q\n1\n")
    data = Data.load().set(str(tmp_path)).target("y")
    df = data.frame(spark)
    assert data.joined == {"site": "key", "step": "positional", "odd": "skip: no shared key"}
    got = sorted((int(r["meas:a"]), int(r["site:height"]), int(r["step:s"]), int(r["meas:y"])) for r in df.collect())
    assert got == [(k, 10 if k < 4 else 20, k, 2 * k) for k in range(1, 8)]
    run = Train().epochs(3).run(spark, Model().layer(1).loss("mse").lr(0.1), data)
    assert run.schema.target == "meas:y" and len(run.history) == 3
    with pytest.raises(ValueError):
        Data.load().set(str(tmp_path)).target("nothing").frame(spark)


def test_gradients_of_many_partitions(spark):
    from tabulon.plans import api

    d = spark.range(300).select((F.col("id") / 100).alias("x"), (F.col("id") * 0.02).alias("y")).repartition(api.FAN + 8)
    run = Train().epochs(2).run(spark, Model().layer(1).loss("mse").lr(0.1), Data.load().set(d).target("y"))
    few = Train().epochs(2).run(spark, Model().layer(1).loss("mse").lr(0.1), Data.load().set(d.coalesce(2)).target("y"))
    assert run.history == pytest.approx(few.history)


def test_preflight():
    with pytest.raises(ValueError):
        Data.load().split(1.0)
    assert Model().layer(2).loss("bce").problems(2) and Model().problems(0) and Model().layer(3).loss("ce").problems(2)
    assert not Model().layer(2).loss("ce").problems(2)


@pytest.mark.parametrize("kind", ["mse", "huber", "ce", "bce", "focal"])
def test_gradients_match_differences(kind):
    rng = np.random.default_rng(0)
    k = 3 if kind == "ce" else 1
    params = [{"w": rng.normal(size=(2, 4)), "b": rng.normal(size=4), "act": "tanh"}, {"w": rng.normal(size=(4, k)), "b": np.zeros(k), "act": "sigmoid" if kind in ("bce", "focal") else "linear"}]
    x, y = rng.normal(size=(5, 2)), np.eye(3)[[0, 1, 2, 1, 0]] if kind == "ce" else np.array([[0.0], [1], [1], [0], [1]])
    value = lambda: layers.loss_grad(kind, layers.forward(params, x)[-1][1], y)[0]
    t = layers.forward(params, x)
    grads = layers.backward(params, t, layers.loss_grad(kind, t[-1][1], y)[1])
    for p, (gw, _) in zip(params, grads):
        p["w"][0, 0] += 1e-6
        up = value()
        p["w"][0, 0] -= 2e-6
        down = value()
        p["w"][0, 0] += 1e-6
        assert gw[0, 0] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)


def test_convolution_gradients_match_differences():
    rng = np.random.default_rng(1)
    params = [{"w": rng.normal(size=(3, 2)), "b": rng.normal(size=2), "act": "tanh", "kind": "conv"}, {"w": rng.normal(size=(2, 2)), "b": rng.normal(size=2), "act": "sigmoid", "kind": "conv"}, {"w": rng.normal(size=(14, 1)), "b": np.zeros(1), "act": "linear", "kind": "dense"}]
    x, y = rng.normal(size=(4, 6)), rng.normal(size=(4, 1))
    t = layers.forward(params, x)
    assert [z.shape[1] for z, _ in t] == [6, 8, 14, 1]
    value = lambda: layers.loss_grad("mse", layers.forward(params, x)[-1][1], y)[0]
    grads = layers.backward(params, t, layers.loss_grad("mse", t[-1][1], y)[1])
    for p, (gw, gb) in zip(params, grads):
        for part, g in ((p["w"], gw), (p["b"], gb)):
            for at in np.ndindex(part.shape):
                part[at] += 1e-6
                up = value()
                part[at] -= 2e-6
                down = value()
                part[at] += 1e-6
                assert g[at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_attention_cache_gives_causal_attention():
    x = np.random.default_rng(2).normal(size=(6, 4))
    cache = layers.AttentionCache()
    assert np.array([cache.step(r, r, r) for r in x]) == pytest.approx(layers.attention(x, x, x, causal=True))


@pytest.mark.parametrize("kind", "sgd momentum nesterov adagrad rmsprop adadelta adam adamw nadam radam lamb lars lion".split())
def test_optimisers_go_down(kind):
    w, s = np.array([3.0, -2.0]), {}
    start = (w * w).sum()
    for _ in range(200):
        w = layers.step(kind, w, 2 * w, s, 0.01)
    assert (w * w).sum() < start


def test_layers():
    x = np.arange(12.0).reshape(3, 4)
    assert layers.rope(x)[0] == pytest.approx(x[0])
    a = layers.attention(x, x, x, causal=True)
    assert a[0] == pytest.approx(x[0])
    assert layers.multi_head(x, x[:, :2], x[:, :2], 2, 1).shape == (3, 4)
    img = np.arange(16.0).reshape(1, 4, 4)
    assert layers.conv2d(img, np.ones((1, 1, 2, 2))).shape == (1, 3, 3) and layers.pool2d(img, 2)[0, 0, 0] == 5.0 and layers.im2col(img, 2).shape == (9, 4)
    h, c = layers.lstm_cell(np.ones(2), np.zeros(3), np.zeros(3), np.zeros((2, 12)), np.zeros((3, 12)), np.zeros(12))
    assert h == pytest.approx(np.zeros(3)) and layers.gru_cell(np.ones(2), np.ones(3), np.zeros((2, 9)), np.zeros((3, 9)), np.zeros(9)) == pytest.approx(np.full(3, 0.5))
    assert layers.moe(x, np.zeros((4, 2)), [np.eye(4), 3 * np.eye(4)]) == pytest.approx(2 * x)


def test_streaming_once(spark, sf, tmp_path):
    from tabulon.streaming.events import read_events, run_once, tumbling

    src = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    s = tumbling(read_events(spark, str(tmp_path / "in"), src.schema), "ts", "event_type", "value", "1 day")
    run_once(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
