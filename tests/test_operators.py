import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import guards
from tabulon.functions.special import special
from tabulon.operators import boost, distance, encode, joins, ml, neural, ordering, reduce, sequence, shape, window


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_ieee_guards(spark):
    d = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in d.select(guards.ieee_div(F.col("a"), F.col("b"))).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 2.0 and got[4] is None
    ln = [r[0] for r in spark.createDataFrame([(0.0,), (-1.0,), (1.0,)], "x double").select(guards.ieee_ln(F.col("x"))).collect()]
    assert ln[0] == -math.inf and math.isnan(ln[1]) and ln[2] == 0.0


def test_strict_double(spark):
    cells = ["1", " 1", "1d", "1e3", "-inf", "abc", "", None, ".5", "5."]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(guards.strict_double(F.col("c"))).collect()]
    assert got == [1.0, None, None, 1000.0, -math.inf, None, None, None, 0.5, 5.0]


def test_nan_comparisons(spark):
    d = spark.createDataFrame([(math.nan, 1.0)], "a double, b double")
    assert tuple(d.select(*[guards.compare(F.col("a"), op, F.col("b")) for op in ("gt", "lt", "eq", "ge", "le", "ne")]).first()) == (0.0, 0.0, 0.0, 0.0, 0.0, 1.0)


def test_segments(spark):
    d = spark.createDataFrame([(0, 1.0), (0, 5.0), (1, 3.0), (1, 2.0), (3, 4.0)], "s int, x double")
    assert rows(reduce.segment(d, "s", "x", 4), "segment") == [(0, 6.0, 5.0), (1, 5.0, 3.0), (2, 0.0, -1.7976931348623157e308), (3, 4.0, 4.0)]


def test_bins_and_quantize(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (-1.0,)], "x double")
    assert [r[0] for r in d.select(encode.quantize(F.col("x"), [0, 1, 2, 3])).collect()] == [0, 1, 2, 2, 0]
    assert d.filter("x >= 0").agg(encode.bin_edges_uniform(F.min("x"), F.max("x"), 3)).first()[0] == [0.0, 1.0, 2.0, 3.0]


def test_discounted_returns_and_runs(spark):
    d = spark.createDataFrame([("a", k, 1.0) for k in range(3)], "g string, t int, r double")
    assert rows(window.discounted(d, ["g"], ["t"], "r", 0.5, "ret"), "t") == [("a", 0, 1.75), ("a", 1, 1.5), ("a", 2, 1.0)]
    e = spark.createDataFrame([("a", k, v) for k, v in enumerate([1, 1, 2, 3, 3, 3])], "g string, t int, x int")
    assert [r[2:] for r in rows(window.runs(e, ["g"], ["t"], "x"), "run")] == [(1, 2), (2, 1), (3, 3)]


def test_ordered_target_stats(spark):
    d = spark.createDataFrame([(0, 0, 10.0), (1, 1, 20.0), (2, 0, 30.0), (3, 1, 40.0)], "k int, c int, y double")
    assert [r[0] for r in encode.ordered_target_stats(d, "c", "y", ["k"], 0.0, 1.0).orderBy("k").select("ts").collect()] == [0.0, 0.0, 5.0, 10.0]
    # One category with nearly all rows, dealt over ranges; a null category is one of its own.
    rows_ = [(k, "hot" if k % 50 else None, float(k % 7)) for k in range(400)]
    got = encode.ordered_target_stats(spark.createDataFrame(rows_, "k int, c string, y double"), "c", "y", ["k"], 0.5, 2.0)
    seen, want = {}, {}
    for k, c, y in rows_:
        total, n = seen.get(c, (0.0, 0))
        want[k], seen[c] = (total + 1.0) / (n + 2.0), (total + y, n + 1)
    assert {r["k"]: r["ts"] for r in got.collect()} == pytest.approx(want)


def test_naive_bayes_log_prob(spark):
    counts = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3), (1, "a", 4), (1, "b", 5), (1, "c", 6)], "cls int, f string, n long")
    got = {(r[0], r[1]): r[2] for r in ml.nb_log_prob(counts, "cls", "f", 3).collect()}
    assert got[(0, "a")] == pytest.approx(math.log(2) - math.log(9)) and got[(1, "c")] == pytest.approx(math.log(7) - math.log(18))


def test_graphs(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "src long, dst long")
    assert rows(ml.components(e), "node") == [(0, 2), (1, 2), (2, 2), (3, 4), (4, 4)]
    w = spark.createDataFrame([(0, 1, 1.0), (1, 2, 5.0), (2, 3, 2.0), (0, 3, 10.0)], "src long, dst long, w double")
    assert tuple(ml.spanning_forest(w).agg(F.count("*"), F.sum("w")).first()) == (3, 8.0)


def test_spmv_and_gemm(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 9.0), (2, 2, 1.0), (2, 0, 2.0)], "i int, j int, v double")
    x = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "j int, x double")
    assert rows(ml.spmv(m, x), "i") == [(0, 5.0), (1, 18.0), (2, 5.0)]
    dense = np.zeros((3, 3))
    for i, j, v in m.collect():
        dense[i, j] = v
    for i, j, v in ml.gemm(m, m).collect():
        assert v == pytest.approx((dense @ dense)[i, j])


def test_core_distance(spark):
    p = spark.createDataFrame([(k, [float(v)]) for k, v in enumerate([0, 1, 2, 10])], "id long, v array<double>")
    got = distance.core_distance(p.select(F.col("id").alias("q"), F.col("v").alias("qv")), p.select(F.col("id").alias("t"), F.col("v").alias("tv")), 2)
    assert rows(got, "q") == [(0, 2.0), (1, 1.0), (2, 2.0), (3, 9.0)]


def test_viterbi_dtw_smo_pairs():
    trans, emit = np.array([[0.7, 0.3], [0.4, 0.6]]), np.array([[0.9, 0.2], [0.1, 0.8], [0.9, 0.2]])
    assert sequence.viterbi(trans, emit) == [0, 1, 0]
    assert sequence.forward_backward(trans, emit).sum(axis=1) == pytest.approx([1, 1, 1])
    assert sequence.dtw(np.abs(np.subtract.outer([0, 1, 2], [0, 0, 1, 2]))) == 0.0
    x, y = np.array([[0.0], [1.0], [3.0], [4.0]]), np.array([-1.0, -1, 1, 1])
    a, b = sequence.smo(x @ x.T, y, 10.0)
    assert all(np.sign((a * y) @ (x @ x.T) + b) == y)
    assert sequence.byte_pairs("aab", {(97, 97): 0, (256, 98): 1}) == [257]


def test_linalg_groups(spark):
    m = spark.createDataFrame([("g", 0, 0, 4.0), ("g", 0, 1, 2.0), ("g", 1, 0, 2.0), ("g", 1, 1, 3.0)], "g string, i int, j int, v double")
    got = {(r["i"], r["j"]): r["v"] for r in sequence.per_group(m, "g", "cholesky").collect()}
    assert got[(1, 0)] == pytest.approx(1.0) and got[(1, 1)] == pytest.approx(math.sqrt(2))
    f = sequence.fft_rows(spark.createDataFrame([([1.0, 0.0, -1.0, 0.0],)], "v array<double>"), "v").first()["spectrum"]
    assert f[1]["re"] == pytest.approx(2.0)
    t = sequence.dtw_pairs(spark.createDataFrame([([0.0, 1.0], [0.0, 1.0, 1.0])], "a array<double>, b array<double>"), "a", "b")
    assert t.first()["dtw"] == 0.0


def test_special_functions(spark):
    d = spark.createDataFrame([(0.5,), (None,)], "x double")
    got = d.select(*[special(n, F.col("x")).alias(n) for n in ("erf", "erfinv", "ndtri", "digamma", "i0", "j0", "y0", "y1")]).collect()
    want = {"erf": 0.5204998778, "erfinv": 0.4769362762, "ndtri": 0.0, "digamma": -1.9635100260, "i0": 1.0634833707, "j0": 0.9384698072, "y0": -0.4445187335, "y1": -1.4714723927}
    for k, v in want.items():
        assert got[0][k] == pytest.approx(v, abs=1e-5), k
        assert got[1][k] is None


def test_split_is_exact_and_repeatable(spark):
    d = spark.range(1001)
    a, b = (encode.exact_split(d, "id", 0.3).filter("in_train").select("id").collect() for _ in range(2))
    assert len(a) == 300 and set(a) == set(b)


def test_kinds(spark):
    data = [("2024-01-15", "a", "site_1.png", str(k * 1.5), "a long and unique sentence number %d" % k, str(k % 2)) for k in range(20)]
    d = spark.createDataFrame(data, "when string, cat string, photo string, num string, note string, flag string")
    got = {r[0]: r[1] for r in encode.kinds(encode.profile(d)).collect()}
    assert got == {"when": "temporal", "cat": "categorical", "photo": "image", "num": "numeric", "note": "text", "flag": "categorical"}
    assert spark.createDataFrame([("2024-01-15",)], "d string").select(encode.pseudo_days(F.col("d"))).first()[0] == pytest.approx(2024 * 365.25 + 30.44 + 15)


def test_joins(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k int, a int")
    b = spark.createDataFrame([(1, 10), (1, 20), (2, 30)], "k int, b int")
    assert rows(joins.positional_join(a, b, "k", ["a"], ["b"]), "a") == [(1, 1, 10), (1, 2, 20), (2, 3, 30)]
    assert joins.admission(a, b, "k").first()["verdict"] == "positional"
    assert joins.admission(a, spark.createDataFrame([(9, 1)], "k int, b int"), "k").first()["verdict"] == "skip: no shared key"
    img = spark.createDataFrame([("p/site_1.png",), ("q/site_2.png",)], "f string")
    assert joins.best_stem_column(img, ["f"], spark.createDataFrame([("site_1",)], "s string"), "s") == "f"


def test_padding_rules(spark):
    d = spark.createDataFrame([("g", k, float(k)) for k in range(4)], "g string, p int, v double")
    want = {"constant": [0, 0, 0, 1, 2, 3, 0], "replicate": [0, 0, 0, 1, 2, 3, 3], "circular": [2, 3, 0, 1, 2, 3, 0], "reflect": [2, 1, 0, 1, 2, 3, 2]}
    for rule, values in want.items():
        assert [r["v"] for r in shape.pad(d, ["g"], "p", "v", 4, 2, 1, rule).orderBy("p").collect()] == values


def test_argsort_spans_ranges(spark):
    d = spark.range(200).select(F.col("id"), (F.col("id") * 37 % 200).alias("x"))
    assert all(r["place"] == r["x"] for r in ordering.argsort(d, "x", "id").collect())


def test_causal_softmax(spark):
    v = spark.createDataFrame([([1.0, 1.0, 5.0],)], "v array<double>").select(neural.causal_softmax(F.col("v"), F.lit(1))).first()[0]
    assert v == pytest.approx([0.5, 0.5, 0.0])


@pytest.mark.parametrize("kind", ["level", "leaf", "oblivious"])
def test_boosters(spark, kind):
    d = spark.createDataFrame([(k / 100, 2 * k / 100 + 1, float(k > 50)) for k in range(100)], "x double, y double, c double")
    b = boost.Booster(kind=kind, rounds=12, depth=3, leaves=8, rate=0.5, lam=0.1, bins=64).fit(d, ["x"], "y")
    assert b.predict(d).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.05
    c = boost.Booster(kind=kind, rounds=4, depth=2, leaves=4, rate=0.5, objective="logistic").fit(d, ["x"], "c")
    assert c.predict(d).agg(F.avg(((F.col("prediction") > 0.5) == (F.col("c") > 0.5)).cast("double"))).first()[0] >= 0.95
    with pytest.raises(ValueError):
        boost.Booster(kind=kind).fit(spark.createDataFrame([(float("nan"), 1.0)], "x double, y double"), ["x"], "y")


def test_booster_for_many_classes(spark):
    rng = np.random.default_rng(4)
    centres = {"a": (0, 0), "b": (3, 0), "c": (0, 3)}
    data = [(float(x + rng.normal(0, 0.6)), float(y + rng.normal(0, 0.6)), name) for name, (x, y) in centres.items() for _ in range(60)]
    d = spark.createDataFrame(data, "x double, z double, y string")
    b = boost.Booster(kind="leaf", rounds=4, leaves=4, rate=0.5, objective="multiclass", bins=16).fit(d, ["x", "z"], "y")
    assert b.predict(d).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] >= 0.9
    p = b.predict_proba(d)
    assert p.columns == ["x", "z", "y", "probabilities"] and all(len(r[0]) == 3 and abs(sum(r[0]) - 1) < 1e-9 for r in p.select("probabilities").collect())
    with pytest.raises(ValueError):
        boost.Booster().fit(d.withColumn("y", F.lit(1.0)), ["x"], "y").predict_proba(d)


def test_booster_with_categories_and_draws(spark):
    """A categorical column decides the target; an unseen value and a null get a prediction as well."""
    data = [(f"v{k % 6}", float(k % 11), float(10 * (k % 6) + 1)) for k in range(240)]
    d = spark.createDataFrame(data, "c string, x double, y double")
    b = boost.Booster(kind="oblivious", rounds=10, depth=3, rate=0.5, lam=0.1, bins=24, subsample=0.8, colsample=1.0).fit(d, ["c", "x"], "y", categorical=["c"])
    assert b.predict(d).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 6
    odd = b.predict(spark.createDataFrame([("new", 1.0), (None, 2.0)], "c string, x double")).collect()
    assert len(odd) == 2 and all(0 < r["prediction"] < 60 for r in odd) and b.predict(d).columns == ["c", "x", "y", "prediction"]


def test_bundled_features(spark):
    """Features of which one at a time is set share a column and give the same fit."""
    data = [tuple(float(1 + k % 5) if k % 8 == f else 0.0 for f in range(8)) + (float((k % 8) * 2 + k % 5),) for k in range(200)]
    d = spark.createDataFrame(data, ", ".join(f"f{f} double" for f in range(8)) + ", y double")
    names = [f"f{f}" for f in range(8)]
    assert sorted(map(sorted, boost.bundle_features(d, names))) == [names]
    assert len(boost.bundle_features(d.withColumn("f1", F.lit(1.0)), names)) == 2
    errors = []
    for bundling in (False, True):
        b = boost.Booster(kind="level", rounds=6, depth=5, rate=0.6, lam=0.1, bins=8, bundling=bundling).fit(d, names, "y")
        assert len(b.columns) == (1 if bundling else 8)
        errors.append(b.predict(d).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0])
    assert errors[1] < max(0.5, errors[0] + 0.15)


def test_order_statistics_by_ranges(spark, monkeypatch):
    """Exact ranks and quantiles where the driver may take few values: ties, negatives, nulls, ranks beyond the end."""
    import numpy as np

    from tabulon.operators import ordering

    monkeypatch.setattr(ordering, "FEW", 40)
    rng = np.random.default_rng(2)
    values = [*rng.normal(0, 100, 4000).round(1).tolist(), *[7.0] * 900, *[-500.0] * 30]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "x double")
    ranks = [0, 1, 29, 30, 1500, 2400, len(values) - 1, len(values)]
    got = ordering.order_statistics(df, "x", ranks)
    assert got == {r: sorted(values)[r] if r < len(values) else None for r in ranks}
    assert np.allclose(ordering.quantiles(df, "x", [0, 0.1, 0.5, 0.99, 1]), np.quantile(values, [0, 0.1, 0.5, 0.99, 1]))
    assert ordering.quantiles(df.filter("false"), "x", [0.5]) == [None]


def test_recurrence_over_several_blocks(spark, monkeypatch):
    import numpy as np

    from tabulon.operators import window

    monkeypatch.setattr(window, "BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = [(g, k, float(a), float(b)) for g, n in ((None, 70), ("x", 1), ("y", 33)) for k, (a, b) in enumerate(rng.normal(0, 1, (n, 2)))]
    got = {(r["g"], r["k"]): r["h"] for r in window.recurrence(spark.createDataFrame(rows, "g string, k long, a double, b double"), ["g"], ["k"], "a", "b").collect()}
    h, want = {}, {}
    for g, k, a, b in rows:
        h[g] = want[g, k] = a * h.get(g, 0.0) + b
    assert set(got) == set(want) and all(np.isclose(got[k], want[k]) for k in want)


def test_scalar_functions_on_odd_values(spark):
    """NaN, infinities, zeros of both signs and ordinary numbers against numpy."""
    import numpy as np
    from pyspark.sql import functions as F

    from tabulon.functions.scalar import BINARY, UNARY

    inf, nan = np.inf, np.nan
    values = [nan, inf, -inf, 0.0, -0.0, 0.5, -0.5, 1.0, -1.0, 2.0, -2.5, 3.0, 1e300, -1e-300, 5e-324]
    pairs = [(x, y) for x in values for y in values]
    df = spark.createDataFrame([(float(k), x, y) for k, (x, y) in enumerate(pairs)], "k double, x double, y double")
    one = {"asin": np.arcsin, "acos": np.arccos, "atanh": np.arctanh, "sqrt": np.sqrt, "rsqrt": lambda x: 1 / np.sqrt(x), "reciprocal": lambda x: 1 / x, "floor": np.floor, "ceil": np.ceil, "trunc": np.trunc, "ln": np.log, "log2": np.log2, "log10": np.log10, "log1p": np.log1p,
           "logit": lambda x: np.log(x / (1 - x)), "exp": np.exp, "expm1": np.expm1, "cbrt": np.cbrt, "tanh": np.tanh, "relu": lambda x: np.fmax(x, 0), "square": lambda x: x * x, "abs": np.abs, "sign": lambda x: np.nan_to_num(np.sign(x))}
    two = {"div": np.divide, "fmod": np.fmod, "maximum": np.fmax, "minimum": np.fmin, "copysign": np.copysign, "hypot": np.hypot, "pow": np.power, "floor_divide": lambda x, y: np.floor(x / y), "remainder": lambda x, y: x - np.floor(x / y) * y, "nextafter": np.nextafter,
           "ldexp": lambda x, y: x * np.exp2(y), "xlogy": lambda x, y: np.where(x == 0, 0, x * np.log(y)), "squared_difference": lambda x, y: (x - y) ** 2}
    got = df.orderBy("k").select("x", "y", *[UNARY[n](F.col("x")).alias(n) for n in one], *[BINARY[n](F.col("x"), F.col("y")).alias(n) for n in two]).collect()
    x, y = (np.array([p[i] for p in pairs]) for i in (0, 1))
    skipped = {("copysign", k) for k in range(len(pairs)) if np.isnan(pairs[k][1])} | {("pow", k) for k, (a, b) in enumerate(pairs) if abs(a) == 1 and not np.isfinite(b)} | {("hypot", k) for k, (a, b) in enumerate(pairs) if np.isnan(a) or np.isnan(b)}
    with np.errstate(all="ignore"):
        for name, fn in [*((n, lambda f=f: f(x)) for n, f in one.items()), *((n, lambda f=f: f(x, y)) for n, f in two.items())]:
            want = fn()
            for k, r in enumerate(got):
                if (name, k) not in skipped:
                    assert r[name] is not None and (np.isclose(r[name], want[k], rtol=1e-12, atol=0) or r[name] == want[k] or np.isnan(r[name]) and np.isnan(want[k])), (name, pairs[k], r[name], want[k])


def test_graphs_contracted_over_many_tasks(spark, monkeypatch):
    """A chain in ranges, a graph whose ranges hardly shrink, hubs, loops and copies of edges, against union-find; no round spreads labels along a chain."""
    monkeypatch.setattr(ml, "EDGES_PER_TASK", 40)
    rng = np.random.default_rng(5)
    chain = [(k, k + 1) for k in range(400) if k % 50]
    mixed = chain + [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 300, (220, 2))] + [(2000, 2000 + k) for k in range(90)] + [(5, 5), (9999, 9999), (1, 2)]

    def union(edges):
        top = {x: x for e in edges for x in e}
        find = lambda x: x if top[x] == x else find(top[x])
        joins = []
        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            joins.append(a != b)
            top[a] = b
        return {(x, find(x)) for x in top}, joins

    for edges in (chain, mixed):
        got = ml.components(spark.createDataFrame(edges, "src long, dst long")).collect()
        assert sorted(map(tuple, got)) == sorted(union(edges)[0])
    with monkeypatch.context() as m:
        m.setattr(ml, "_spread", None)
        assert len(ml.components(spark.createDataFrame(chain, "src long, dst long")).collect()) == 400
    weighed = sorted({(float((a * 7 + b * 3) % 11), min(a, b), max(a, b)) for a, b in mixed if a != b})
    want = [e for e, j in zip(weighed, union([e[1:] for e in weighed])[1]) if j]
    got = ml.spanning_forest(spark.createDataFrame(weighed, "w double, src long, dst long").repartition(7)).collect()
    assert sorted((r["w"], r["src"], r["dst"]) for r in got) == want


def test_itemsets_of_items_that_never_meet(spark, monkeypatch):
    """2,000 frequent items that meet in pairs only: no candidates are joined from them."""
    monkeypatch.setattr(ml, "join_itemsets", None)
    items = [(b, 2 * (b // 2) + k) for b in range(2000) for k in (0, 1)] + [(b, i) for b in (5000, 5001) for i in (7, 1, 4)] + [(5002, i) for i in (1, 4, 4)]
    got = {tuple(r["items"]): r["support"] for r in ml.frequent_itemsets(spark.createDataFrame(items, "b long, i long"), "b", "i", 2, 4).collect()}
    assert sum(len(s) == 1 for s in got) == 2000 and len(got) == 2000 + 1000 + 3 + 1
    assert got[(1, 4)] == 3 and got[(1, 4, 7)] == 2 and got[(0, 1)] == 2


def test_block_pairs_match_the_columns(spark, monkeypatch):
    """Groups of a few rows; zeros of both signs, NaN, ties of rounding, vectors of another length, with nulls and null: all pairs, as the columns have them."""
    monkeypatch.setattr(distance, "GROUP_QUERIES", 3)
    monkeypatch.setattr(distance, "GROUP_TRAIN", 4)
    rng = np.random.default_rng(2)
    v = [[float(x) for x in r] for r in np.round(rng.normal(size=(20, 3)), 3)] + [[0.0, -0.0, 0.5], [math.nan, 1.0, 2.0], [0.25, 1.0, 0.0], [1.0, 2.0], [1.0, None, 2.0], None]
    d = spark.createDataFrame(list(enumerate(v)), "t long, tv array<double>")
    q, pair = d.filter("t % 2 = 0 or t > 20").selectExpr("t as q", "tv as qv"), (F.col("qv"), F.col("tv"))
    key = lambda df: sorted((r["q"], r["t"], *[repr(x) for x in r[2:]]) for r in df.collect())
    for name, made in distance.BLOCK_METRICS.items():
        got = distance.all_pairs(q, d, made, {"d": distance.METRICS[name](*pair)}, {"d": 5})
        assert key(got) == key(distance.query_pairs(q, d).select("q", "t", F.round(distance.METRICS[name](*pair), 5)))
    assert distance.all_pairs(q.limit(0), d, distance.kernels, {k: F.lit(0.0) for k in ("rbf", "linear", "poly", "sig")}, {"rbf": 6, "linear": 5, "poly": 5, "sig": 6}).count() == 0
    x = np.array([0.000005, -0.000005, 1.000015, 2.5, -1e-9, 0.1234549999, 1e300, math.inf, math.nan, 123456.789005])
    want = [r[0] for r in spark.createDataFrame([(float(a),) for a in x], "x double").select(F.round("x", 5)).collect()]
    assert list(map(repr, map(float, distance.rounded(x, 5)))) == list(map(repr, want))


def test_outer_rounded_goes_by_the_binary_product(spark):
    """Cells next to a half, where the decimal form lies on its other side, and nulls, which keep their cells."""
    v = [0.01 * k for k in (1, -1, 50, 1250, 99999, -43021, 868064, -718)] + [-478.35905 + 1e-13 * k for k in range(-9, 9)] + [None, math.nan, 0.0]
    w = [1.0, 0.01, -0.37]
    x = spark.createDataFrame(list(enumerate(v)), "i long, v double")
    y = spark.createDataFrame(list(enumerate(w)), "j long, w double")
    want = {}
    for (i, a), (j, b) in [(p, q) for p in enumerate(v) for q in enumerate(w)]:
        c = None if a is None else a * b + 1e-7
        want[i, j] = c if c is None or math.isnan(c) else math.copysign(math.floor(abs(c) * 1e4 + 0.5) / 1e4, c) + 0.0
    got = {(r["i"], r["j"]): r["v"] for r in shape.outer_rounded(x, y, 4, 1e-7).collect()}
    assert {k: repr(c) for k, c in got.items()} == {k: repr(c) for k, c in want.items()}
