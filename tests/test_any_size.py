"""Operators that no longer refuse or copy rows past a size."""

from __future__ import annotations

import glob
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from featflow.operators import impute as I
from featflow.operators import quantiles as K
from featflow.operators.encode import OneHot, SparseOneHot
from featflow.operators.scale import YeoJohnson
from featflow.operators.stats import corr_long, describe
from featflow.sources.files import fill_template, read_csv, write_csv


def test_quantiles_of_100_000_groups(spark):
    df = spark.range(300_000).select((F.col("id") % 100_000).alias("g"), (F.col("id") * 7919 % 1013 * 1.0).alias("x"))
    got = K.group_quantiles(df, ["x"], [0.25, 0.5], ["g"])
    assert got.count() == 100_000
    for r in got.where("g in (0, 7, 99999)").collect():
        values = [(r["g"] + 100_000 * k) * 7919 % 1013 for k in range(3)]
        assert r["q"] == [float(np.quantile(values, p)) for p in (0.25, 0.5)] and r["n"] == 3


def test_group_quantiles_with_null_groups_and_values(spark):
    rng = np.random.default_rng(4)
    rows = [(None if k % 5 == 0 else ("hot" if k % 3 else f"g{k % 4}"), None if k % 11 == 0 else float(rng.integers(0, 30)), float("nan")) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r["q"] for r in K.group_quantiles(df, ["x", "y"], [0.0, 0.1, 0.5, 1.0], ["g"]).collect()}
    for g in {r[0] for r in rows}:
        values = [x for a, x, _ in rows if a == g and x is not None]
        assert np.allclose(got[g], np.quantile(values, [0.0, 0.1, 0.5, 1.0]))
    told = {(r["g"], r["column"]): r for r in describe(df, ["x"], ["g"]).collect()}
    assert told[None, "x"]["p50"] == got[None][2] and told["hot", "x"]["count"] > 0


@pytest.mark.parametrize("strategy", ["median", "mean", "mode"])
def test_impute_by_many_groups(spark, monkeypatch, strategy):
    rows = [(k % 40, None if k % 3 == 0 else float(k * 31 % 7), None if k % 4 == 0 else "ab"[k * 13 % 5 % 2]) for k in range(800)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "g long, x double, s string")
    cols = ["x", "s"] if strategy == "mode" else ["x"]
    few = I.Impute(cols, strategy=strategy, by="g").fit(df)
    monkeypatch.setattr(I, "MAX_GROUPS", 5)
    many = I.Impute(cols, strategy=strategy, by="g").fit(df)
    assert "path" in many.fitted and "by_group" in few.fitted
    order = lambda m: sorted(map(str, m.transform(df).collect()))
    assert order(many) == order(few) and many.transform(df).columns == df.columns


def test_mode_takes_the_lowest_of_equals(spark):
    df = spark.createDataFrame([("b", 2, 1.5), ("a", 2, None), ("a", 1, 2.5), ("b", 1, 2.5), (None, None, None)], "s string, i int, d double")
    assert I.Impute(["s", "i", "d"], strategy="mode").fit(df).fitted["values"] == {"s": "a", "i": 1, "d": 2.5}


def test_sparse_one_hot_equals_one_hot(spark):
    rows = [("a", "x"), ("b", None), (None, "y"), ("a", "y")]
    df = spark.createDataFrame(rows, "p string, q string")
    new = spark.createDataFrame([*rows, ("never", "x")], "p string, q string")
    for na in (False, True):
        wide = OneHot(["p", "q"], dummy_na=na, drop_input=False).fit(df).transform(new)
        names = [c for c in wide.columns if c not in ("p", "q")]
        want = sorted((str(r["p"]), str(r["q"]), tuple(float(r[n]) for n in names)) for r in wide.collect())
        model = SparseOneHot(["p", "q"], dummy_na=na).fit(df)
        both = VectorAssembler(inputCols=["p_vec", "q_vec"], outputCol="v").transform(model.transform(new))
        got = sorted((str(r["p"]), str(r["q"]), tuple(r["v"])) for r in both.select("p", "q", vector_to_array("v").alias("v")).collect())
        assert got == want


def test_sparse_one_hot_of_many_levels(spark):
    n = 1_000_000
    df = spark.range(n).select(F.format_string("level%07d", "id").alias("c"))
    model = SparseOneHot(["c"]).fit(df)
    assert model.fitted["sizes"] == {"c": n} and "path" in model.fitted["codes"]
    some = spark.createDataFrame([("level0000000",), ("level0999999",), ("level0500000",), ("none",), (None,)], "c string")
    got = {r["c"]: r["c_vec"] for r in model.transform(some).collect()}
    assert got["level0500000"].size == n and got["level0500000"].indices.tolist() == [500_000] and got["level0999999"].indices.tolist() == [999_999]
    assert got["none"].numNonzeros() == got[None].numNonzeros() == 0


def test_correlation_blocks_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 7)) * [1, 1e3, 1e-3, 1, 1, 1, 1] + [0, 1e5, 0, 3, 0, 0, 0]
    x[:, 4], x[:, 5] = x[:, 0] + 0.1 * x[:, 3], 7.25
    hole = rng.random(x.shape) < 0.2
    hole[:, 6] = True
    names = [f"c{i}" for i in range(7)]
    df = spark.createDataFrame([tuple(None if h else float(v) for v, h in zip(r, m)) for r, m in zip(x, hole)], ", ".join(f"{n} double" for n in names)).repartition(5)
    for block in (128, 2):
        got = {(r["a"], r["b"]): r["corr"] for r in corr_long(df, names, block).collect()}
        assert len(got) == 49
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                ok = ~hole[:, i] & ~hole[:, j]
                if 5 in (i, j) or 6 in (i, j):
                    assert got[a, b] is None
                else:
                    assert abs(got[a, b] - np.corrcoef(x[ok, i], x[ok, j])[0, 1]) < 1e-9


def test_yeo_johnson_passes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    columns = {"wide": rng.lognormal(0, 1.2, 900), "left": -rng.lognormal(0, 0.7, 900), "mixed": rng.normal(0.4, 2, 900) ** 3, "zero": np.expm1(np.abs(rng.normal(1, 0.3, 900)))}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], ", ".join(f"{c} double" for c in columns))
    calls = []
    real = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: calls.append(1) or real(self))
    stats = YeoJohnson(list(columns)).fit(df).fitted
    assert len(calls) <= 4

    def likelihood(x, lam):
        up = np.log1p(np.abs(x)) if lam == 0 else (np.power(1 + np.abs(x), lam) - 1) / lam
        down = np.log1p(np.abs(x)) if lam == 2 else (np.power(1 + np.abs(x), 2 - lam) - 1) / (2 - lam)
        t = np.where(x >= 0, up, -down)
        return -len(x) / 2 * math.log(t.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    for c, x in columns.items():
        grid = [round(stats[c][0] + k / 1000, 3) for k in range(-400, 401)]
        best = max(grid, key=lambda lam: likelihood(x, lam))
        assert abs(best - stats[c][0]) <= 1e-3


def test_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", é'), (2, "나이"), (3, None)], "id long, `이름` string").coalesce(1)
    for header in (True, False):
        path = str(tmp_path / f"out{header}")
        write_csv(df, path, encoding="utf-8-sig", header=header)
        parts = [open(f, "rb").read() for f in glob.glob(path + "/part-*")]
        assert parts and all(p.startswith(b"\xef\xbb\xbf") and p.count(b"\xef\xbb\xbf") == 1 for p in parts if p)
    back = read_csv(spark, str(tmp_path / "outTrue"), "id long, name string", encoding="utf-8-sig")
    assert sorted(map(tuple, back.collect())) == [(1, 'a "quoted", é'), (2, "나이"), (3, None)]
    korean = str(tmp_path / "korean")
    write_csv(df, korean, encoding="EUC-KR")
    assert "나이".encode("euc-kr") in b"".join(open(f, "rb").read() for f in glob.glob(korean + "/part-*"))


def test_a_failed_write_leaves_no_part(spark, tmp_path):
    bad = spark.range(8).select(F.expr("if(id = 7, raise_error('no'), id)").alias("id"))
    with pytest.raises(Exception, match="no"):
        write_csv(bad, str(tmp_path / "bad"), encoding="utf-8-sig")
    assert not glob.glob(str(tmp_path / "bad") + "/part-*")


def test_fill_template(spark):
    template = spark.createDataFrame([("T0", 5, 0.0), ("T1", 3, 0.0), ("T2", 9, 0.0)], "ID string, k long, probability double")
    got = fill_template(template, spark.createDataFrame([(3, 0.25), (5, 0.5), (8, 1.0)], "k long, probability double"), "k")
    assert sorted((r["ID"], r["k"], r["probability"]) for r in got.collect()) == [("T0", 5, 0.5), ("T1", 3, 0.25), ("T2", 9, None)]
