import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions.mathx import norm_cdf, norm_ppf, z_value
from granary.functions import prefix
from granary.functions.prefix import exact_quantiles, running_totals


def test_running_totals_with_one_hot_key(spark):
    rows = [(0 if i % 3 else i % 7, i * 37 % 1009, i, (i * 13) % 11 - 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, id long, v long").repartition(5)
    got = {(r.k, r.id): (r.run, r.run_total, r.position, r.position_total)
           for r in running_totals(df, [F.col("o"), F.col("id")], {"run": "v"}, keys=("k",)).collect()}
    for k, grp in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        grp = list(grp)
        total, run = sum(r[3] for r in grp), 0
        for n, r in enumerate(grp, 1):
            run += r[3]
            assert got[(k, r[2])] == (run, total, n, len(grp))


@pytest.mark.parametrize("parts", [1, 8])
def test_running_totals_ignore_layout(spark, parts):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 7 % 101).alias("v")).repartition(parts)
    out = running_totals(df, [F.col("v").desc(), F.col("id")], {"run": "v"})
    rows = sorted(out.collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1, 501))
    assert [r.v for r in rows] == sorted((r.v for r in rows), reverse=True)
    assert rows[-1].run == rows[0].run_total == sum(r.v for r in rows)


def test_exact_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 1, 3, 2, 4)] + [(None,)], "v double")
    assert exact_quantiles(df, "v", [0.2, 0.5, 0.0, 1.0]).first()[0] == pytest.approx([1.8, 3.0, 1.0, 10.0])
    assert exact_quantiles(df.where("v is null"), "v", [0.5]).first()[0] == [None]


@pytest.mark.parametrize("accuracy", [5, 100, 10_000])
def test_quantiles_with_ties_equal_numpy(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    values = np.concatenate([np.repeat([3.0, 7.0], 2000), rng.normal(5, 4, 3000), np.full(10, -1e9)])
    df = spark.createDataFrame([(float(x),) for x in values], "v double").repartition(5)
    fractions = [0.0, 0.01, 0.2, 0.5, 0.77, 0.999, 1.0]
    got = exact_quantiles(df, "v", fractions, accuracy).first()[0]
    np.testing.assert_allclose(got, np.quantile(values, fractions))


def test_only_the_bracket_is_ranked(spark, monkeypatch):
    ranked = []
    own = prefix.running_totals
    monkeypatch.setattr(prefix, "running_totals", lambda df, *a, **k: ranked.append(df.count()) or own(df, *a, **k))
    df = spark.range(200_000).selectExpr("cast(hash(id) as double) as v")
    exact_quantiles(df, "v", [0.2, 0.5])
    assert len(ranked) == 2 and sum(ranked) < 0.02 * 200_000


def test_normal_distribution(spark):
    df = spark.createDataFrame([(0.85,), (0.9,), (0.95,), (0.99,)], "p double")
    for r in df.select("p", norm_ppf(F.col("p")).alias("z"), norm_cdf(norm_ppf(F.col("p"))).alias("back")).collect():
        assert r.z == pytest.approx(z_value(r.p), abs=3e-9)
        assert r.back == pytest.approx(r.p, abs=1e-7)
