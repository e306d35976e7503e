import numpy as np
import pytest
from pyspark.sql import functions as F

from chaffline.operators import selection


def frame(spark, groups):
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g long, v double").repartition(5)


GROUPS = {
    1: np.random.default_rng(1).normal(size=4000),
    2: np.repeat([3.0, 3.0 + 1e-15, 4.0], [500, 1, 200]),
    3: [7.0],
    4: np.concatenate([10.0 ** np.arange(-300, 300, 3), -(10.0 ** np.arange(-300, 300, 3)), [0.0, 1.7e308, -1.7e308]]),
}


@pytest.mark.parametrize("buckets", [32, 1024])
def test_ranks_are_exact(spark, monkeypatch, buckets):
    monkeypatch.setattr(selection, "BUCKETS", buckets)
    groups = GROUPS if buckets > 32 else {2: GROUPS[2], 3: GROUPS[3], 5: GROUPS[1][:40]}
    wanted = {(g, r) for g, v in groups.items() for r in (0, len(v) // 3, len(v) // 2, len(v) - 1)}
    ranks = spark.createDataFrame([*wanted, (1, -1), (3, 1), (99, 0)], "g long, rank long")
    values = frame(spark, groups).union(spark.createDataFrame([(3, None), (3, float("nan")), (3, float("inf"))], "g long, v double"))
    got = {(r.g, r["rank"]): r.value for r in selection.select_ranks(values, "v", ranks, ["g"]).collect()}
    assert got == {(g, r): np.sort(groups[g])[r] for g, r in wanted}


def test_quantiles_equal_numpy(spark, monkeypatch):
    values = frame(spark, GROUPS)
    shares = [0.0, 0.02, 0.5, 0.9, 1.0]
    for r in selection.quantiles(values, "v", shares, ["g"]).collect():
        expected = np.quantile(GROUPS[r.g], shares)
        assert [r[f"q{i}"] for i in range(5)] == pytest.approx(expected, rel=1e-12)
    for few in (selection.FEW, 10):
        monkeypatch.setattr(selection, "FEW", few)
        whole = selection.quantiles(values.where("g = 1"), "v", [0.25]).first()
        assert whole.q0 == pytest.approx(np.quantile(GROUPS[1], 0.25), rel=1e-12)
        assert selection.quantiles(values.limit(0), "v", [0.5]).collect() == []


def test_no_range_exchange(spark):
    values = frame(spark, {1: GROUPS[1]})
    found = selection.select_ranks(values, "v", spark.createDataFrame([(1, 5)], "g long, rank long"), ["g"])
    assert "rangepartitioning" not in found._jdf.queryExecution().toString()
    assert found.where(F.col("value").isNull()).count() == 0
