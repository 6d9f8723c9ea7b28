from math import comb

import pytest
from pyspark.sql import functions as F

from rankweave.functions import stats as S
from rankweave.operators.corpus import corpus
from rankweave.plans import core, evaluation


@pytest.mark.parametrize(("b", "c", "p"), [(15, 19, 0.6075913612730801), (24, 124, 1.892579550800977e-17), (38, 0, 7.275957614183426e-12), (0, 0, 1.0), (1, 1, 1.0)])
def test_mcnemar(spark, b, c, p):
    got = spark.range(1).select(S.mcnemar_p(F.lit(b), F.lit(c)).alias("p")).first()["p"]
    assert got == pytest.approx(p, rel=1e-9)


def test_mcnemar_of_thousands(spark):
    n, k = 3000, 1400
    want = 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n
    assert spark.range(1).select(S.mcnemar_p(F.lit(k), F.lit(n - k)).alias("p")).first()["p"] == pytest.approx(want, rel=1e-8)


def test_wilson(spark):
    rows = spark.createDataFrame([(163, 287), (0, 0), (0, 5), (5, 5)], "k int, n int").select(*S.wilson(F.col("k"), F.col("n"))).collect()
    assert rows[0][0] == pytest.approx(0.56794, abs=1e-5)
    assert rows[0][1:] == pytest.approx((0.51011, 0.62399), abs=1e-5)
    assert tuple(rows[1]) == (0.0, 0.0, 0.0)
    assert rows[2][1] == 0.0 and rows[3][2] == 1.0


@pytest.mark.parametrize("name", ["st3_bootstrap_gain", "st4_bootstrap_arms"])
def test_all_published_resamples(name):
    assert evaluation.RESAMPLES == 4000 and core.ORACLES[name].count("range(0, 4000)") == 1


def test_resamples_are_counted(spark, data):
    assert evaluation.bootstrap(corpus(spark, data), evaluation.RESAMPLES).select("rep").distinct().count() == 4000
