from dataclasses import replace
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from oracle import estimate as oracle
from pyspark.sql import Window
from pyspark.sql import functions as F

import tidepanel as tp
from tidepanel.plans import report

ARGS = dict(formula="y ~ lag(y) + x", id_col="id", time_col="t")


def simulate(n, periods, seed, gaps=False):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        eta = r.normal()
        y = eta / 0.5 + r.normal()
        for t in range(-9, periods + 1):
            x = r.normal()
            y = 0.5 * y + 0.8 * x + eta + 0.5 * r.normal()
            if t >= 1 and not (gaps and r.random() < 0.15):
                rows.append((i, t, y, x))
    return pd.DataFrame(rows, columns=["id", "t", "y", "x"])


@pytest.fixture(scope="module")
def small():
    return simulate(120, 6, 3, gaps=True)


CASES = [
    ("difference", tp.DifferenceGMM(), {}, dict(robust=False)),
    ("difference", tp.DifferenceGMM(robust=True, steps=2), {}, dict(steps=2)),
    ("difference", tp.DifferenceGMM(robust=True), dict(transform="fod", collapse=True), dict(transform="fod", collapse=True)),
    ("system", tp.SystemGMM(robust=True, steps=2), dict(collapse=True), dict(steps=2, collapse=True)),
    ("system", tp.SystemGMM(robust=True, steps=2, windmeijer=False), {}, dict(steps=2, windmeijer=False)),
    ("ah", tp.AndersonHsiao(), {}, {}),
]


@pytest.mark.parametrize("kind,spec,options,same", CASES)
def test_against_dense_estimator(spark, small, kind, spec, options, same):
    m = tp.fit(spec, spark.createDataFrame(small.sample(frac=1, random_state=1)), exog=["x"], **ARGS, **options)
    want = oracle(small, kind, **same)
    assert (m.n_obs, m.n_instruments) == (want["n"], want["L"])
    assert m.coef == pytest.approx(want["beta"], rel=1e-8)
    assert tp.stderror(m) == pytest.approx(want["se"], rel=1e-7)
    assert m.j_stat == pytest.approx(want["j"], rel=1e-6, abs=1e-9)


def test_recovers_parameters_and_flags(spark):
    d = spark.createDataFrame(simulate(400, 6, 5)).repartition(7)
    m = tp.fit(tp.SystemGMM(robust=True, steps=2), d, exog=["x"], **ARGS)
    assert abs(m.coef[0] - 0.5) < 0.15 and abs(m.coef[1] - 0.8) < 0.15
    assert (m.robust, m.windmeijer, m.n_groups) == (True, True, 400)
    naive = tp.fit(tp.DifferenceGMM(), d, exog=["x"], steps=2, **ARGS)
    assert (naive.robust, naive.windmeijer) == (False, False) and naive.metadata["method"] == "2-step DifferenceGMM"
    few = tp.fit(tp.DifferenceGMM(robust=True), d, exog=["x"], max_lags=1, **ARGS)
    assert few.n_instruments < naive.n_instruments
    found = tp.diagnose(few, out=lambda *_: None)
    assert set(found) == {"sargan", "ar1", "ar2", "jarque_bera", "pseudo_r2"}
    assert found["ar1"].pvalue < 0.01 < found["ar2"].pvalue
    assert tp.ar_test(few, 1, cached=True) == found["ar1"]
    both = tp.diff_hansen_test(few, naive)
    assert both.dof == naive.n_instruments - few.n_instruments
    with pytest.raises(tp.PanelError):
        tp.diff_hansen_test(naive, few)
    assert tp.plot_data(few)["title"] == f"{few.n_obs} residuals of 400 ids"
    assert tp.plot_data(few, "residuals")["points"].count() == few.n_obs
    with pytest.raises(tp.PanelError):
        tp.plot_data(few, "nothing")
    text = str(few)
    assert "errors clustered by id" in text and "L.y" in text
    said = []
    renamed = replace(few, rows=few.rows.withColumnsRenamed({"id": "firm", "t": "year"}), metadata=dict(few.metadata, ar={}))
    assert tp.diagnose(renamed, said.append, id_col="firm", time_col="year") == found and not any("skipped" in x for x in said)
    assert set(tp.diagnose(renamed, said.append)) == {"sargan", "jarque_bera", "pseudo_r2"} and any("skipped" in x for x in said)
    few.release()


def test_guards(spark):
    d = pd.DataFrame({"id": [1] * 4 + [2] * 4, "t": [1, 2, 3, 4] * 2, "y": [1.0, 2, 4, 3, 10, 12, 11, 13], "x": [5.0, 6, 9, 8, 1, 2, 5, 3]})
    s = spark.createDataFrame(d.assign(z=2 * d.x))
    with pytest.raises(tp.PanelError, match="collinear"):
        tp.fit(tp.DifferenceGMM(), s, formula="y ~ x + z", id_col="id", time_col="t")
    with pytest.raises(tp.PanelError, match="under-identified"):
        tp.fit(tp.AndersonHsiao(), s, formula="y ~ lag(y) + x", id_col="id", time_col="t")
    with pytest.raises(tp.PanelError, match="at least 1"):
        tp.DifferenceGMM(steps=0)

    class Odd(tp.Spec):
        pass

    with pytest.raises(NotImplementedError, match="not implemented for Odd"):
        tp.fit(Odd(), s, formula="y ~ x", id_col="id", time_col="t")


def result(**kw):
    base = dict(spec=tp.DifferenceGMM(), coef=np.array([0.5, -0.2]), vcov=np.diag([0.01, 0.01]), coef_names=["L.y", "a_regressor_with_a_name_that_is_too_long"], n_obs=15, n_groups=5, n_instruments=10, j_stat=5.0, j_pval=0.2, weight=np.eye(10))
    return tp.PanelResult(**(base | kw))


def test_results_without_data():
    m = result()
    assert tp.sargan_test(m) == tp.TestResult("Sargan J-Test", 5.0, 8, 0.2)
    assert tp.sargan_test(result(n_instruments=2)).pvalue == 1.0
    w = tp.wald_test(m, [1, 0], 0.5)
    assert w.stat == pytest.approx(0, abs=1e-20) and w.dof == 1
    assert tp.wald_test(m, [1, 0], 0).pvalue < 0.01
    assert np.isfinite(tp.wald_test(m, [[1, 0], [1, 0]], [0, 0]).stat)
    with pytest.raises(tp.PanelError):
        tp.wald_test(m, [1, 0, 0], 0)
    assert "exceeds groups" in tp.check_proliferation(m)
    assert [report.significance_stars(p) for p in (0.0001, 0.005, 0.03, 0.08, 0.2, float("nan"))] == ["***", "**", "*", ".", "", ""]
    text = str(m)
    assert "J = 5.0000, 8 degrees of freedom, p = 0.2000" in text and "0.50000" in text and m.coef_names[1] in text
    assert "errors of equal variances" in text and tp.formula(m) == "N/A"
    assert (tp.coefnames(m), tp.ngroups(m), tp.ninstruments(m), tp.is_robust(m), tp.is_windmeijer(m)) == (m.coef_names, 5, 10, False, False)
    assert tp.coef(m) is m.coef and tp.vcov(m) is m.vcov
    assert tp.confint(m)[0] == pytest.approx([0.5 - 0.1959963985, 0.5 + 0.1959963985])
    assert (tp.dof(m), tp.dof_residual(m), tp.nobs(m), tp.nobs(m, True)) == (2, 13, 15, 5)
    assert tp.diff_hansen_test(result(), result(n_instruments=11, j_stat=3.0)).stat == 2.0
    assert tp.diff_hansen_test(result(), result(n_instruments=11, j_stat=9.0)).pvalue == 1.0
    with pytest.raises(tp.PanelError):
        result(coef_names=["a"])


def test_qq_has_every_residual(spark):
    m = tp.fit(tp.DifferenceGMM(), spark.createDataFrame(simulate(400, 6, 5)).repartition(7), exog=["x"], **ARGS)
    e = np.sort([r["residual"] for r in tp.residuals(m).select("residual").collect()])
    points = tp.plot_data(m, "qq")["points"].toPandas().sort_values("theoretical")
    assert len(points) == len(e) > 1000
    assert points["sample"].to_numpy() == pytest.approx((e - e.mean()) / e.std(ddof=1))
    assert points["theoretical"].to_numpy() == pytest.approx([NormalDist().inv_cdf((i + 0.5) / len(e)) for i in range(len(e))])


def test_residual_positions_at_size(spark):
    """Every place once, in order of id and row, over several partitions that are dealt by samples."""
    rows = spark.range(300_000, numPartitions=8).select((F.col("id") % 40_000).alias("id"), F.col("id").alias("row_seq"), F.rand(3).alias("std_resid"))
    out = report._positions(rows, ["id", "row_seq"])
    got = out.agg(F.count_distinct("idx").alias("n"), F.min("idx").alias("a"), F.max("idx").alias("b")).collect()[0]
    assert tuple(got) == (300_000, 1, 300_000)
    w = Window.orderBy("idx")
    before = out.withColumn("prior", F.lag(F.struct("id", "row_seq")).over(w))
    assert before.filter("struct(id, row_seq) <= prior").count() == 0
