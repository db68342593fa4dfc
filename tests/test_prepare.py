import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import tidepanel as tp
from tidepanel.operators.instruments import by_period, equations, lag_block, layout, usable, whole_individuals
from tidepanel.operators.moments import by_cluster, fold, weighted_sum

FX1 = {"id": [1] * 4 + [2] * 4, "t": [1, 2, 3, 4] * 2, "y": [1.0, 2, 3, 4, 10, 11, 12, 13], "x": [10.0, 20, 30, 40, 100, 110, 120, 130]}
POS = {"id": [1] * 5 + [2] * 5, "t": [1, 2, 3, 4, 5] * 2, "y": [float(i) for i in range(2, 12)], "x": [float(i) for i in range(12, 22)]}


def rows(f):
    return f.rows().orderBy("id", "row_seq").toPandas()


def test_first_differences(spark):
    f = tp.prepare(FX1, "id", "t", "y ~ x", tp.DifferenceGMM())
    r = rows(f)
    assert (f.n_obs, f.n_groups) == (6, 2) and set(r.y) == {1.0} and all(x[0] == 10 for x in r.x) and not r.is_level.any()
    assert r[r.id == 1].t.tolist() == [2, 3, 4]
    r = rows(tp.prepare({k: FX1[k][:4] for k in ("id", "t", "y")}, "id", "t", "y ~ lag(y)", tp.DifferenceGMM()))
    assert [x[0] for x in r.x] == [1.0, 1.0]


def test_system_rows(spark):
    f = tp.prepare({k: v[:4] for k, v in FX1.items()}, "id", "t", "y ~ x", tp.SystemGMM())
    r = rows(f)
    assert f.n_obs == 5 and r[r.is_level].y.tolist() == [3.0, 4.0]


def test_names_and_exogenous(spark):
    p = lambda formula, **kw: tp.prepare(POS, "id", "t", formula, tp.DifferenceGMM(), **kw)
    assert p("log(y) ~ lag(log(y)) + log(x)").coef_names == ["L.log(y)", "log(x)"]
    f = p("y ~ lag(y) + lag(x, 0:1)", exog=["x", "L.x"])
    assert f.coef_names == ["L.y", "x", "L.x"] and f.exog_idx == [1, 2]
    f = p("y ~ lag(y) + x", time_effects=True)
    assert f.coef_names == ["L.y", "x", "t=3", "t=4", "t=5"] and f.exog_idx == [2, 3, 4]
    for e in ("z", "L.y"):
        with pytest.raises(tp.PanelError):
            p("y ~ lag(y) + x", exog=[e])
    with pytest.raises(tp.PanelError, match="no valid"):
        p("y ~ lag(y) + lag(x, 10)")


def test_short_groups(spark):
    d = {"id": [1] * 5 + [2] * 2, "t": [1, 2, 3, 4, 5, 1, 2], "y": [2.0, 3, 4, 5, 6, 10, 11], "x": [12.0, 13, 14, 15, 16, 20, 21]}
    f = tp.prepare(d, "id", "t", "y ~ lag(y) + lag(x, 3)", tp.DifferenceGMM())
    assert f.n_obs == 1 and set(rows(f).id) == {1} and f.n_groups == 2


def test_invalid_inputs(spark):
    from pyspark.sql import types as T

    spec = tp.DifferenceGMM()
    empty = spark.createDataFrame([], T.StructType([T.StructField(c, T.DoubleType()) for c in ("id", "t", "y", "x")]))
    bad = [
        (empty, "id", "t", "y ~ x"), (FX1, "no", "t", "y ~ x"), (FX1, "id", "no", "y ~ x"), (FX1, "id", "t", "y ~ no"),
        (FX1 | {"y": list("abcdefgh")}, "id", "t", "y ~ x"), (FX1 | {"x": [None] + FX1["x"][1:]}, "id", "t", "y ~ x"),
        (FX1 | {"id": list(range(8))}, "id", "t", "y ~ x"), (FX1, "id", "t", "lag(y) ~ x"), (FX1 | {"y": [-1.0] + FX1["y"][1:]}, "id", "t", "log(y) ~ x"),
        ({"id": [1] * 5, "t": [1, 2, 2, 3, 4], "y": [1.0, 2, 20, 3, 4], "x": [1.0] * 5}, "id", "t", "y ~ x"),
    ]
    for data, i, t, formula in bad:
        if isinstance(data, dict) and None in data.get("x", []):
            data = spark.createDataFrame([(i, t, float(y), x and float(x)) for i, t, y, x in zip(*data.values())], "id long, t long, y double, x double")
        with pytest.raises(ValueError):
            tp.prepare(data, i, t, formula, spec)
    with pytest.raises(TypeError):
        tp.prepare(42, "id", "t", "y ~ x", spec)
    with pytest.raises(tp.PanelError):
        tp.prepare(FX1, "id", "t", "y ~ x", tp.SystemGMM(), transform="fod")
    with pytest.raises(tp.PanelError):
        tp.prepare(FX1, "id", "t", "y ~ x", spec, transform="other")


def test_ids_and_times_may_be_strings_and_variables(spark):
    d = pd.DataFrame(POS).assign(id=lambda f: "firm" + f.id.astype(str))
    f = tp.prepare(d, "id", "t", "y ~ t + x", tp.DifferenceGMM())
    assert f.n_obs == 8 and set(rows(f).id) == {"firm1", "firm2"}


def frame(periods=4, exog=(), stacked=False):
    return tp.PanelFrame(None, ["x"], list(exog), list(range(1, periods + 1)), 2, "fd", stacked, "")


def laid_out(lay, y, t=(1, 2, 3, 4), stacked=False, clusters=None):
    """Equations of rows at the given periods; differences of neighbours."""
    y, t = np.array(y, float), np.array(t)
    cluster = np.zeros(len(t), int) if clusters is None else np.array(clusters)
    first = np.r_[True, cluster[1:] != cluster[:-1]]
    rn = np.arange(len(t)) - np.maximum.accumulate(np.where(first, np.arange(len(t)), 0)) + 1
    dy = np.where(first, np.nan, np.r_[np.nan, np.diff(y)])
    x = np.zeros((len(t), 1))
    # as with y ~ lag(y): equations from the third row of an individual on
    return equations(lay, by_period(lay), int(t.max()), stacked, cluster, t, t.astype(float), y, x, dy, x, rn >= 2, rn >= 3)


def test_instrument_blocks():
    y = [10, 20, 30, 40]
    lay = layout(tp.DifferenceGMM(), frame())
    # shallowest first within a period
    assert laid_out(lay, y).z.tolist() == [[0, 0, 0], [10, 0, 0], [0, 20, 10]]
    assert layout(tp.DifferenceGMM(), frame(), min_lag=3).width == 1 and layout(tp.DifferenceGMM(), frame(), max_lag=2).width == 2
    assert laid_out(layout(tp.DifferenceGMM(), frame(), collapse=True), y).z.tolist() == [[0, 0], [10, 0], [20, 10]]
    assert layout(tp.DifferenceGMM(), frame(), max_lags=1).width == 2
    lay = layout(tp.SystemGMM(), frame(stacked=True))
    e = laid_out(lay, y, stacked=True)
    assert lay.width == 5 and e.is_level.tolist() == [False] * 3 + [True] * 2
    assert e.z[3, 3] == 10 and e.z[4, 4] == 10 and not e.z[3:, :3].any()
    assert laid_out(layout(tp.AndersonHsiao(), frame()), y).z.ravel().tolist() == [0, 10, 20]
    # a period that is absent, and one individual's levels, are not another's instruments
    z = laid_out(layout(tp.AndersonHsiao(), frame(5)), [1, 2, 3, 7, 8, 9], t=[1, 3, 5, 2, 3, 4], clusters=[0, 0, 0, 1, 1, 1]).z
    assert z.ravel().tolist() == [1, 2, 0, 7]
    for spec in (tp.DifferenceGMM(), tp.SystemGMM()):
        assert layout(spec, frame(2)).width == 0
    assert [layout(s, frame(exog=[0])).width for s in (tp.DifferenceGMM(), tp.AndersonHsiao(), tp.SystemGMM())] == [4, 2, 7]
    for kw in (dict(min_lag=5, max_lag=3), dict(max_lags=0)):
        with pytest.raises(tp.PanelError):
            lag_block(4, "fd", **kw)
    assert usable(np.array([np.nan, 0.0, -1.0, np.inf])).tolist() == [0, 0, -1, np.inf]


def test_moments_of_individuals():
    lay = layout(tp.DifferenceGMM(), frame(5), collapse=True)
    r = np.random.default_rng(1)
    t = [1, 2, 3, 5, 1, 2, 3, 4, 5]
    e = laid_out(lay, r.normal(size=9), t, clusters=[0] * 4 + [1] * 5)
    want_m, want_s = [], 0
    for c in (0, 1):
        own = e.cluster == c
        z, at = e.z[own], e.t[own]
        h = 2 * np.eye(len(at)) - (np.abs(at[:, None] - at[None, :]) == 1)
        want_s = want_s + z.T @ h @ z
        want_m.append(z.T @ e.y[own])
    assert weighted_sum(e) == pytest.approx(want_s) and by_cluster(e)[1] == pytest.approx(np.array(want_m))


@pytest.mark.parametrize("parts,fan", [(1, 16), (7, 16), (30, 3), (30, 2)])
def test_partial_sums_fold_in_rounds(spark, parts, fan):
    """Sums and triangles of many tasks, also where there are more of them than was said."""
    r = np.random.default_rng(2)
    x, v = [r.normal(size=(5, 3)) for _ in range(41)], [r.normal(size=(2, 2)) for _ in range(41)]
    rows = [(i, k, a.tobytes()) for i in range(41) for k, a in (("rx", x[i]), ("s", v[i]))]
    df = spark.createDataFrame(rows, "slot int, kind string, a binary").repartition(3)
    got = fold(df, {"s": (2, 2), "rx": (0, 3), "none": (2,)}, parts, fan)
    assert got["s"] == pytest.approx(sum(v)) and got["none"].tolist() == [0, 0]
    whole = np.concatenate(x)
    assert got["rx"].T @ got["rx"] == pytest.approx(whole.T @ whole) and got["rx"].shape == (3, 3)


@pytest.mark.parametrize("most", [1, 3, 100])
def test_tables_hold_whole_individuals(most):
    rn = [1, 2, 3, 1, 2, 1, 2, 3, 4, 1]
    table = pa.table({"rn": rn, "v": list(range(10))})
    for cut in (1, 4, 10):
        parts = list(whole_individuals(iter(table.to_batches(max_chunksize=cut)), most))
        assert [v for p in parts for v in p.column("v").to_pylist()] == list(range(10))
        assert all(p.column("rn")[0].as_py() == 1 for p in parts)


def test_instrument_rows_equal_lookup(spark):
    d = pd.DataFrame(POS).query("not (id == 2 and t == 3)")
    f = tp.prepare(d, "id", "t", "y ~ lag(y) + x", tp.SystemGMM(), exog=["x"])
    z, lay = tp.build_instruments(tp.SystemGMM(), f)
    got = {(r.id, r.t, r.is_level, r.col): r.val for r in z.toPandas().itertuples()}
    panel = {(r.id, r.tidx): r for r in f.panel.toPandas().itertuples()}
    want = {}
    for r in rows(f).itertuples():
        if not r.is_level:
            want |= {(r.id, r.t, False, c): panel[r.id, p - o].y for (p, o), c in lay.lags.columns.items() if p == r.tidx and (r.id, p - o) in panel}
            want[r.id, r.t, False, lay.lags.width] = r.x[1]
        else:
            before = panel.get((r.id, r.tidx - 1))
            if before is not None and before.ok_diff:
                want[r.id, r.t, True, lay.level_start + lay.level_columns[r.tidx]] = before.dy
            want[r.id, r.t, True, lay.level_start + lay.level_width] = r.x[1]
    assert got == pytest.approx({k: v for k, v in want.items() if v})


def test_the_source_is_read_once(spark):
    """Checks, counts, moments and residuals start from one persisted exchange."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    source = spark.createDataFrame(pd.DataFrame(POS)).mapInArrow(count, "id bigint, t bigint, y double, x double")
    m = tp.fit(tp.DifferenceGMM(), source, formula="y ~ x", id_col="id", time_col="t")
    tp.residuals(m).count()
    assert seen.value == 10
    plan = m.rows._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan
    m.release()


def test_tables(spark, tmp_path):
    from tidepanel.sources.tables import as_dataframe, describe, preview, read_table, write_table

    d = as_dataframe([{"a": 1, "b": 2.0}, {"a": 2, "b": 3.0}])
    assert preview(d, 1).count() == 1 and describe(d, "b").count() > 3
    for kind in ("parquet", "csv", "json", "orc"):
        options = {"header": True} if kind == "csv" else {}
        write_table(d, str(tmp_path / kind), kind, **options)
        assert read_table(spark, str(tmp_path / kind), kind).count() == 2
