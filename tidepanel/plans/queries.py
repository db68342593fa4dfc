"""Registered panel queries and the same computations in SQL.

Panels are derived from the driver's tables: (id, t, y, x), one row an id and period.
Numbers are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formula import Formula, TermSpec, lag, parse_formula, parse_term
from ..functions.linalg import ridge_if_singular
from ..operators import instruments as inst
from ..operators import moments as mom
from ..operators.prepare import balance, duplicates, prepare, time_index, transformed
from ..sources import tables
from ..specs import AndersonHsiao, DifferenceGMM, PanelResult, Spec, SystemGMM
from . import diagnostics as diag
from . import gmm_sql as G
from . import report
from .gmm import estimate, fit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: name: (query over the tables) with columns id, t, y, x
PANELS = {
    "supp_year": "SELECT l_suppkey AS id, CAST(year(l_shipdate) AS INT) AS t, ln(sum(l_extendedprice)) AS y, ln(sum(l_quantity)) AS x FROM lineitem GROUP BY 1, 2",
    "part_year": "SELECT l_partkey AS id, CAST(year(l_shipdate) AS INT) AS t, ln(sum(l_extendedprice)) AS y, ln(sum(l_quantity)) AS x FROM lineitem GROUP BY 1, 2",
    "cust_year": "SELECT o_custkey AS id, CAST(year(o_orderdate) AS INT) AS t, ln(sum(o_totalprice)) AS y, ln(CAST(count(*) + 1 AS DOUBLE)) AS x FROM orders GROUP BY 1, 2",
    "conv_turn": "SELECT conv_id AS id, CAST(turn AS INT) AS t, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS y, CAST(max(length(role)) AS DOUBLE) AS x FROM conversations GROUP BY 1, 2",
    "nation_qtr": "SELECT c_nationkey AS id, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS INT) AS t, ln(sum(o_totalprice)) AS y, ln(CAST(count(*) + 1 AS DOUBLE)) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "user_day": "SELECT user_id AS id, CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS t, sum(value) AS y, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY 1, 2",
}


def panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A panel by the DataFrame API."""
    read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    year = lambda c: F.year(c).alias("t")
    if name in ("supp_year", "part_year"):
        key = "l_suppkey" if name == "supp_year" else "l_partkey"
        return read("lineitem").groupBy(F.col(key).alias("id"), year("l_shipdate")).agg(F.log(F.sum("l_extendedprice")).alias("y"), F.log(F.sum("l_quantity")).alias("x"))
    count = F.log((F.count(F.lit(1)) + 1).cast("double")).alias("x")
    if name == "cust_year":
        return read("orders").groupBy(F.col("o_custkey").alias("id"), year("o_orderdate")).agg(F.log(F.sum("o_totalprice")).alias("y"), count)
    if name == "conv_turn":
        return read("conversations").groupBy(F.col("conv_id").alias("id"), F.col("turn").cast("int").alias("t")).agg(
            F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("y"), F.max(F.length("role")).cast("double").alias("x"))
    if name == "nation_qtr":
        both = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return both.groupBy(F.col("c_nationkey").alias("id"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("t")).agg(F.log(F.sum("o_totalprice")).alias("y"), count)
    if name == "user_day":
        return read("events").groupBy(F.col("user_id").alias("id"), F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("t")).agg(F.sum("value").alias("y"), F.count(F.lit(1)).cast("double").alias("x"))
    raise KeyError(name)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _r(c, digits=6):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


# Fragments of SQL that the oracles share. l: levels with positions; d: differenced rows of y ~ lag(y) + x.
def _l(p: str) -> str:
    return f"p AS ({PANELS[p]}), tm AS (SELECT t, CAST(row_number() OVER (ORDER BY t) AS INT) AS tidx FROM (SELECT DISTINCT t FROM p)), l AS (SELECT * FROM (SELECT id, p.t, tidx, y, x, row_number() OVER (PARTITION BY id ORDER BY p.t) AS rn, count(*) OVER (PARTITION BY id) AS n_t, lag(y) OVER (PARTITION BY id ORDER BY p.t) AS ly FROM p JOIN tm ON p.t = tm.t) WHERE n_t >= 3)"


def _d(p: str) -> str:
    return _l(p) + ", d AS (SELECT * FROM (SELECT id, t, tidx, rn, y - lag(y) OVER w AS dy, ly - lag(ly) OVER w AS dly, x - lag(x) OVER w AS dx FROM l WINDOW w AS (PARTITION BY id ORDER BY t)) WHERE dly IS NOT NULL)"


def _fod(p: str) -> str:
    star = lambda c: f"sqrt(CAST(n_t - rn AS DOUBLE) / (n_t - rn + 1)) * ({c} - sum({c}) OVER f / (n_t - rn))"
    return _l(p) + f", fo AS (SELECT * FROM (SELECT id, t, tidx, rn, n_t, ly, {star('y')} AS sy, {star('ly')} AS sly, {star('x')} AS sx FROM l WINDOW f AS (PARTITION BY id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) WHERE rn < n_t AND ly IS NOT NULL)"


@query("panel_balance", f"WITH p AS ({PANELS['cust_year']}), n AS (SELECT id, count(*) AS n FROM p GROUP BY 1) SELECT count(*) AS n_ids, min(n) AS min_periods, max(n) AS max_periods, round(avg(n), 6) AS mean_periods FROM n")
def _(spark, d):
    return balance(panel(spark, d, "cust_year"), "id").withColumn("mean_periods", _r("mean_periods"))


@query("panel_validate_duplicates", "SELECT o_custkey AS id, CAST(year(o_orderdate) AS INT) AS t, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("t"))
    return duplicates(o, "id", "t")


@query("time_index", f"WITH p AS ({PANELS['nation_qtr']}) SELECT t, CAST(dense_rank() OVER (ORDER BY t) AS INT) AS tidx FROM (SELECT DISTINCT t FROM p)")
def _(spark, d):
    p = panel(spark, d, "nation_qtr")
    times = [r["t"] for r in p.select("t").distinct().orderBy("t").collect()]  # periods: few by nature
    return time_index(p, times).select("t", "tidx").distinct()


def _frame(spark, d, p, formula, spec=DifferenceGMM(), **options):
    return prepare(panel(spark, d, p), "id", "t", formula, spec, count=False, **options)


def _levels(spark, d, p, formula):
    return _frame(spark, d, p, formula).panel


@query("lag1", f"WITH {_l('cust_year')} SELECT id, t, round(y, 6) AS y, round(coalesce(ly, -999), 6) AS ly FROM l")
def _(spark, d):
    return _levels(spark, d, "cust_year", "y ~ lag(y)").select("id", "t", _r("y").alias("y"), _r(F.nanvl(F.col("x")[0], F.lit(-999.0))).alias("ly"))


@query("lag_range_0_2", f"WITH {_l('cust_year')} SELECT id, t, round(x, 6) AS x0, round(coalesce(lag(x, 1) OVER w, -999), 6) AS x1, round(coalesce(lag(x, 2) OVER w, -999), 6) AS x2 FROM l WINDOW w AS (PARTITION BY id ORDER BY t)")
def _(spark, d):
    return _levels(spark, d, "cust_year", "y ~ lag(x, 0:2)").select("id", "t", *(_r(F.nanvl(F.col("x")[i], F.lit(-999.0))).alias(f"x{i}") for i in range(3)))


@query("lag_deeper_than_group", f"WITH {_l('cust_year')} SELECT id, count(*) AS n, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM (SELECT id, lag(x, 5) OVER (PARTITION BY id ORDER BY t) AS v FROM l) GROUP BY 1")
def _(spark, d):
    p = _levels(spark, d, "cust_year", "y ~ lag(x, 5)")
    return p.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.isnan(F.col("x")[0]).cast("long")).alias("missing"))


for _fn, _sql in (("log", "ln(o_totalprice)"), ("log10", "log10(o_totalprice)"), ("log2", "log2(o_totalprice)"), ("exp", "exp(o_totalprice / 1000000)"), ("sqrt", "sqrt(o_totalprice)"), ("abs", "abs(o_totalprice - 100000)")):

    def _transform(spark, d, fn=_fn):
        o = spark.read.parquet(f"{d}/orders.parquet")
        v = F.col("o_totalprice") / 1000000 if fn == "exp" else F.col("o_totalprice") - 100000 if fn == "abs" else F.col("o_totalprice")
        return o.select("o_orderkey", v.alias("v")).select("o_orderkey", _r(transformed(TermSpec("v", fn))).alias("value"))

    query(f"transform_{_fn}", f"SELECT o_orderkey, round({_sql}, 6) AS value FROM orders")(_transform)


@query("first_difference", f"WITH {_d('part_year')} SELECT id, t, round(dy, 6) AS dy, round(dly, 6) AS dly, round(dx, 6) AS dx FROM d")
def _(spark, d):
    r = _frame(spark, d, "part_year", "y ~ lag(y) + x").rows()
    return r.select("id", "t", _r("y").alias("dy"), _r(F.col("x")[0]).alias("dly"), _r(F.col("x")[1]).alias("dx"))


@query("forward_orthogonal_deviation", f"WITH {_fod('cust_year')} SELECT id, t, round(sy, 6) AS sy, round(sly, 6) AS sly FROM fo")
def _(spark, d):
    r = _frame(spark, d, "cust_year", "y ~ lag(y)", transform="fod").rows()
    return r.select("id", "t", _r("y").alias("sy"), _r(F.col("x")[0]).alias("sly"))


@query("level_rows", f"WITH {_l('cust_year')} SELECT id, t, round(y, 6) AS y, round(ly, 6) AS ly FROM l WHERE rn >= 3")
def _(spark, d):
    r = _frame(spark, d, "cust_year", "y ~ lag(y)", SystemGMM()).rows().filter("is_level")
    return r.select("id", "t", _r("y").alias("y"), _r(F.col("x")[0]).alias("ly"))


@query("system_stack", f"WITH {_d('supp_year')} SELECT id, t, FALSE AS is_level, round(dy, 6) AS y, round(dly, 6) AS ly FROM d UNION ALL SELECT id, t, TRUE, round(y, 6), round(ly, 6) FROM l WHERE rn >= 3")
def _(spark, d):
    r = _frame(spark, d, "supp_year", "y ~ lag(y) + x", SystemGMM()).rows()
    return r.select("id", "t", "is_level", _r("y").alias("y"), _r(F.col("x")[0]).alias("ly"))


@query("time_dummies_diff", f"WITH {_d('supp_year')}, c AS (SELECT t AS period FROM tm WHERE tidx >= 3), g AS (SELECT l.id, l.t, period, CASE WHEN l.t = period THEN 1.0 ELSE 0.0 END - CASE WHEN lag(l.t) OVER (PARTITION BY l.id, period ORDER BY l.t) = period THEN 1.0 ELSE 0.0 END AS v FROM l CROSS JOIN c) SELECT g.id, g.t, g.period, CAST(v AS DOUBLE) AS v FROM g JOIN d ON d.id = g.id AND d.t = g.t WHERE v <> 0")
def _(spark, d):
    f = _frame(spark, d, "supp_year", "y ~ lag(y) + x", time_effects=True)
    n = len(f.coef_names) - len(f.valid_times[2:])
    cells = F.explode(F.arrays_zip(F.array(*(F.lit(int(p)) for p in f.valid_times[2:])).alias("period"), F.slice("x", n + 1, len(f.coef_names)).alias("v")))
    return f.rows().select("id", "t", cells.alias("c")).select("id", "t", F.col("c.period").alias("period"), F.col("c.v").alias("v")).filter("v != 0")


def _ab(p: str, order: str, column: str, offset: int = 1, rows: str = "d", extra: str = "") -> str:
    return f"""SELECT r.id, r.t, CAST({column} AS INT) AS col, round(h.y, 6) AS val FROM {rows} r
      CROSS JOIN (SELECT unnest(generate_series(1, 40)) AS o) o JOIN l h ON h.id = r.id AND h.tidx = r.tidx - o
      WHERE o >= {offset + 1} AND o <= r.tidx - 1 {order} AND h.y <> 0 {extra}"""


def _coo(spark, d, p, spec=DifferenceGMM(), formula="y ~ lag(y) + x", transform="fd", exog=(), **options):
    rows, _ = inst.build_instruments(spec, _frame(spark, d, p, formula, spec, transform=transform, exog=exog), **options)
    return rows.select("id", "t", "col", _r("val").alias("val"))


@query("instruments_ab_coo", f"WITH {_d('supp_year')} {_ab('supp_year', '', '(r.tidx - 2) * (r.tidx - 3) / 2 + o - 2')}")
def _(spark, d):
    return _coo(spark, d, "supp_year")


@query("instruments_ab_collapsed", f"WITH {_d('cust_year')} {_ab('cust_year', '', 'o - 2')}")
def _(spark, d):
    return _coo(spark, d, "cust_year", collapse=True)


@query("instruments_ab_minmaxlag", f"WITH {_d('supp_year')} {_ab('supp_year', 'AND o BETWEEN 3 AND 4', 'o - 3')}")
def _(spark, d):
    return _coo(spark, d, "supp_year", collapse=True, min_lag=3, max_lag=4)


@query("instruments_ab_fod", f"WITH {_fod('supp_year')} {_ab('supp_year', '', '(r.tidx - 1) * (r.tidx - 2) / 2 + o - 1', 0, 'fo')}")
def _(spark, d):
    return _coo(spark, d, "supp_year", transform="fod")


@query("instruments_level_coo", f"WITH {_d('supp_year')} SELECT r.id, r.t, CAST(1 + r.tidx - 3 AS INT) AS col, round(h.dy, 6) AS val FROM l r JOIN d h ON h.id = r.id AND h.tidx = r.tidx - 1 WHERE r.rn >= 3 AND h.dy <> 0")
def _(spark, d):
    s = SystemGMM()
    rows, lay = inst.build_instruments(s, _frame(spark, d, "supp_year", "y ~ lag(y) + x", s), collapse=False, max_lags=1)
    # level columns are counted after the lag block, which differs from the SQL's by its width
    return rows.filter("is_level").select("id", "t", (F.col("col") - lay.level_start + 1).cast("int").alias("col"), _r("val").alias("val"))


@query("instruments_ah", f"WITH {_d('part_year')} SELECT r.id, r.t, CAST(0 AS INT) AS col, round(h.y, 6) AS val FROM d r JOIN l h ON h.id = r.id AND h.tidx = r.tidx - 2 WHERE h.y <> 0")
def _(spark, d):
    return _coo(spark, d, "part_year", AndersonHsiao())


@query("instruments_exog", f"WITH {_d('part_year')} SELECT id, t, CAST(1 AS INT) AS col, round(dx, 6) AS val FROM d WHERE dx <> 0")
def _(spark, d):
    return _coo(spark, d, "part_year", AndersonHsiao(), exog=["x"]).filter("col = 1")


# Closed forms: K = 1 (y ~ lag(y)) with the first two collapsed lags, and Anderson-Hsiao with K = 2
def _k1(p: str) -> str:
    z = lambda o: f"coalesce((SELECT h.y FROM l h WHERE h.id = d.id AND h.tidx = d.tidx - {o}), 0.0)"
    return f"{_d(p)}, z AS (SELECT d.id, d.t, dy, dly, dx, {z(2)} AS z1, {z(3)} AS z2 FROM d)"


def _ahz(p: str) -> str:
    return f"{_d(p)}, z AS (SELECT d.id, d.t, dy, dly, dx, coalesce(h.y, 0.0) AS z1, dx AS z2 FROM d LEFT JOIN l h ON h.id = d.id AND h.tidx = d.tidx - 2)"


def _moments(spark, d, p, spec, formula, exog=(), difference=True, **options):
    f = _frame(spark, d, p, formula, spec, exog=exog)
    return f, mom.collect_moments(f, inst.layout(spec, f, **options), difference)


@query("moments_ztx_zty", f"WITH {_k1('cust_year')} SELECT round(sum(z1 * dly), 4) AS zx1, round(sum(z2 * dly), 4) AS zx2, round(sum(z1 * dy), 4) AS zy1, round(sum(z2 * dy), 4) AS zy2 FROM z")
def _(spark, d):
    _, m = _moments(spark, d, "cust_year", DifferenceGMM(), "y ~ lag(y)", collapse=True, max_lags=2)
    return spark.createDataFrame([(*(round(float(v), 4) for v in m.zx[:, 0]), *(round(float(v), 4) for v in m.zy))], "zx1 double, zx2 double, zy1 double, zy2 double")


@query("moments_ztz", f"WITH {_ahz('part_year')} SELECT round(sum(z1 * z1), 4) AS s11, round(sum(z1 * z2), 4) AS s12, round(sum(z2 * z2), 4) AS s22 FROM z")
def _(spark, d):
    _, m = _moments(spark, d, "part_year", AndersonHsiao(), "y ~ lag(y) + x", ["x"], False)
    s = m.first
    return spark.createDataFrame([tuple(round(float(v), 4) for v in (s[0, 0], s[0, 1], s[1, 1]))], "s11 double, s12 double, s22 double")


_ZHZ = "h AS (SELECT 2 * sum(z1 * z1) AS a, 2 * sum(z1 * z2) AS b, 2 * sum(z2 * z2) AS c FROM z), n1 AS (SELECT coalesce(sum(2 * a.z1 * b.z1), 0) AS a, coalesce(sum(a.z1 * b.z2 + a.z2 * b.z1), 0) AS b, coalesce(sum(2 * a.z2 * b.z2), 0) AS c FROM z a JOIN z b ON a.id = b.id AND b.t = a.t + 1), zhz AS (SELECT h.a - n1.a AS a, h.b - n1.b AS b, h.c - n1.c AS c FROM h, n1)"


@query("moments_zhz", f"WITH {_k1('cust_year')}, {_ZHZ} SELECT round(a, 4) AS s11, round(b, 4) AS s12, round(c, 4) AS s22 FROM zhz")
def _(spark, d):
    _, m = _moments(spark, d, "cust_year", DifferenceGMM(), "y ~ lag(y)", collapse=True, max_lags=2)
    s = m.first
    return spark.createDataFrame([tuple(round(float(v), 4) for v in (s[0, 0], s[0, 1], s[1, 1]))], "s11 double, s12 double, s22 double")


_AH = "m AS (SELECT sum(z1 * dly) AS a, sum(z1 * dx) AS b, sum(z2 * dly) AS c, sum(z2 * dx) AS e, sum(z1 * dy) AS g1, sum(z2 * dy) AS g2, count(*) AS n FROM z), b AS (SELECT (e * g1 - b * g2) / (a * e - b * c) AS b_ly, (a * g2 - c * g1) / (a * e - b * c) AS b_x, a * e - b * c AS det, * FROM m)"


def _ah(spark, d, p="part_year"):
    return fit(AndersonHsiao(), panel(spark, d, p), formula="y ~ lag(y) + x", id_col="id", time_col="t", exog=["x"])


@query("ah_coef", f"WITH {_ahz('part_year')}, {_AH} SELECT round(b_ly, 6) AS b_ly, round(b_x, 6) AS b_x, n FROM b")
def _(spark, d):
    m = _ah(spark, d)
    return spark.createDataFrame([(round(float(m.coef[0]), 6), round(float(m.coef[1]), 6), m.n_obs)], "b_ly double, b_x double, n bigint")


_AHU = f"{_AH}, g AS (SELECT id, sum(z1 * u) AS g1, sum(z2 * u) AS g2 FROM (SELECT z.*, dy - b_ly * dly - b_x * z.dx AS u FROM z, b) q GROUP BY 1), om AS (SELECT sum(g1 * g1) AS o11, sum(g1 * g2) AS o12, sum(g2 * g2) AS o22 FROM g)"


@query("ah_robust_se", f"WITH {_ahz('part_year')}, {_AHU} SELECT round(sqrt((e * e * o11 - 2 * e * b * o12 + b * b * o22)) / abs(det), 6) AS se_ly, round(sqrt((c * c * o11 - 2 * a * c * o12 + a * a * o22)) / abs(det), 6) AS se_x FROM b, om")
def _(spark, d):
    s = report.stderror(_ah(spark, d))
    return spark.createDataFrame([(round(float(s[0]), 6), round(float(s[1]), 6))], "se_ly double, se_x double")


@query("omega_clustered", f"WITH {_ahz('part_year')}, {_AHU} SELECT round(o11, 3) AS o11, round(o12, 3) AS o12, round(o22, 3) AS o22 FROM om")
def _(spark, d):
    _, m = _moments(spark, d, "part_year", AndersonHsiao(), "y ~ lag(y) + x", ["x"], False)
    o = m.weighed(np.linalg.solve(m.zx, m.zy), [0, 1])
    return spark.createDataFrame([tuple(round(float(v), 3) for v in (o[0, 0], o[0, 1], o[1, 1]))], "o11 double, o12 double, o22 double")


@query("ah_residuals", f"WITH {_ahz('part_year')}, {_AH} SELECT id, t, round(dy - b_ly * dly - b_x * z.dx, 5) AS residual FROM z, b")
def _(spark, d):
    return report.residuals(_ah(spark, d)).select("id", "t", _r("residual", 5).alias("residual"))


_INV = lambda a, b, c, t: f"SELECT {c} / ({a} * {c} - {b} * {b}) AS w11, -{b} / ({a} * {c} - {b} * {b}) AS w12, {a} / ({a} * {c} - {b} * {b}) AS w22 FROM {t}"
_D1 = f"{_ZHZ}, ng AS (SELECT count(DISTINCT id) AS n FROM p), w AS (SELECT n * w11 AS w11, n * w12 AS w12, n * w22 AS w22 FROM ({_INV('a', 'b', 'c', 'zhz')}) q, ng), mm AS (SELECT sum(z1 * dly) AS x1, sum(z2 * dly) AS x2, sum(z1 * dy) AS y1, sum(z2 * dy) AS y2, count(*) AS n_obs FROM z)"
_SOLVE = "(SELECT x1 * w11 + x2 * w12 AS g1, x1 * w12 + x2 * w22 AS g2, * FROM mm, w) q"
_B1 = f"{_D1}, b1 AS (SELECT (g1 * y1 + g2 * y2) / (g1 * x1 + g2 * x2) AS beta, 1 / (g1 * x1 + g2 * x2) AS bread, * FROM {_SOLVE})"
_G1 = f"{_B1}, gi AS (SELECT z.id, sum(z1 * (dy - beta * dly)) AS h1, sum(z2 * (dy - beta * dly)) AS h2, sum(z1 * dly) AS m1, sum(z2 * dly) AS m2 FROM z, b1 GROUP BY 1), o1 AS (SELECT sum(h1 * h1) AS a, sum(h1 * h2) AS b, sum(h2 * h2) AS c FROM gi)"
_B2 = f"{_G1}, w2 AS ({_INV('a', 'b', 'c', 'o1')}), b2 AS (SELECT (x1 * w11 + x2 * w12) AS g1, (x1 * w12 + x2 * w22) AS g2, * FROM mm, w2), s2 AS (SELECT (g1 * y1 + g2 * y2) / (g1 * x1 + g2 * x2) AS beta, 1 / (g1 * x1 + g2 * x2) AS bread, * FROM b2)"


def _dg(spark, d, steps=1, robust=True, windmeijer=True, p="cust_year", **options):
    s = DifferenceGMM(robust=robust, steps=steps, windmeijer=windmeijer)
    return fit(s, panel(spark, d, p), formula="y ~ lag(y)", id_col="id", time_col="t", collapse=True, max_lags=2, **options)


def _one(spark, m):
    return spark.createDataFrame([(round(float(m.coef[0]), 5), round(float(report.stderror(m)[0]), 5), round(m.j_stat, 3), m.n_instruments - 1)], "beta double, se double, j double, dof bigint")


@query("dgmm_onestep_k1_l2", f"WITH {_k1('cust_year')}, {_G1} SELECT round(beta, 5) AS beta, round(sqrt(bread * bread * (g1 * g1 * a + 2 * g1 * g2 * b + g2 * g2 * c)), 5) AS se, round(w11 * (y1 - x1 * beta) * (y1 - x1 * beta) + 2 * w12 * (y1 - x1 * beta) * (y2 - x2 * beta) + w22 * (y2 - x2 * beta) * (y2 - x2 * beta), 3) AS j, CAST(1 AS BIGINT) AS dof FROM b1, o1")
def _(spark, d):
    return _one(spark, _dg(spark, d))


@query("dgmm_twostep_k1_l2", f"WITH {_k1('cust_year')}, {_B2} SELECT round(beta, 5) AS beta, round(sqrt(bread), 5) AS se, round(w11 * (y1 - x1 * beta) * (y1 - x1 * beta) + 2 * w12 * (y1 - x1 * beta) * (y2 - x2 * beta) + w22 * (y2 - x2 * beta) * (y2 - x2 * beta), 3) AS j, CAST(1 AS BIGINT) AS dof FROM s2")
def _(spark, d):
    return _one(spark, _dg(spark, d, 2, False))


@query("windmeijer_k1_l2", f"""WITH {_k1('cust_year')}, {_B2},
  c AS (SELECT w11 * (y1 - x1 * beta) + w12 * (y2 - x2 * beta) AS c1, w12 * (y1 - x1 * beta) + w22 * (y2 - x2 * beta) AS c2 FROM s2),
  tmp AS (SELECT -sum((h1 * c1 + h2 * c2) * m1 + h1 * (m1 * c1 + m2 * c2)) AS t1, -sum((h1 * c1 + h2 * c2) * m2 + h2 * (m1 * c1 + m2 * c2)) AS t2 FROM gi, c),
  v1 AS (SELECT b1.bread * b1.bread * (b1.g1 * b1.g1 * a + 2 * b1.g1 * b1.g2 * b + b1.g2 * b1.g2 * c) AS v FROM b1, o1),
  dd AS (SELECT -bread * (g1 * t1 + g2 * t2) AS d FROM s2, tmp)
  SELECT round(sqrt(bread + 2 * d * bread + d * d * v), 5) AS se FROM s2, dd, v1""")
def _(spark, d):
    return spark.createDataFrame([(round(float(report.stderror(_dg(spark, d, 2))[0]), 5),)], "se double")


def _fodz(p: str) -> str:
    z = lambda o: f"coalesce((SELECT h.y FROM l h WHERE h.id = fo.id AND h.tidx = fo.tidx - {o}), 0.0)"
    return f"{_fod(p)}, z AS (SELECT fo.id, fo.t, sy AS dy, sly AS dly, {z(1)} AS z1, {z(2)} AS z2 FROM fo)"


@query("fod_onestep_k1_l2", f"WITH {_fodz('cust_year')}, {_B1} SELECT round(beta, 5) AS beta, n_obs FROM b1")
def _(spark, d):
    m = _dg(spark, d, transform="fod")
    return spark.createDataFrame([(round(float(m.coef[0]), 5), m.n_obs)], "beta double, n_obs bigint")


@query("sgmm_onestep_k1", f"""WITH {_d('cust_year')}, z AS (
  SELECT d.id, d.t, dy, dly, coalesce(h.y, 0.0) AS z1, 0.0 AS z2 FROM d LEFT JOIN l h ON h.id = d.id AND h.tidx = d.tidx - 2
  UNION ALL SELECT l.id, l.t, l.y, l.ly, 0.0, coalesce(g.dy, 0.0) FROM l LEFT JOIN d g ON g.id = l.id AND g.tidx = l.tidx - 1 WHERE l.rn >= 3),
  zz AS (SELECT sum(z1 * z1) AS a, sum(z1 * z2) AS b, sum(z2 * z2) AS c FROM z), w AS ({_INV('a', 'b', 'c', 'zz')}),
  mm AS (SELECT sum(z1 * dly) AS x1, sum(z2 * dly) AS x2, sum(z1 * dy) AS y1, sum(z2 * dy) AS y2, count(*) AS n_obs FROM z)
  SELECT round((g1 * y1 + g2 * y2) / (g1 * x1 + g2 * x2), 5) AS beta, n_obs FROM {_SOLVE}""")
def _(spark, d):
    m = fit(SystemGMM(robust=True), panel(spark, d, "cust_year"), formula="y ~ lag(y)", id_col="id", time_col="t", collapse=True, max_lags=1)
    return spark.createDataFrame([(round(float(m.coef[0]), 5), m.n_obs)], "beta double, n_obs bigint")


_RES = f"{_AH}, u AS (SELECT z.id, z.t, dy, b_ly * dly + b_x * z.dx AS f, dly, z.dx, dy - b_ly * dly - b_x * z.dx AS u FROM z, b)"

for _k in (1, 2):

    def _ar(spark, d, k=_k):
        s = diag.ar_components(_ah(spark, d, "cust_year"), k)
        return spark.createDataFrame([tuple(round(float(s[c]), 4) for c in ("num", "square", "d0", "d1"))], "num double, square double, d_ly double, d_x double")

    query(f"ar{_k}_components", f"WITH {_ahz('cust_year')}, {_RES} SELECT round(sum(a.u * v.u), 4) AS num, round(sum(a.u * v.u * a.u * v.u), 4) AS square, round(sum(a.dly * v.u + v.dly * a.u), 4) AS d_ly, round(sum(a.dx * v.u + v.dx * a.u), 4) AS d_x FROM u a JOIN u v ON v.id = a.id AND v.t = a.t - {_k}")(_ar)


@query("jarque_bera", f"WITH {_ahz('part_year')}, {_RES}, mu AS (SELECT avg(u) AS m, count(*) AS n FROM u), c AS (SELECT avg(power(u - m, 2)) AS m2, avg(power(u - m, 3)) AS m3, avg(power(u - m, 4)) AS m4, any_value(n) AS n FROM u, mu) SELECT round(n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4), 3) AS stat, CAST(2 AS BIGINT) AS dof FROM c")
def _(spark, d):
    return spark.createDataFrame([(round(diag.jarque_bera_test(_ah(spark, d)).stat, 3), 2)], "stat double, dof bigint")


@query("pseudo_r2", f"WITH {_ahz('part_year')}, {_RES} SELECT round(power(corr(dy, f), 2), 6) AS r2 FROM u")
def _(spark, d):
    return spark.createDataFrame([(round(diag.r2(_ah(spark, d)), 6),)], "r2 double")


@query("standardized_residuals", f"WITH {_ahz('supp_year')}, {_RES}, mu AS (SELECT avg(u) AS m, stddev_samp(u) AS s FROM u) SELECT row_number() OVER (ORDER BY id, t) AS idx, round((u - m) / s, 4) AS std_resid FROM u, mu")
def _(spark, d):
    return report.plot_data(_ah(spark, d, "supp_year"), "residuals")["points"].select("idx", _r("std_resid", 4).alias("std_resid"))


@query("fitted_vs_actual", f"WITH {_ahz('part_year')}, {_RES} SELECT id, t, round(f, 5) AS fitted, round(dy, 5) AS y FROM u")
def _(spark, d):
    return report.fitted(_ah(spark, d)).select("id", "t", _r("fitted", 5).alias("fitted"), _r("y", 5).alias("y"))


@query("histogram", f"WITH {_ahz('part_year')}, {_RES}, mu AS (SELECT avg(u) AS m, stddev_samp(u) AS s FROM u), q AS (SELECT (u - m) / s AS v FROM u, mu), e AS (SELECT min(v) AS a, (max(v) - min(v)) / 30 AS w, count(*) AS n FROM q) SELECT CAST(least(floor((v - a) / w), 29) AS INT) AS bin, round(count(*) / (any_value(n) * any_value(w)), 5) AS density FROM q, e GROUP BY 1")
def _(spark, d):
    return report.plot_data(_ah(spark, d), "histogram")["bars"].select("bin", _r("density", 5).alias("density"))


@query("coeftable", f"WITH {_ahz('part_year')}, {_AHU}, s AS (SELECT b_ly, b_x, sqrt((e * e * o11 - 2 * e * b * o12 + b * b * o22)) / abs(det) AS s1, sqrt((c * c * o11 - 2 * a * c * o12 + a * a * o22)) / abs(det) AS s2 FROM b, om), r AS (SELECT 'L.y' AS name, b_ly AS v, s1 AS s FROM s UNION ALL SELECT 'x', b_x, s2 FROM s) SELECT name, round(v, 5) AS estimate, round(s, 5) AS std_error, round(v / s, 3) AS z, round(v - 1.959963984540054 * s, 5) AS lower, round(v + 1.959963984540054 * s, 5) AS upper FROM r")
def _(spark, d):
    t = report.coefficients(spark, _ah(spark, d))
    return t.select("name", _r("estimate", 5).alias("estimate"), _r("std_error", 5).alias("std_error"), _r("z", 3).alias("z"), _r("lower", 5).alias("lower"), _r("upper", 5).alias("upper"))


def _rounded(t: DataFrame, digits: int = 4) -> DataFrame:
    ends = {"z": 2, "p": 4}
    return t.select("name", *(_r(c, ends.get(c, digits)).alias(c) for c in ("estimate", "std_error", "z", "p", "lower", "upper")))


def _full(spec, p="part_year", **options):
    def run(spark, d):
        m = fit(spec, panel(spark, d, p), formula="y ~ lag(y) + x", id_col="id", time_col="t", exog=["x"], **options)
        return _rounded(report.coefficients(spark, m))

    return run


query("dgmm_full", G.query(_d("part_year"), G.coefficients()))(_full(DifferenceGMM(robust=True)))
query("dgmm_twostep_windmeijer_full", G.query(_d("part_year"), G.coefficients(), steps=2))(_full(DifferenceGMM(robust=True, steps=2)))
query("dgmm_twostep_naive_full", G.query(_d("part_year"), G.coefficients(), steps=2, windmeijer=False))(_full(DifferenceGMM(robust=True, steps=2, windmeijer=False)))
query("dgmm_homoskedastic_full", G.query(_d("part_year"), G.coefficients(), robust=False))(_full(DifferenceGMM()))
query("dgmm_collapsed_long_panel", G.query(_d("user_day"), G.coefficients(), collapse=True))(_full(DifferenceGMM(robust=True), "user_day", collapse=True))
query("fod_full", G.query(_fod("part_year"), G.coefficients(), transform="fod"))(_full(DifferenceGMM(robust=True), transform="fod"))
query("sgmm_full", G.query(_d("part_year"), G.coefficients(), "system"))(_full(SystemGMM(robust=True)))
query("sgmm_collapsed_full", G.query(_d("cust_year"), G.coefficients(), "system", collapse=True, max_lags=2))(_full(SystemGMM(robust=True), "cust_year", collapse=True, max_lags=2))
query("sgmm_twostep_windmeijer_full", G.query(_d("part_year"), G.coefficients(), "system", steps=2))(_full(SystemGMM(robust=True, steps=2)))
_PERIODS = "list_concat(['L.y', 'x'], (SELECT list('t=' || t ORDER BY t) FROM tm WHERE tidx >= 3))"
query("dgmm_time_effects", G.query(_d("part_year"), G.coefficients(_PERIODS), time_effects=True))(_full(DifferenceGMM(robust=True), time_effects=True))


def _result(test) -> tuple:
    return (test.name, round(float(test.stat), 3), int(test.dof), round(float(test.pvalue), 4))


_TEST = "test string, stat double, dof bigint, pvalue double"
_SARGAN = f"SELECT 'Sargan J-Test' AS test, round(j, 3) AS stat, CAST(width - k AS BIGINT) AS dof, round({G.chi2_sf('j', 'width - k')}, 4) AS pvalue FROM r"


def _ar_sql(order: int) -> str:
    return f"SELECT 'AR({order}) Test', round(z, 3), 0, round({G.two_sided('z')}, 4) FROM ar{order}"


_JB = "SELECT 'Jarque-Bera Test', round(n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4), 3), 2, round(exp(-n / 12.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4)), 4) FROM jb"
_JB_CTE = "jb AS (SELECT avg(power(u - mu, 2)) AS m2, avg(power(u - mu, 3)) AS m3, avg(power(u - mu, 4)) AS m4, count(*) AS n FROM u, (SELECT avg(u) AS mu FROM u))"


@query("sargan_test", G.query(_d("part_year"), _SARGAN, steps=2))
def _(spark, d):
    m = fit(DifferenceGMM(robust=True, steps=2), panel(spark, d, "part_year"), formula="y ~ lag(y) + x", id_col="id", time_col="t", exog=["x"])
    return spark.createDataFrame([_result(diag.sargan_test(m))], _TEST)


for _k in (1, 2):

    def _ar_test(spark, d, k=_k):
        m = _ah(spark, d, "cust_year")
        first = diag.ar_test(m, k)
        return spark.createDataFrame([_result(first), _result(diag.ar_test(m, k, cached=True))], _TEST).distinct()

    query(f"ar{_k}_test", G.query(_d("cust_year"), f"SELECT 'AR({_k}) Test' AS test, round(z, 3) AS stat, CAST(0 AS BIGINT) AS dof, round({G.two_sided('z')}, 4) AS pvalue FROM ar{_k}", collapse=True, max_lags=1, more=f", {G.BEFORE}, {G.autocorrelation(_k)}"))(_ar_test)


@query("diagnose_report", G.query(_d("part_year"), f"SELECT test, stat, CAST(dof AS BIGINT) AS dof, pvalue FROM ({_SARGAN} UNION ALL {_ar_sql(1)} UNION ALL {_ar_sql(2)} UNION ALL {_JB} UNION ALL SELECT 'Pseudo R2', round(corr(y, f) ** 2, 3), 0, -1.0 FROM u)", "system", steps=2, more=f", {G.BEFORE}, {G.autocorrelation(1)}, {G.autocorrelation(2)}, {_JB_CTE}"))
def _(spark, d):
    m = fit(SystemGMM(robust=True, steps=2), panel(spark, d, "part_year"), formula="y ~ lag(y) + x", id_col="id", time_col="t", exog=["x"])
    out = diag.diagnose(m, out=lambda *_: None)
    return spark.createDataFrame([_result(v) if not isinstance(v, float) else ("Pseudo R2", round(v, 3), 0, -1.0) for v in out.values()], _TEST)


@query("wald_test", G.query(_d("part_year"), "SELECT 'Wald Test' AS test, round(w, 3) AS stat, CAST(2 AS BIGINT) AS dof, round(exp(-w / 2), 4) AS pvalue FROM (SELECT (v[2][2] * b[1] * b[1] - 2 * v[1][2] * b[1] * (b[2] - 0.7) + v[1][1] * (b[2] - 0.7) * (b[2] - 0.7)) / (v[1][1] * v[2][2] - v[1][2] * v[1][2]) AS w FROM r)"))
def _(spark, d):
    m = fit(DifferenceGMM(robust=True), panel(spark, d, "part_year"), formula="y ~ lag(y) + x", id_col="id", time_col="t", exog=["x"])
    return spark.createDataFrame([_result(diag.wald_test(m, [[1, 0], [0, 1]], [0, 0.7]))], _TEST)


def _j(**options) -> str:
    return "(" + G.query(_d("part_year"), "SELECT j, width - k AS dof FROM r", **options) + ")"


@query("diff_hansen", f"SELECT 'Difference-in-Hansen C-Test' AS test, round(c, 3) AS stat, CAST(dof AS BIGINT) AS dof, CASE WHEN c = 0 THEN 1.0 ELSE round({G.chi2_sf('c', 'dof')}, 4) END AS pvalue FROM (SELECT greatest(few.j - many.j, 0.0) AS c, many.dof - few.dof AS dof FROM {_j(max_lags=1)} few, {_j(max_lags=3, steps=2)} many)")
def _(spark, d):
    f = prepare(panel(spark, d, "part_year"), "id", "t", "y ~ lag(y) + x", DifferenceGMM(), exog=["x"])
    few, many = (estimate(DifferenceGMM(robust=True, steps=s), f, max_lags=n) for s, n in ((1, 1), (2, 3)))
    return spark.createDataFrame([_result(diag.diff_hansen_test(few, many))], _TEST)


_QN = "(row_number() OVER (ORDER BY u) - 0.5) / count(*) OVER ()"


@query("qq_sample", f"WITH {_ahz('part_year')}, {_RES}, mu AS (SELECT avg(u) AS m, stddev_samp(u) AS s FROM u), q AS (SELECT (u - m) / s AS v, {_QN} AS p FROM u, mu) SELECT round({G.normal_quantile('p')}, 5) AS theoretical, round(v, 4) AS sample FROM q")
def _(spark, d):
    points = report.plot_data(_ah(spark, d), "qq")["points"]
    return points.select(_r("theoretical", 5).alias("theoretical"), _r("sample", 4).alias("sample"))


@query("identity_line", f"WITH {_ahz('part_year')}, {_RES} SELECT round(least(min(dy), min(f)), 5) AS low, round(greatest(max(dy), max(f)), 5) AS high FROM u")
def _(spark, d):
    (a, _), (b, _) = report.plot_data(_ah(spark, d), "fitted")["identity"]
    return spark.createDataFrame([(round(a, 5), round(b, 5))], "low double, high double")


@query("normal_curve", "SELECT round(x, 6) AS x, round(exp(-x * x / 2) / sqrt(2 * pi()), 8) AS density FROM (SELECT -4 + 8 * i / 99.0 AS x FROM (SELECT unnest(generate_series(0, 99)) AS i))")
def _(spark, d):
    return report.plot_data(_ah(spark, d, "supp_year"), "histogram")["normal"].select(_r("x").alias("x"), _r("density", 8).alias("density"))


@query("dashboard", f"WITH {_ahz('supp_year')}, {_RES}, c AS (SELECT count(*) AS n, count(DISTINCT id) AS ids FROM u), g AS (SELECT count(DISTINCT id) AS ids FROM p) SELECT series, c.n || ' residuals of ' || g.ids || ' ids' AS title, CAST(CASE series WHEN 'histogram' THEN (SELECT count(DISTINCT least(floor((u - a) / ((b - a) / 30)), 29)) FROM u, (SELECT min(u) AS a, max(u) AS b FROM u)) ELSE c.n END AS BIGINT) AS points FROM c, g, (SELECT unnest(['residuals', 'fitted', 'histogram', 'qq']) AS series)")
def _(spark, d):
    parts = report.plot_data(_ah(spark, d, "supp_year"))
    rows = [(k, parts["title"], parts[k]["bars" if k == "histogram" else "points"].count()) for k in ("residuals", "fitted", "histogram", "qq")]
    return spark.createDataFrame(rows, "series string, title string, points bigint")


@query("instruments_system_full", f"""WITH {_d('supp_year')}, n AS (SELECT max(tidx) AS t FROM tm), w AS (SELECT (t - 1) * (t - 2) // 2 AS lags, t FROM n),
  d2 AS (SELECT * FROM d), a AS (SELECT r.id, r.t, FALSE AS is_level, (r.tidx - 2) * (r.tidx - 3) // 2 + o - 2 AS col, h.y AS val FROM d r CROSS JOIN (SELECT unnest(generate_series(2, 40)) AS o) JOIN l h ON h.id = r.id AND h.tidx = r.tidx - o
  UNION ALL SELECT id, d.t, FALSE, lags, dx FROM d, w
  UNION ALL SELECT r.id, r.t, TRUE, lags + 1 + r.tidx - 3, h.dy FROM w, l r JOIN d h ON h.id = r.id AND h.tidx = r.tidx - 1 WHERE r.rn >= 3
  UNION ALL SELECT id, l.t, TRUE, lags + 1 + w.t - 2, x FROM l, w WHERE rn >= 3)
  SELECT id, t, is_level, CAST(col AS INT) AS col, round(val, 6) AS val FROM a WHERE val <> 0""")
def _(spark, d):
    s = SystemGMM()
    rows, _ = inst.build_instruments(s, _frame(spark, d, "supp_year", "y ~ lag(y) + x", s, exog=["x"]))
    return rows.select("id", "t", "is_level", "col", _r("val").alias("val"))


_MOVED = "p0 AS ({0}), p AS (SELECT id, t, y, sum(m) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM (SELECT a.id, a.t, a.y, coalesce(b.y, 0.0) AS m FROM p0 a LEFT JOIN p0 b ON b.id = a.id AND b.t = a.t - 2))".format(PANELS["cust_year"])


@query("collinear_instruments", f"WITH {_MOVED}, {_d('cust_year').split('), tm AS', 1)[1].join(['tm AS', ''])}, z AS (SELECT d.id, d.t, dy, dly, dx, coalesce(h.y, 0.0) AS z1, coalesce(g.y, 0.0) AS z2 FROM d LEFT JOIN l h ON h.id = d.id AND h.tidx = d.tidx - 2 LEFT JOIN l g ON g.id = d.id AND g.tidx = d.tidx - 3), {_AH} SELECT CAST(2 AS BIGINT) AS n_instruments, round(b_ly, 4) AS b_ly, round(b_x, 4) AS b_x FROM b")
def _(spark, d):
    """The differences of x are the second lag of y: of three instruments the last repeats the first."""
    w = Window.partitionBy("id").orderBy("t")
    p = panel(spark, d, "cust_year").withColumn("m", F.coalesce(F.first("y").over(w.rangeBetween(-2, -2)), F.lit(0.0)))
    p = p.select("id", "t", "y", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("x"))
    m = fit(DifferenceGMM(robust=True), p, formula="y ~ lag(y) + x", id_col="id", time_col="t", exog=["x"], collapse=True, max_lags=2)
    return spark.createDataFrame([(m.n_instruments, round(float(m.coef[0]), 4), round(float(m.coef[1]), 4))], "n_instruments bigint, b_ly double, b_x double")


@query("ridge_lift", "SELECT k, round(greatest(0.0, CASE WHEN low >= 1e-12 THEN 0.0 ELSE 1e-12 - low + 1e-10 END) * 1e9, 1) AS lift FROM (SELECT k, (a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS low FROM (VALUES (1, 2.0, 0.0, 2.0), (2, -1.0, 0.0, 1.0), (3, 1.0, 2.0, 1.0), (4, 0.5, 0.25, 0.125), (5, 0.0, 0.0, 3.0)) AS v(k, a, b, c))")
def _(spark, d):
    cases = [(1, 2.0, 0.0, 2.0), (2, -1.0, 0.0, 1.0), (3, 1.0, 2.0, 1.0), (4, 0.5, 0.25, 0.125), (5, 0.0, 0.0, 3.0)]
    rows = []
    for k, a, b, c in cases:
        m = np.array([[a, b], [b, c]])
        rows.append((k, round(float((ridge_if_singular(m) - m)[0, 0]) * 1e9, 1)))
    return spark.createDataFrame(rows, "k int, lift double")


@query("correlation_matrix", f"WITH {_l('part_year')}, w AS (SELECT id, p.t, y, x, y - x AS r FROM p), u AS (SELECT unnest(['y', 'x', 'r']) AS a), c AS (SELECT corr(y, y) AS yy, corr(y, x) AS yx, corr(y, r) AS yr, corr(x, x) AS xx, corr(x, r) AS xr, corr(r, r) AS rr FROM w) SELECT u.a, v.a AS b, round(CASE u.a || v.a WHEN 'yy' THEN yy WHEN 'yx' THEN yx WHEN 'xy' THEN yx WHEN 'yr' THEN yr WHEN 'ry' THEN yr WHEN 'xx' THEN xx WHEN 'xr' THEN xr WHEN 'rx' THEN xr ELSE rr END, 6) AS corr FROM u, u v, c")
def _(spark, d):
    p = panel(spark, d, "part_year").withColumn("r", F.col("y") - F.col("x"))
    return tables.correlation(p, ["y", "x", "r"]).select("a", "b", _r("corr").alias("corr"))


@query("describe_table", "SELECT stat, round(CASE stat WHEN 'count' THEN n WHEN 'mean' THEN m WHEN 'stddev' THEN s WHEN 'min' THEN a ELSE b END, 4) AS value FROM (SELECT count(o_totalprice) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders), (SELECT unnest(['count', 'mean', 'stddev', 'min', 'max']) AS stat)")
def _(spark, d):
    s = tables.describe(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice").filter(F.col("summary").isin("count", "mean", "stddev", "min", "max"))
    return s.select(F.col("summary").alias("stat"), _r(F.col("o_totalprice").cast("double"), 4).alias("value"))


@query("preview_first_rows", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 5")
def _(spark, d):
    return tables.preview(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey").orderBy("o_orderkey"), 5)


@query("ingest_kinds", "SELECT kind, count(*) AS n, CAST(sum(n_regionkey) AS BIGINT) AS keys FROM nation, (SELECT unnest(['spark', 'pandas', 'arrow', 'columns', 'rows']) AS kind) GROUP BY 1")
def _(spark, d):
    n = tables.read_table(spark, f"{d}/nation.parquet").select("n_nationkey", "n_regionkey")
    kinds = {"spark": n, "pandas": n.toPandas(), "arrow": n.toArrow(), "columns": n.toPandas().to_dict("list"), "rows": n.toPandas().to_dict("records")}
    parts = [tables.as_dataframe(v, spark).agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("n_regionkey").cast("long").alias("keys")) for k, v in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("sinks_and_sources", "SELECT kind, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier, (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS kind) GROUP BY 1")
def _(spark, d):
    """Written in each format and read back."""
    rows, out = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.col("s_acctbal").cast("double").alias("s_acctbal")), None
    where = tables.scratch(spark)
    for kind in ("csv", "json", "orc", "parquet"):
        tables.write_table(rows, f"{where}/{kind}", kind, **({"header": True} if kind == "csv" else {}))
        one = tables.read_table(spark, f"{where}/{kind}", kind).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("scan_columns", "SELECT unnest(['l_extendedprice', 'l_quantity', 'l_shipdate', 'l_suppkey']) AS name")
def _(spark, d):
    """The columns that the scan below a fit reads: those of the formula alone."""
    f = _frame(spark, d, "supp_year", "y ~ lag(y) + x")
    plan = f.panel._jdf.queryExecution().executedPlan().toString()
    reads = {c.split(":")[0] for part in plan.split("ReadSchema: struct<")[1:] for c in part.split(">")[0].split(",")}
    return spark.createDataFrame([(c,) for c in sorted(reads)], "name string")


_TERMS = [("y ~ lag(y) + x", "text"), ("log(y) ~ lag(log(y), 1:2) + sqrt(x)", "text"), (Formula("y", [1, lag("y"), lag("x", range(0, 2))]), "objects")]


@query("formula_terms", "SELECT * FROM (VALUES ('text', 'y ~ lag(y) + x', 1, 'y', '', 1, 'L.y'), ('text', 'y ~ lag(y) + x', 2, 'x', '', 0, 'x'), ('text', 'log(y) ~ lag(log(y), 1:2) + sqrt(x)', 1, 'y', 'log', 1, 'L.log(y)'), ('text', 'log(y) ~ lag(log(y), 1:2) + sqrt(x)', 2, 'y', 'log', 2, 'L2.log(y)'), ('text', 'log(y) ~ lag(log(y), 1:2) + sqrt(x)', 3, 'x', 'sqrt', 0, 'sqrt(x)'), ('objects', 'y ~ lag(y) + lag(x, 0:1)', 1, 'y', '', 1, 'L.y'), ('objects', 'y ~ lag(y) + lag(x, 0:1)', 2, 'x', '', 0, 'x'), ('objects', 'y ~ lag(y) + lag(x, 0:1)', 3, 'x', '', 1, 'L.x')) AS v(kind, formula, place, var, fn, lag, name)")
def _(spark, d):
    rows = []
    for f, kind in _TERMS:
        specs = [s for t in parse_formula(f)[1] for s in parse_term(t)]
        rows += [(kind, str(f), i, s.var, s.fn or "", s.lag, s.name) for i, s in enumerate(specs, 1)]
    return spark.createDataFrame(rows, "kind string, formula string, place int, var string, fn string, lag int, name string")


def _refused(what) -> bool:
    try:
        what()
    except (ValueError, TypeError, NotImplementedError):
        return True
    return False


#: rules that refuse: the table's rows say which; the first two are counted from the data
_RULES = ["transform", "fod with system", "empty table", "id column", "time column", "repeated period", "variable", "text variable", "lagged response", "foreign exogenous", "exogenous response", "no equation", "few rows", "collinear regressors", "few instruments", "lag bounds", "no lags", "steps", "coefficient count", "unknown estimator", "lag of data", "sound"]


@query("validation_rules", f"SELECT rule, CASE rule WHEN 'empty table' THEN (SELECT count(*) = 0 FROM orders WHERE o_orderkey < 0) WHEN 'repeated period' THEN (SELECT count(*) > count(DISTINCT (o_custkey, year(o_orderdate))) FROM orders) WHEN 'sound' THEN FALSE ELSE TRUE END AS refused FROM (SELECT unnest({_RULES!r}) AS rule)")
def _(spark, d):
    p = panel(spark, d, "supp_year").persist()
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("t"), F.col("o_totalprice").cast("double").alias("y"))
    spec = DifferenceGMM()

    class Unknown(Spec):
        pass

    def go(data=p, formula="y ~ lag(y) + x", spec=spec, i="id", t="t", **kw):
        prepare(data, i, t, formula, spec, **kw).release()

    def run(data=p, formula="y ~ lag(y) + x", spec=spec, **kw):
        fit(spec, data, formula=formula, id_col="id", time_col="t", **kw).release()

    cases = [
        lambda: go(transform="second"), lambda: go(spec=SystemGMM(), transform="fod"), lambda: go(p.filter("id < 0")), lambda: go(i="none"), lambda: go(t="none"),
        lambda: go(orders, "y ~ lag(y)"), lambda: go(formula="y ~ none"), lambda: go(p.withColumn("x", F.lit("a"))), lambda: go(formula="lag(y) ~ x"),
        lambda: go(exog=["none"]), lambda: go(exog=["L.y"]), lambda: go(formula="y ~ lag(y, 90)"), lambda: run(p.filter("id = 1 and t <= 1994"), "y ~ lag(y) + x"),
        lambda: run(p.withColumn("z", 2 * F.col("x")), "y ~ x + z"), lambda: run(spec=AndersonHsiao()), lambda: run(min_lag=4, max_lag=3), lambda: run(max_lags=0),
        lambda: DifferenceGMM(steps=0), lambda: PanelResult(spec, np.zeros(2), np.eye(2), ["a"], 1, 1, 1, 0.0, 0.0, np.eye(1)), lambda: run(spec=Unknown()), lambda: lag([1, 2]), lambda: run(exog=["x"]),
    ]
    return spark.createDataFrame([(rule, _refused(case)) for rule, case in zip(_RULES, cases, strict=True)], "rule string, refused boolean")


@query("result_accessors", f"WITH {_ahz('part_year')}, {_AHU}, ng AS (SELECT count(DISTINCT id) AS ids FROM p) SELECT what, CASE what WHEN 'nobs' THEN CAST(n AS VARCHAR) WHEN 'ngroups' THEN CAST(ids AS VARCHAR) WHEN 'ninstruments' THEN '2' WHEN 'dof' THEN '2' WHEN 'dof_residual' THEN CAST(n - 2 AS VARCHAR) WHEN 'formula' THEN 'y ~ lag(y) + x' WHEN 'method' THEN '1-step AndersonHsiao' WHEN 'coefnames' THEN 'L.y,x' WHEN 'robust' THEN 'true' WHEN 'windmeijer' THEN 'false' WHEN 'coef' THEN format('{{:.4f}}', b_ly) WHEN 'variance' THEN format('{{:.6f}}', (e * e * o11 - 2 * e * b * o12 + b * b * o22) / (det * det)) WHEN 'sargan dof' THEN '0' WHEN 'proliferation' THEN 'OK: 2 instruments for ' || ids || ' groups; ratio ' || CAST(round(2.0 / ids, 2) AS DOUBLE) END AS value FROM b, om, ng, (SELECT unnest(['nobs', 'ngroups', 'ninstruments', 'dof', 'dof_residual', 'formula', 'method', 'coefnames', 'robust', 'windmeijer', 'coef', 'variance', 'sargan dof', 'proliferation']) AS what)")
def _(spark, d):
    m = _ah(spark, d)
    values = {
        "nobs": report.nobs(m), "ngroups": report.ngroups(m), "ninstruments": report.ninstruments(m), "dof": report.dof(m), "dof_residual": report.dof_residual(m),
        "formula": report.formula(m), "method": m.metadata["method"], "coefnames": ",".join(report.coefnames(m)), "robust": str(report.is_robust(m)).lower(), "windmeijer": str(report.is_windmeijer(m)).lower(),
        "coef": f"{report.coef(m)[0]:.4f}", "variance": f"{report.vcov(m)[0, 0]:.6f}", "sargan dof": diag.sargan_test(m).dof, "proliferation": diag.check_proliferation(m),
    }
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "what string, value string")


@query("stars_and_hints", "SELECT p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 0.1 THEN '.' ELSE '' END AS stars, CASE WHEN p > 0.05 THEN 'not rejected' ELSE 'rejected' END AS hint FROM (SELECT DISTINCT round(CAST(v AS DOUBLE), 4) AS p FROM (SELECT l_discount * 2 AS v FROM lineitem UNION ALL SELECT l_tax / 10 FROM lineitem))")
def _(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    values = items.select((F.col("l_discount") * 2).alias("v")).unionAll(items.select(F.col("l_tax") / 10)).select(F.round(F.col("v").cast("double"), 4).alias("p")).distinct()
    rows = [(p, report.significance_stars(p), report.sargan_hint(p)) for p in (r["p"] for r in values.collect())]  # rates: few by nature
    return spark.createDataFrame(rows, "p double, stars string, hint string")


@query("summary_lines", f"WITH {_ahz('part_year')}, {_AHU}, s AS (SELECT b_ly, b_x, sqrt((e * e * o11 - 2 * e * b * o12 + b * b * o22)) / abs(det) AS s1, sqrt((c * c * o11 - 2 * a * c * o12 + a * a * o22)) / abs(det) AS s2, n FROM b, om), ng AS (SELECT count(DISTINCT id) AS ids FROM p), q AS (SELECT 'L.y' AS name, b_ly AS v, s1 AS s FROM s UNION ALL SELECT 'x', b_x, s2 FROM s) SELECT CAST(2 AS INT) AS line, n || ' rows of ' || ids || ' ids, 2 instruments; errors clustered by id' AS text FROM s, ng UNION ALL SELECT CAST(CASE name WHEN 'x' THEN 6 ELSE 5 END AS INT), rtrim(format('{{:3}}  {{:11.5f}}  {{:11.5f}}  {{:9.3f}}  {{:7.4f}} ', name, v, s, v / s, {G.two_sided('v / s')}) || CASE WHEN {G.two_sided('v / s')} < 0.001 THEN '***' WHEN {G.two_sided('v / s')} < 0.01 THEN '**' WHEN {G.two_sided('v / s')} < 0.05 THEN '*' WHEN {G.two_sided('v / s')} < 0.1 THEN '.' ELSE '' END) FROM q")
def _(spark, d):
    lines = report.summary(_ah(spark, d)).split("\n")
    return spark.createDataFrame([(i, lines[i - 1]) for i in (2, 5, 6)], "line int, text string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["ah_coef"](spark, sf_dir)

